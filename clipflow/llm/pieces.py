"""SentencePiece encoding and decoding: best segmentation by an Aho-Corasick automaton over the pieces.

One pass over a text: at every position the automaton follows its output links through all pieces that end there,
longest first, and each relaxes the position from the position where it starts. Characters that no piece covers become
bytes. Spaces are written as a mark, with one mark in front of the text; a mark that is in the text itself is written
in bytes, so that decoding gives back every text exactly.

Models come in two kinds. Where scores are log-probabilities, the best segmentation has the highest sum. Where they
are merge ranks, a sum of them means nothing: there a piece may follow another only if merging the text of both gives
these two again, and a step scores zero if so, else minus infinity. Merges across a seam depend on the two pieces
beside it alone, so that exactly one segmentation of every prefix has a finite score, and it is that of the merges.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_bytes, worker_store

#: Fixed value of the format: what stands for a space.
SPACE = "▁"
#: What a text's own space mark becomes before encoding. No text holds a lone surrogate and no piece does, so it goes to bytes.
OWN_MARK = "\udc81"
#: Score of a byte below the lowest of the pieces.
BYTE_PENALTY = 10.0
#: Stretches whose ids a worker remembers, in each of two generations.
CACHE = 150_000
#: Stretches up to this length go through the automaton side by side, longer ones one by one.
SIDE_BY_SIDE = 64
#: Places for remembered pairs of pieces. A pair takes the place of another one; nothing depends on what is remembered.
PAIRS = 1 << 20
#: What ends at a position if no piece does: the start of the text, or a character in bytes.
START, BYTES = -1, -2
NEVER = 1 << 40

ENCODED = "doc_id bigint, n_ids bigint, ids binary"


class Automaton:
    """Aho-Corasick automaton over texts. State 0 is the root; texts are known by their place in the list."""

    def __init__(self, texts: list[str]):
        letters = sorted(set("".join(texts)))
        #: Class of every code point, 0 for those of no text.
        self.classes = np.zeros(0x110000, np.int64)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        goto: dict[int, int] = {}
        own = [-1]
        levels: list[list[tuple[int, int, int]]] = []
        for number, text in enumerate(texts):
            state = 0
            for depth, letter in enumerate(self.classes[[ord(c) for c in text]].tolist()):
                key = state * self.width + letter
                if key not in goto:
                    goto[key] = len(own)
                    own.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((state, letter, goto[key]))
                state = goto[key]
            own[state] = number
        self.goto = goto
        self.fail = [0] * len(own)
        #: The nearest state on the way down the failure links, the state itself included, at which a text ends.
        self.top = [0] * len(own)
        #: The next such state behind one at which a text ends.
        self.link = [0] * len(own)
        for depth, level in enumerate(levels):
            for state, letter, child in level:
                if depth:
                    self.fail[child] = self.step(self.fail[state], letter)
                below = self.top[self.fail[child]]
                self.link[child] = below
                self.top[child] = child if own[child] >= 0 else below
        self.own = own
        self.keys = np.sort(np.fromiter(goto, np.int64, len(goto)))
        self.targets = np.array([goto[k] for k in self.keys.tolist()], np.int64)
        self.fails, self.tops, self.links, self.owns = (np.array(v, np.int64) for v in (self.fail, self.top, self.link, own))

    def step(self, state: int, letter: int) -> int:
        if not letter:
            return 0
        while (found := self.goto.get(state * self.width + letter)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return found

    def steps(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """``step`` of many."""
        out = np.zeros_like(states)
        at = np.flatnonzero(letters)
        states, letters = states[at], letters[at]
        while len(at):
            wanted = states * self.width + letters
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[place] == wanted
            out[at[hit]] = self.targets[place[hit]]
            more = ~hit & (states > 0)
            at, states, letters = at[more], self.fails[states[more]], letters[more]
        return out


class Seams:
    """Which piece may follow which in a model of merges.

    Pieces are numbered by birth: single characters first, then by falling score. The two pieces of a pair are taken
    apart from the younger one downwards; a merge across the seam that is older than what was just taken apart would have
    come first, and the pair does not stand.
    """

    def __init__(self, texts: list[str], scores: list[float]):
        """``texts`` in order of birth, with their scores; every character of a text is itself one of them."""
        self.texts, self.scores = texts, dict(zip(texts, scores))
        number = {text: i for i, text in enumerate(texts)}
        if any(c not in number for text in texts for c in text):
            raise ValueError("a model of merges needs a piece for every character of its pieces")
        n = len(texts)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        #: Pieces that merging their own text gives. Others are never found.
        self.reached = np.ones(n, bool)
        #: Pieces that share their score, or have such parts: their merges are ordered by place, so they are merged anew.
        shared = Counter(score for text, score in zip(texts, scores) if len(text) > 1)
        self.by_place = np.zeros(n, bool)
        joined = {}
        for i, text in enumerate(texts):
            if len(text) == 1:
                continue
            parts = self.merged(text, stop=2)
            self.reached[i] = len(parts) == 2 and all(p in number for p in parts)
            if self.reached[i]:
                self.left[i], self.right[i] = number[parts[0]], number[parts[1]]
            for cut in range(1, len(text)):
                a, b = number.get(text[:cut]), number.get(text[cut:])
                if a is not None and b is not None:
                    joined[a * n + b] = i
        for i, text in enumerate(texts):
            if len(text) > 1:
                self.by_place[i] = shared[scores[i]] > 1 or any(self.by_place[j] for j in (self.left[i], self.right[i]) if j >= 0)
        self.keys = np.array(sorted(joined), np.int64)
        self.whole = np.array([joined[k] for k in self.keys.tolist()], np.int64)
        self.known = np.full(PAIRS, -1, np.int64)
        self.answers = np.zeros(PAIRS, bool)

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The pieces that merging leaves of a short text: highest score first, of equals the leftmost, until ``stop`` are left."""
        parts = list(text)
        while len(parts) > stop:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _taken_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        again = self.by_place[a] | self.by_place[b]
        for i in np.flatnonzero(again).tolist():
            pair = [self.texts[a[i]], self.texts[b[i]]]
            out[i] = self.merged("".join(pair)) == pair
        at = np.flatnonzero(~again)
        a, b, limit = a[at], b[at], np.full(len(at), NEVER)
        while len(at) and len(self.keys):
            wanted = a * len(self.texts) + b
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            falls = (self.keys[place] == wanted) & (self.whole[place] < limit)
            out[at[falls]] = False
            first = a > b
            more = ~falls & (self.left[np.where(first, a, b)] >= 0)
            at, a, b, first = at[more], a[more], b[more], first[more]
            # of equally old merges the left one comes first
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ``b`` may follow ``a``, which may be no piece."""
        out = self.reached[b]
        at = np.flatnonzero((a >= 0) & out)
        pairs = a[at] * len(self.texts) + b[at]
        places = pairs * 0x9E3779B1 % PAIRS
        new = np.unique(pairs[self.known[places] != pairs])
        if len(new):
            answers = self._taken_apart(new // len(self.texts), new % len(self.texts))
            out[at] = self.answers[places]
            mine = np.flatnonzero(self.known[places] != pairs)
            out[at[mine]] = answers[np.searchsorted(new, pairs[mine])]
            slots = new * 0x9E3779B1 % PAIRS
            _, kept = np.unique(slots, return_index=True)
            self.known[slots[kept]], self.answers[slots[kept]] = new[kept], answers[kept]
        else:
            out[at] = self.answers[places]
        return out


class PieceModel:
    """Pieces, scores and automaton of a model."""

    def __init__(
        self, pieces: list[tuple[str, float, int]], byte_ids: list[int], others: dict[int, bytes] | None = None, merges: bool = False
    ):
        """``pieces`` are text, score and id; ``byte_ids`` the ids of the 256 bytes; ``others`` texts of ids that are only decoded.

        ``merges``: scores order merges, and are no log-probabilities.
        """
        pieces = sorted(pieces, key=lambda p: (len(p[0]) > 1, -p[1], p[2]))
        names = [p[0] for p in pieces]
        self.automaton = Automaton(names)
        self.seams = Seams(names, [p[1] for p in pieces]) if merges else None
        self.sizes = np.array([len(p) for p in names] + [0], np.int64)
        self.scores = np.array([p[1] for p in pieces] + [0.0])
        self.ids = np.array([p[2] for p in pieces] + [0], np.int64)
        self.byte_ids = byte_ids
        self.byte_score = min((p[1] for p in pieces), default=0.0) - BYTE_PENALTY
        self.texts = dict(others or {})
        self.texts |= {number: text.replace(SPACE, " ").encode() for text, _, number in pieces}
        self.texts |= {number: bytes((value,)) for value, number in enumerate(byte_ids)}
        #: No piece goes on from another character to a mark: then texts may be cut before marks.
        self.divides = not any(re.search(f"[^{SPACE}]{SPACE}", text) for text in names)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """A model file. Scores that are all whole numbers are merge ranks."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        byte_ids = [0] * 256
        pieces = []
        for i in numbers:
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((model.id_to_piece(i), model.get_score(i), i))
        others = {i: b"" for i in numbers if model.is_control(i) or model.is_unknown(i)}
        return cls(pieces, byte_ids, others, merges=all(score == int(score) for _, score, _ in pieces))

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.replace(OWN_MARK, SPACE).encode()]

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation; of equal sums the one whose last piece is longer, and so on forward."""
        machine, sizes, state = self.automaton, self.sizes, 0
        best = [0.0]
        last = [START]
        for end, letter in enumerate(machine.classes[[ord(c) for c in text]].tolist(), 1):
            state = machine.step(state, letter)
            score, found = float("-inf"), BYTES
            if self.seams is None:
                score = best[-1] + len(text[end - 1].encode("utf-8", "surrogatepass")) * self.byte_score
            top = machine.top[state]
            while top:
                piece = machine.own[top]
                start = end - int(sizes[piece])
                if self.seams is None:
                    if best[start] + self.scores[piece] > score:
                        score, found = best[start] + self.scores[piece], piece
                elif self.seams.stand(np.array([last[start]]), np.array([piece]))[0]:
                    found = piece
                    break
                top = machine.link[top]
            best.append(score)
            last.append(found)
        ids: list[int] = []
        end = len(text)
        while end:
            piece = last[end]
            ids += self._bytes(text[end - 1])[::-1] if piece == BYTES else [int(self.ids[piece])]
            end -= 1 if piece == BYTES else int(sizes[piece])
        return ids[::-1]

    def _side_by_side(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of the segmentations of many short texts: all go through the automaton in step, the longest first."""
        machine = self.automaton
        texts = sorted(texts, key=len, reverse=True)
        sizes = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letters = machine.classes[codes]
        first = np.cumsum(sizes) - sizes
        # a text has a place for each of its characters and one in front
        front = first + np.arange(len(texts))
        last = np.full(len(codes) + len(texts), BYTES)
        last[front] = START
        best = np.zeros(len(last))
        widths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        states = np.zeros(len(texts), np.int64)
        for end in range(1, int(sizes[0]) + 1):
            n = int(np.searchsorted(-sizes, -end, side="right"))
            states = machine.steps(states[:n], letters[first[:n] + end - 1])
            if self.seams is None:
                best[front[:n] + end] = best[front[:n] + end - 1] + widths[first[:n] + end - 1] * self.byte_score
            tops = machine.tops[states]
            at = np.flatnonzero(tops)
            tops = tops[at]
            while len(at):
                pieces = machine.owns[tops]
                here = front[at] + end
                start = here - self.sizes[pieces]
                if self.seams is None:
                    total = best[start] + self.scores[pieces]
                    better = total > best[here]
                    best[here[better]] = total[better]
                    done = np.zeros(len(at), bool)
                else:
                    better = done = self.seams.stand(last[start], pieces)
                last[here[better]] = pieces[better]
                tops = np.where(done, 0, machine.links[tops])
                at, tops = at[tops > 0], tops[tops > 0]
        used = np.zeros(len(last), bool)
        places, fronts = front + sizes, front
        while len(places):
            used[places] = True
            places = places - np.where(last[places] == BYTES, 1, self.sizes[last[places]])
            more = places > fronts
            places, fronts = places[more], fronts[more]
        places = np.flatnonzero(used)
        owners = np.searchsorted(front, places, side="right") - 1
        in_bytes = last[places] == BYTES
        spelt = [self._bytes(chr(c)) for c in codes[places[in_bytes] - owners[in_bytes] - 1].tolist()]
        counts = np.ones(len(places), np.int64)
        counts[in_bytes] = [len(s) for s in spelt]
        ids = np.repeat(self.ids[last[places]], counts)
        ids[np.repeat(in_bytes, counts)] = [i for s in spelt for i in s]
        ends = np.cumsum(np.bincount(owners, counts, len(texts)).astype(np.int64)) * 4
        raw = ids.astype("<u4").tobytes()
        return dict(zip(texts, (raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. An empty text has none."""
        cut = []
        for text in texts:
            if not text:
                cut.append([])
                continue
            marked = SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SPACE)
            cut.append(re.split(f"(?<=[^{SPACE}])(?={SPACE})", marked) if self.divides else [marked])
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        new = set().union(*cut) - self.young.keys()
        self.young |= {stretch: self.old[stretch] for stretch in new & self.old.keys()}
        new -= self.old.keys()
        if short := [stretch for stretch in new if len(stretch) <= SIDE_BY_SIDE]:
            self.young |= self._side_by_side(short)
        self.young |= {s: np.array(self.segment(s), "<u4").tobytes() for s in new if len(s) > SIDE_BY_SIDE}
        return [b"".join(map(self.young.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids, without the space in front."""
        whole = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


def piece_model(path: str) -> PieceModel:
    """The worker's model, loaded once."""
    store = worker_store()
    if ("pieces", path) not in store:
        store["pieces", path] = PieceModel.load(path)
    return store["pieces", path]


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list[str]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield batch.column(0).to_pylist(), [t.as_py().decode("utf-8", "replace") for t in batch.column(1)]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_ids, ids`` of every row, ids as little-endian unsigned 32-bit integers. NULL and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for ids, texts in _texts(batches):
            found = model.encode(texts)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array(found, pa.binary())],
                ["doc_id", "n_ids", "ids"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of encoded rows (``doc_id, ids``). NULL ids are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [model.decode(v.as_py() or b"") for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Every row encoded and decoded: ``doc_id, n_ids, ids_crc32, decoded_sha256, same``.

    ``same`` says whether decoding gives back the text. Rows that repeat an id stay rows of their own; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for ids, texts in _texts(batches):
            rows = []
            for doc_id, text, found in zip(ids, texts, model.encode(texts)):
                back = model.decode(found)
                rows.append((doc_id, len(found) // 4, zlib.crc32(found), hashlib.sha256(back.encode()).hexdigest(), back == text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(
        run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, same boolean"
    )
