"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

The pre-tokeniser becomes a machine of eight states over ten kinds of characters; each of its transitions says whether
a word starts. A text is cut into chunks, every chunk's map from all entry states to exit states is computed in
step with the others, the maps are composed by a parallel prefix scan, and a last pass from the entry states now
known writes the word starts.

The merges become a machine over the bytes of a word. Of the prefixes of a word each is tokenised as a shorter prefix
and one more token, and two tokens may be neighbours exactly when no merge reaches over their border before one of
its sides is taken up by its own token. So a state holds, for every place where a later token may still begin, how far
that token has come, the token before it, and how many fewer tokens there were; a byte's transition emits by how
much the count of tokens changes. States are made when they are first met and are forgotten together beyond a bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_bytes, worker_store

#: Characters of a block that is cut at once, and of a chunk of it.
BLOCK_CHARS = 4_000_000
CHUNK_CHARS = 512
#: States that the counting machine may hold, and bytes of a long word between two looks at that bound.
MAX_STATES = 200_000
SLICE_BYTES = 50_000
#: Words that a worker remembers, in each of two generations, and bytes of one at most.
KEPT_WORDS = 250_000
KEPT_BYTES = 64

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

# ---------------------------------------------------------------- word starts

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Kinds of characters with what follows them: contractions of one and of two letters, white space before a word
#: that stands alone or leads the word, white space before more of it, document ends, added tokens and their rest.
_L, _N, _P, _Q1, _Q2, _ALONE, _LEADS, _WHITE, _END, _ADDED, _REST, _NONE = range(12)
#: States: nothing open, in letters, numbers, other marks, after a leading space, in white space, letters of a contraction left.
_OPEN, _IN_L, _IN_N, _IN_P, _LED, _IN_W, _ONE, _TWO = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word starts, by kind times eight plus state."""
    following, starts = np.zeros((12, 8), np.uint8), np.ones((12, 8), bool)
    for kind, state in ((_L, _IN_L), (_N, _IN_N), (_P, _IN_P)):
        following[kind] = state
        starts[kind, [state, _LED]] = False
    following[_L, [_ONE, _TWO]] = _OPEN, _ONE
    starts[_L, [_ONE, _TWO]] = False
    for kind, state in ((_Q1, _ONE), (_Q2, _TWO)):
        following[kind] = state
        following[kind, [_IN_P, _LED]] = _IN_P
        starts[kind, [_IN_P, _LED]] = False
    following[_LEADS], following[_WHITE] = _LED, _IN_W
    starts[_WHITE, _IN_W] = False
    starts[_REST] = False
    following[_NONE], starts[_NONE] = np.arange(8), False
    return following.ravel(), starts.ravel()


@lru_cache(maxsize=8)
def character_classes(path: str) -> tuple[list[int], list[int]]:
    """Where runs of code points of one class start, and their classes, as the tokenizer's library knows them.

    Code points on which two editions of the Unicode tables differ are put to the library itself.
    """
    import regex
    from tokenizers import Tokenizer

    every = "".join(map(chr, range(0x110000)))
    known = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            known[found.start():found.end()] = kind
    heads = {"L": LETTER, "N": NUMBER}
    older = np.array([heads.get(unicodedata.category(c)[0], OTHER) for c in every], np.uint8)
    older[known == SPACE] = SPACE
    unsure = [c for c in np.nonzero(older != known)[0].tolist() if not 0xD800 <= c < 0xE000]
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        starts = {span[0] for _, span in split("".join(f"\n{before}{chr(c)}" for c in unsure))}
        for k, c in enumerate(unsure):
            if 3 * k + 2 not in starts:  # goes on with what stands before it
                known[c] = kind
    bounds = [0, *(np.nonzero(np.diff(known))[0] + 1).tolist()]
    return bounds, known[bounds].tolist()


class Cutter:
    """The words of texts as the pre-tokeniser of a byte-level tokenizer cuts them."""

    def __init__(self, path: str, classes: tuple[list[int], list[int]]):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        way = model["pre_tokenizer"] or {}
        if model["normalizer"] or way.get("type") != "ByteLevel" or way.get("add_prefix_space") or not way.get("use_regex", True):
            raise ValueError("only byte-level tokenizers that cut by their own pattern are compiled")
        added = model["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that look at what stands beside them are not compiled")
        longest = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, longest))) if longest else None
        bounds, kinds = classes
        self.classes = np.repeat(np.array(kinds, np.uint8), np.diff([*bounds, 0x110000]))
        self.following, self.starts = _machine()

    def _kinds(self, text: str, points: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        found = self.classes[points]
        for a, b in spans:
            found[a:b] = SPACE
        kinds = found.copy()  # letters, numbers and others are their own kinds
        white = found == SPACE
        last = white.copy()
        last[:-1] &= ~white[1:]
        last[-1] = False
        kinds[white] = _WHITE
        kinds[last] = _ALONE
        kinds[last & (points == 32)] = _LEADS
        for at in np.nonzero(points == 39)[0].tolist():
            if text[at + 1:at + 2] in ("s", "t", "m", "d"):
                kinds[at] = _Q1
            elif text[at + 1:at + 3] in ("re", "ve", "ll"):
                kinds[at] = _Q2
        kinds[ends] = _END
        for a, b in spans:
            kinds[a], kinds[a + 1:b] = _ADDED, _REST
        return kinds

    def _marks(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character: chunk maps, their prefix scan, and a pass from known states."""
        n = len(kinds)
        chunks = -(-n // CHUNK_CHARS)
        steps = np.full(chunks * CHUNK_CHARS, _NONE * 8, np.uint8)
        steps[:n] = kinds * 8
        steps = np.ascontiguousarray(steps.reshape(chunks, CHUNK_CHARS).T)
        maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
        for t, step in enumerate(steps):
            maps = self.following[step[:, None] + maps]
            if (maps == maps[:, :1]).all():  # from here on every entry state comes to the same
                state = maps[:, 0]
                for step in steps[t + 1:]:
                    state = self.following[step + state]
                maps = np.repeat(state[:, None], 8, axis=1)
                break
        width = 1
        while width < chunks:
            later = np.take_along_axis(maps[width:], maps[:-width], axis=1)
            maps = np.concatenate([maps[:width], later])
            width *= 2
        state = np.concatenate([np.zeros(1, np.uint8), maps[:-1, _OPEN]])
        marks = np.empty(steps.shape, bool)
        for t, step in enumerate(steps):
            at = step + state
            marks[t] = self.starts[at]
            state = self.following[at]
        return marks.T.ravel()[:n]

    def _block(self, texts: list[str], final: bool):
        """Words of the texts: of which text, their dictionary array, whether they are added tokens; and what is left over.

        Unless ``final``, the last text goes on, and what follows its last certain word start is left over.
        """
        text = "\n".join([*texts, ""])
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        spans = [m.span() for m in self.added.finditer(text)] if self.added else []
        marks = np.nonzero(self._marks(self._kinds(text, points, ends, spans)))[0]
        rest = ""
        if not final:
            # two characters are looked ahead; an added token may have begun
            sure = len(text) - 3 - (max(len(p) for p in self.added.pattern.split("|")) if self.added else 0)
            low = len(text) - 1 - len(texts[-1])
            certain = marks[(marks > low) & (marks < sure)]
            stop = int(certain[-1]) if len(certain) else low
            rest = text[stop:-1]
            marks = np.append(marks[marks < stop], stop)
        else:
            marks = np.append(marks, len(text))
        data = text.encode()
        places = np.nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[0]  # of characters among the bytes
        offsets = np.append(places, len(data))[marks].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(marks) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        flags = np.zeros(len(points), np.uint8)
        flags[ends] = 1
        flags[[a for a, _ in spans]] = 2
        flags = flags[marks[:-1]]
        real = flags != 1
        owner = np.cumsum(~real)[real]
        return owner, words.filter(pa.array(real)).dictionary_encode(), flags[real] == 2, rest

    def words(self, texts: list[str]) -> Iterator[tuple[np.ndarray, pa.DictionaryArray, np.ndarray]]:
        """Blocks of words with the number of their text and whether they are added tokens, in the texts' order.

        A text of any length goes through blocks of bounded size; only a single word may make one larger.
        """
        held, first, size = [], 0, 0
        for number, text in enumerate(texts):
            if held and size + len(text) > BLOCK_CHARS:
                owner, found, added, _ = self._block(held, True)
                yield owner + first, found, added
                held, size = [], 0
            if len(text) <= BLOCK_CHARS:
                if not held:
                    first = number
                held.append(text)
                size += len(text)
                continue
            at, rest, window = 0, "", BLOCK_CHARS
            while at < len(text) or rest:
                part = rest + text[at:at + window]
                at += window
                owner, found, added, left = self._block([part], at >= len(text))
                window = 2 * window if left == part else BLOCK_CHARS
                rest = left
                yield owner + number, found, added
        if held:
            owner, found, added, _ = self._block(held, True)
            yield owner + first, found, added


def as_list(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Memory:
    """What words came to before, in two generations: words not met for a whole generation are forgotten."""

    def __init__(self, limit: int = KEPT_WORDS):
        self.limit, self.young, self.old = limit, {}, {}

    def look_up(self, words: list[bytes], answer) -> list:
        """The value of each of these distinct words; ``answer`` gives those of a list of unknown ones."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, words))
        unknown = []
        for k in [k for k, value in enumerate(found) if value is None]:
            value = found[k] = self.old.get(words[k])
            if value is None:
                unknown.append(k)
            else:
                self.young[words[k]] = value
        for k, value in zip(unknown, answer([words[k] for k in unknown]) if unknown else ()):
            found[k] = value
            if len(words[k]) <= KEPT_BYTES:
                self.young[words[k]] = value
        return found


# ---------------------------------------------------------------- token counts


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class CountingMachine:
    """The transducer of a BPE vocabulary that emits changes of the number of tokens of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError("only plain BPE vocabularies are compiled")
        letters, vocabulary = _byte_letters(), model["vocab"]
        self.merges: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if whole in self.made or any(self.made[t][2] > rank for t in (left, right) if t in self.made):
                raise ValueError("a token made in two ways, or before its parts, is not compiled")
            self.merges[left, right] = rank
            self.made[whole] = (left, right, rank)
        # trie of the tokens: node * 256 + byte -> node
        self.trie: dict[int, int] = {}
        self.token: list[int | None] = [None]
        self.inner = {0}
        for name, token in vocabulary.items():
            if token not in self.made and len(name) > 1:
                continue  # no merge makes it
            node = 0
            for letter in name:
                self.inner.add(node)
                node = self.trie.setdefault(node << 8 | letters[letter], len(self.token))
                if node == len(self.token):
                    self.token.append(None)
            self.token[node] = token
        if len({b for b in range(256) if b in self.trie and self.token[self.trie[b]] is not None}) < 256:
            raise ValueError("a vocabulary without all bytes is not compiled")
        self.fit: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.kept = Memory()
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[int, int] = {}
        self._number(((0, -1, 0),))

    def _number(self, state: tuple) -> int:
        found = self.numbers.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        return found

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at one end of ``token`` while it grows, with the rank that takes each up."""
        out, until = [], len(self.merges)
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until = self.made[token][2]
            token = self.made[token][side]

    def _meets(self, left: int, right: int, until: int) -> bool:
        """Whether a merge reaches over the border of two tokens at a rank below ``until``.

        Of equal merges the one further left comes first.
        """
        rank_of = self.merges.get
        starts = self._border(right, 0)
        for a, gone in self._border(left, 1):
            for b, taken in starts:
                rank = rank_of((a, b))
                if rank is not None and rank < until and rank < gone and rank <= taken:
                    return True
        return False

    def _is_whole(self, token: int) -> bool:
        """Whether the bytes of a token are tokenised as this token."""
        known = self.whole.get(token)
        if known is None:
            known = True
            if token in self.made:
                left, right, rank = self.made[token]
                known = self._is_whole(left) and self._is_whole(right) and not self._meets(left, right, rank)
            self.whole[token] = known
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        known = self.fit.get((left, right))
        if known is None:
            known = self.fit[left, right] = not self._meets(left, right, len(self.merges))
        return known

    def _step(self, at: int) -> int:
        """Compile a transition: next state times 256 plus 128 plus the change of the count."""
        moved, last, change = [], None, 0
        for node, before, fewer in self.states[at >> 8]:
            node = self.trie.get(node << 8 | at & 255)
            if node is None:
                continue
            if node in self.inner:
                moved.append((node, before, fewer))
            token = self.token[node]
            if last is None and token is not None and self._is_whole(token) and self._may_follow(before, token):
                last, change = token, fewer + 1
        if last is None:
            raise ValueError("the vocabulary has merges that do not make a finite-state tokenizer")
        state = tuple([(node, before, fewer - change) for node, before, fewer in moved] + [(0, last, 0)])
        found = self.steps[at] = self._number(state) << 8 | 128 + change
        return found

    def count(self, word: bytes) -> int:
        """Tokens of a word."""
        if len(self.states) > MAX_STATES or len(self.fit) > 20 * MAX_STATES:
            self.fit = {}
            self._forget()
        state = total = 0
        for at in range(0, len(word), SLICE_BYTES):
            if at and len(self.states) > MAX_STATES:
                held = self.states[state >> 8]
                self._forget()
                state = self._number(held) << 8
            known = self.steps.get
            for byte in word[at:at + SLICE_BYTES]:
                found = known(state | byte)
                if found is None:
                    found = self._step(state | byte)
                total += found & 255
                state = found & -256
        return total - 128 * len(word)


    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each of these distinct words; those met before are remembered, which is exact."""
        return np.array(self.kept.look_up(words, lambda unknown: map(self.count, unknown)), np.int64)


def worker_cutter(path: str, classes: tuple[list[int], list[int]]) -> Cutter:
    """The worker's cutter, compiled once."""
    store = worker_store()
    if ("cutter", path) not in store:
        store["cutter", path] = Cutter(path, classes)
    return store["cutter", path]


def worker_machine(path: str) -> CountingMachine:
    store = worker_store()
    if ("counting", path) not in store:
        store["counting", path] = CountingMachine(path)
    return store["counting", path]


def counted(texts: list[str], cutter: Cutter, machine: CountingMachine) -> np.ndarray:
    """Tokens of each text. A word that a block holds many times is counted once in it."""
    totals = np.zeros(len(texts), np.int64)
    for owner, words, added in cutter.words(texts):
        tokens = machine.counts(as_list(words.dictionary))[words.indices.to_numpy()]
        tokens[added] = 1
        totals += np.bincount(owner, tokens, len(texts)).astype(np.int64)
    return totals


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row (``COUNTS``), as the tokenizer's library counts.

    NULL and empty texts have no bytes and no tokens. Strings of added tokens inside a text are one token each, no
    others are added. Rows that repeat an id or have none are counted like others; other columns are not read; an
    empty table gives no rows. Texts are read whole, in blocks of bounded size.
    """
    classes = character_classes(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, machine = worker_cutter(tokenizer_path, classes), worker_machine(tokenizer_path)
        for batch in batches:
            texts = [t.as_py().decode("utf-8", "replace") for t in batch.column(1)]
            n_tokens = counted(texts, cutter, machine)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint"), text_bytes(), size.alias("n_bytes")).mapInArrow(run, COUNTS)
