"""Packing of tokenised documents into sequences of a fixed length.

How many pieces there are of each length is all that decides a packing, and lengths
are at most the capacity. So the search runs once over that bounded histogram, whatever the number
of documents, and yields fillings with how often each is used. Every piece then finds its place from its
rank among the pieces of its length.

The search is bin completion: the largest length left is completed by a filling of the rest of
its sequence; only undominated fillings are tried, least waste first; a branch ends when its waste
exceeds what an improvement may have. The best-fit solution is the first incumbent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored, text_bytes, worker_store
from .transducers import Cutter, Memory, as_list, character_classes

CAPACITY = 1024
END_ID = 2
#: Nodes of the search, and steps that list the fillings of one node. The incumbent stands beyond them.
MAX_NODES = 20_000
MAX_FILLINGS = 400
#: Pieces whose ranks one window group orders, on average.
BUCKET_ROWS = 100_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
PLACES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, ids binary"


# ---------------------------------------------------------------- tokens


class WordEncoder:
    """Byte-level BPE ids of texts.

    Texts are cut into the words of the pre-tokeniser, over which nothing is merged. A word that a block
    holds many times is looked up once in it, and words met before are remembered; ids are put together by offsets.
    """

    def __init__(self, path: str, classes: tuple[list[int], list[int]]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.cutter = Cutter(path, classes)
        self.known = Memory()

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        found = self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list] = [[] for _ in texts]
        for owner, words, _ in self.cutter.words(texts):
            if not len(words):
                continue
            by_word = pa.array(self.known.look_up(as_list(words.dictionary), self._encoded), pa.large_binary())
            ids = by_word.take(words.indices)
            _, offsets, data = ids.buffers()
            offsets, data = np.frombuffer(offsets, np.int64), memoryview(data)
            first, last = int(owner[0]), int(owner[-1])
            bounds = offsets[np.searchsorted(owner, np.arange(first, last + 2))].tolist()
            for k, (start, stop) in enumerate(zip(bounds, bounds[1:]), first):
                parts[k].append(data[start:stop])
        return [b"".join(p) for p in parts]


def encoder(path: str, classes: tuple[list[int], list[int]]) -> WordEncoder:
    """The worker's encoder, loaded once."""
    store = worker_store()
    if ("encoder", path) not in store:
        store["encoder", path] = WordEncoder(path, classes)
    return store["encoder", path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: only the first may be short."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """The pieces of every row's tokens (``PIECES``). A NULL or empty text has one token, the end."""
    end = np.array([end_id], "<u4").tobytes()
    classes = character_classes(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path, classes)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = [t.as_py().decode("utf-8", "replace") for t in batch.column(1)]
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(texts)):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start:4 * (start + length)]
                        rows.append((doc_id, k, start, length, zlib.crc32(part), part if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes()).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- search


def _fits_into(small: tuple, large: tuple) -> bool:
    """Whether the items of ``small`` can be shared out over those of ``large``, which then dominates."""
    if not small:
        return True
    item, rest, tried = small[0], small[1:], set()
    for i, room in enumerate(large):
        if room >= item and room not in tried:
            tried.add(room)
            if _fits_into(rest, large[:i] + (room - item,) + large[i + 1:]):
                return True
    return False


def fillings(counts: dict[int, int], lengths: list[int], room: int, limit: int = MAX_FILLINGS) -> list[tuple]:
    """Undominated ways to fill ``room`` from the lengths at hand (descending), least waste first.

    One item of exactly the room dominates all else. Listing stops after ``limit`` steps; exact pairs are found first.
    """
    if counts.get(room, 0):
        return [(room,)]
    fit = [v for v in lengths if v <= room and counts.get(v, 0)]
    if not fit:
        return [()]
    found = []
    for v in fit:
        w = room - v
        if w > v:
            continue
        if counts.get(w, 0) > (w == v):
            found.append((v, w))
            if len(found) == 8:
                break
    steps = [0]

    def extend(chosen: tuple, left: int, start: int) -> None:
        full = True
        for i in range(start, len(fit)):
            v = fit[i]
            if v > left or chosen.count(v) >= counts[v]:
                continue
            full = False
            steps[0] += 1
            if steps[0] > limit:
                return
            extend(chosen + (v,), left - v, i)
        # nothing at hand may fit any more, also none that an earlier choice passed over
        if full and not any(v <= left and chosen.count(v) < counts[v] for v in fit[:start]):
            found.append(chosen)

    extend((), room, 0)
    found = sorted(set(found), key=lambda f: (room - sum(f), len(f), [-v for v in f]))[:32] or [(fit[0],)]
    kept = []
    for filling in found:
        if not any(len(k) <= len(filling) <= 6 and _fits_into(filling, k) for k in kept):
            kept.append(filling)
    return kept


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Largest first, each completed by the largest that fits, the same filling as often as it can be had."""
    left = {v: n for v, n in counts.items() if n}
    plan = []
    while left:
        filling, room, spare = [], capacity, dict(left)
        for v in sorted(left, reverse=True):
            take = min(spare[v], room // v)
            if take and filling:
                filling += [v] * take
            elif take:
                filling, take = [v], 1
                more = min(spare[v] - 1, (room - v) // v)
                filling += [v] * more
                take += more
            room -= take * v
        times = min(left[v] // filling.count(v) for v in set(filling))
        plan.append((tuple(filling), times))
        for v in set(filling):
            left[v] -= times * filling.count(v)
            if not left[v]:
                del left[v]
    return plan


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed by volume, or by pieces over half a sequence of which no two share one."""
    volume = sum(v * n for v, n in counts.items())
    return max(-(-volume // capacity), sum(n for v, n in counts.items() if 2 * v > capacity))


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[tuple, int]]:
    """Fillings and how often each is used, in as few sequences as the search finds."""
    counts = {v: n for v, n in counts.items() if n}
    best = best_fit(counts, capacity)
    n_best = sum(n for _, n in best)
    least = lower_bound(counts, capacity)
    volume = sum(v * n for v, n in counts.items())
    if n_best == least:
        return best

    def node(left: dict[int, int]):
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        rest = dict(left)
        rest[top] -= 1
        return top, iter(fillings(rest, lengths, capacity - top))

    # depth-first over (what is left, its completions, plan so far, sequences, waste)
    stack = [(counts, *node(counts), (), 0, 0)]
    nodes = 0
    while stack and nodes < max_nodes and n_best > least:
        left, top, options, plan, used, waste = stack[-1]
        filling = next(options, None)
        if filling is None:
            stack.pop()
            continue
        nodes += 1
        whole = (top, *filling)
        gap = capacity - sum(whole)
        allowed = (n_best - 1) * capacity - volume - waste  # waste an improvement may still have
        times = min(left[v] // whole.count(v) for v in set(whole))
        if gap:
            times = min(times, allowed // gap)
        if times <= 0:
            continue
        rest = {v: n - times * whole.count(v) for v, n in left.items()}
        rest = {v: n for v, n in rest.items() if n}
        now = (plan, (whole, times))
        if not rest:
            best, n_best = now, used + times
            continue
        if used + times + lower_bound(rest, capacity) >= n_best:
            continue
        stack.append((rest, *node(rest), now, used + times, waste + gap * times))
    if isinstance(best, tuple):  # chained plan of the search
        chain, out = best, []
        while chain:
            chain, step = chain
            out.append(step)
        best = out[::-1]
    return best


# ---------------------------------------------------------------- places


def _places(plan: list[tuple[tuple, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each slot of the plan."""
    taken: dict[int, int] = {}
    slots: dict[int, list] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for v in filling:
            slots.setdefault(v, []).append((taken.get(v, 0), sequence, offset))
            taken[v] = taken.get(v, 0) + times
            offset += v
        sequence += times
    return {v: tuple(np.array(c) for c in zip(*rows)) for v, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (stored, ``PIECES``) with ``sequence_id`` and ``offset``.

    Driver and broadcast hold one number per length and one slot per filling of the plan, both bounded by the capacity.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    full = histogram.pop(capacity, 0)
    plan = complete_bins(histogram, capacity) if histogram else []
    if full:
        plan.append(((capacity,), full))
    places = _places(plan)
    n = (sum(histogram.values()) + full) // bucket_rows + 1
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(local) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("rank") + F.col("base")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for v in np.unique(length):
                first, base, at = places[int(v)]
                own = np.nonzero(length == v)[0]
                slot = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = base[slot] + rank[own] - first[slot]
                offset[own] = at[slot]
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset), batch.column(5)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"],
            )

    return ranked.mapInArrow(run, PLACES)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """Every piece of every row with its place (``PLACES``); ``ids`` is NULL unless asked for.

    NULL and empty texts are one end token. Only documents longer than the capacity are cut. Rows that
    repeat an id are documents of their own, rows without an id are packed too. Other columns are not read; an
    empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, ids array<bigint>, doc_ids``: the packed sequences themselves, pieces in their order."""

    def run(table):
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<u4").astype(np.int64)
        return pa.table({
            "sequence_id": table["sequence_id"].slice(0, 1),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "doc_ids": pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())),
        })

    return placed.groupBy("sequence_id").applyInArrow(run, "sequence_id bigint, ids array<bigint>, doc_ids array<bigint>")
