"""Removal of byte strings that occur earlier, by a sparse suffix array in range-partitioned buckets.

Every string of ``length`` bytes holds a gram of ``GRAM`` bytes whose hash is the smallest of the
string's grams, the leftmost of equals: its anchor. Equal strings have equal anchors at equal
offsets, so a string can only repeat if its anchor's gram does, and only suffixes near
repeated anchors enter the array.

1. Each block of documents names its distinct anchor hashes; those that occur twice anywhere come back.
2. Suffixes around repeated anchors, as long as all strings they start need, go to buckets: sampled splitters
   divide the range of the eight tokens that lead at the anchor. Strings that may be equal agree in them and never lie
   on two sides of a splitter, so no comparison is left across bounds. Suffixes of anchors that
   are too frequent for one bucket are dealt singly, by a hash of all their tokens.
3. A bucket sorts its suffixes by multikey quicksort, word by word, going on only among equals. Of equal strings
   all but the earliest are marked.
4. The marks go back to the blocks, which cut the bytes that marked strings cover.

Copies of whole texts are found beforehand by digest and take no part in this. Each block
sends equal suffixes once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import attach, block_count, bundled, frugal, stored, unbundled, volume
from .exact import digests

LENGTH = 100
GRAM = 48
#: Bytes of a document that are hashed at a time.
CHUNK = 1 << 20
#: Anchor hashes of a shard, and bytes of suffixes of a bucket, on average.
SHARD_HASHES = 1_500_000
BUCKET_BYTES = 5_000_000
#: Occurrences of a gram from which its suffixes are dealt singly.
FREQUENT = 20_000
#: Leading words that each block contributes to the sample of the splitters.
SAMPLE = 64

#: Stands for a NULL id, which comes after all others.
NO_ID = np.iinfo(np.int64).max
#: Kinds of rows that are no shard or bucket.
WITHIN, LEADING = -1, -2

COLUMNS = ("doc_id", "mark", "data")
NAMED = "shard int, block int, hashes binary, times binary"
REPEATED = "block int, hashes binary, frequent binary, n bigint"
SUFFIXES = "bucket int, block int, bytes binary, sizes binary, anchors binary, doc binary, mark binary, start binary"
MARKED = "block int, doc binary, mark binary, start binary, stop binary"

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    """An odd 64-bit number per byte value, by a fixed rule."""
    x = np.arange(1, 257, dtype=np.uint64) * _STEP
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def gram_hashes(data: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` bytes from every position, by joining hashes of half the size."""
    span, part = 1, values[data]
    out, done = None, 0
    while size:
        if size & 1:
            if out is None:
                out, done = part, span
            else:
                n = len(data) - done - span + 1
                out = out[:n] * _power(span) + part[done:done + n]
                done += span
        size >>= 1
        if size:
            n = len(data) - 2 * span + 1
            part = part[:n] * _power(span) + part[span:span + n]
            span *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    span, part = 1, values
    while 2 * span <= width:
        part = pick(part[:-span], part[span:])
        span *= 2
    n = len(values) - width + 1
    return pick(part[:n], part[width - span:width - span + n])


def anchors(data: np.ndarray, length: int, gram: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are smallest in some string of ``length`` bytes."""
    width = length - gram + 1
    found, hashes = [], []
    n_strings = len(data) - length + 1
    for at in range(0, n_strings, CHUNK):
        n = min(CHUNK, n_strings - at)
        h = gram_hashes(data[at:at + n + length - 1], gram, values)
        edge = np.zeros(width - 1, np.uint64)
        least = np.concatenate([edge, _slide(h, width, np.minimum), edge])
        own = np.nonzero(_slide(least, width, np.maximum) == h)[0]
        found.append(own + at), hashes.append(h[own])
    if len(found) == 1:
        return found[0], hashes[0]
    position, first = np.unique(np.concatenate(found), return_index=True)
    return position, np.concatenate(hashes)[first]


def _string_ranges(
    position: np.ndarray, hashes: np.ndarray, size: int, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor the first and last start of the strings that it is the anchor of."""
    width = length - gram + 1
    n = len(position)
    low, high = position - width + 1, position.copy()
    index = np.arange(n)
    for side in (-1, 1):
        open_, lag = index, 1
        while len(open_):
            other = open_ + side * lag
            inside = (other >= 0) & (other < n)
            open_, other = open_[inside], other[inside]
            inside = np.abs(position[other] - position[open_]) < width
            open_, other = open_[inside], other[inside]
            beats = hashes[other] <= hashes[open_] if side < 0 else hashes[other] < hashes[open_]
            if side < 0:
                low[open_[beats]] = np.maximum(low[open_[beats]], position[other[beats]] + 1)
            else:
                high[open_[beats]] = np.minimum(high[open_[beats]], position[other[beats]] - width)
            open_ = open_[~beats]
            lag += 1
    return np.maximum(low, 0), np.minimum(high, size - length)


# ---------------------------------------------------------------- blocks


def _ordered(docs) -> Iterator[tuple[int, int, int, bytes, bool]]:
    """Row, id, mark and bytes of a block's documents in their order; whether a row only repeats the one before."""
    ids = [NO_ID if v is None else v for v in docs["doc_id"].to_pylist()]
    marks = docs["mark"].to_pylist()
    texts = docs["data"].combine_chunks() if docs.num_rows else []
    before = None
    for row in sorted(range(len(ids)), key=lambda r: (ids[r], marks[r])):
        yield row, ids[row], marks[row], texts[row].as_py(), (ids[row], marks[row]) == before
        before = ids[row], marks[row]


def _copied(copies) -> set[tuple[int, int]]:
    ids = [NO_ID if v is None else v for v in copies["doc_id"].to_pylist()]
    return set(zip(ids, copies["mark"].to_pylist()))


def _pack(values, kind: str) -> bytes:
    return np.asarray(values, kind).tobytes()


def _unpack(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _block_number(bundles) -> int:
    return bundles["block"][0].as_py() if bundles.num_rows else 0


def _naming(length: int, gram: int, n_shards: int):
    values = _byte_values()

    def run(bundles, copies):
        docs = unbundled(bundles, COLUMNS)
        skip = _copied(copies)
        block = _block_number(bundles)
        hashes, leading = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, doc, mark, text, again in _ordered(docs):
            if again or len(text) < length or (doc, mark) in skip:
                continue
            data = np.frombuffer(text, np.uint8)
            position, h = anchors(data, length, gram, values)
            hashes.append(h)
            some = np.argsort(h)[:2]
            leading.append(_leading(data, position[some]).view(np.int64))
        found, times = np.unique(np.concatenate(hashes), return_counts=True)
        rows = []
        within = times > 1
        rows.append((WITHIN, found[within], times[within]))
        lead = np.sort(np.concatenate(leading))
        lead = lead[np.unique(np.linspace(0, len(lead) - 1, SAMPLE).astype(int))] if len(lead) else lead
        rows.append((LEADING, lead, np.empty(0, int)))
        shard = (found % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(shard[order]))[0] + 1) if len(order) else ():
            rows.append((int(shard[part[0]]), found[part], times[part]))
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()),
            "block": pa.array([block] * len(rows), pa.int32()),
            "hashes": pa.array([r[1].tobytes() for r in rows], pa.binary()),
            "times": pa.array([_pack(r[2], "<u4") for r in rows], pa.binary()),
        })

    return run


def _leading(data: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that sorts like them, fitted to signed longs."""
    words = data[position[:, None] + np.arange(8)].view(">u8")[:, 0].astype(np.uint64)
    return words ^ np.uint64(1 << 63)


def _counting(frequent: int):
    def run(table):
        blocks = table["block"].to_pylist()
        sizes = [len(v) // 8 for v in table["hashes"].to_pylist()]
        hashes = _unpack(table["hashes"], "<u8")
        times = _unpack(table["times"], "<u4").astype(np.int64)
        found, number = np.unique(hashes, return_inverse=True)
        total = np.bincount(number, times, len(found)).astype(np.int64)[number]
        rows, at = [], 0
        for block, size in zip(blocks, sizes):
            part = slice(at, at + size)
            many = total[part] > 1
            often = total[part] > frequent
            rows.append((block, hashes[part][many].tobytes(), hashes[part][often].tobytes(), int(times[part][many].sum())))
            at += size
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table({
            name: pa.array(c, k) for name, c, k in zip(("block", "hashes", "frequent", "n"), zip(*rows), kinds)
        })

    return run


class _Out:
    """Suffixes of a block by bucket, each distinct one once, and strings known to repeat an earlier one."""

    def __init__(self, block: int):
        self.block = block
        self.known: dict[bytes, None] = {}
        self.buckets: dict[int, list[list]] = {}

    def add(self, bucket: int, text: bytes, anchor: int, doc: int, mark: int, low: int) -> None:
        key = bytes((anchor,)) + text
        known = key in self.known
        self.known[key] = None
        rows = self.buckets.setdefault(WITHIN if known else bucket, [[], [], [], [], [], []])
        for column, value in zip(rows, (b"" if known else text, len(text), anchor, doc, mark, low)):
            column.append(value)

    def table(self) -> pa.Table:
        n = len(self.buckets)
        packed = [
            (b"".join(r[0]), _pack(r[1], "<u2"), _pack(r[2], "<u2"), _pack(r[3], "<i8"), _pack(r[4], "<i8"), _pack(r[5], "<i8"))
            for r in self.buckets.values()
        ]
        columns = list(zip(*packed)) or [[]] * 6
        return pa.table({
            "bucket": pa.array(list(self.buckets), pa.int32()), "block": pa.array([self.block] * n, pa.int32()),
            **{name: pa.array(c, pa.binary()) for name, c in zip(("bytes", "sizes", "anchors", "doc", "mark", "start"), columns)},
        })


def _dealing(length: int, gram: int, splitters: np.ndarray, n_buckets: int):
    values = _byte_values()

    def run(bundles, listed):
        docs = unbundled(bundles, COLUMNS)
        kinds = np.array(listed["copy"].to_pylist(), bool)
        skip = _copied(listed.filter(pa.array(kinds)))
        answers = listed.filter(pa.array(~kinds))
        repeated_hashes = np.unique(_unpack(answers["hashes"], "<u8"))
        frequent_hashes = np.unique(_unpack(answers["frequent"], "<u8"))
        out = _Out(_block_number(bundles))
        for _, doc, mark, text, again in _ordered(docs):
            if again or len(text) < length or (doc, mark) in skip:
                continue
            data = np.frombuffer(text, np.uint8)
            position, h = anchors(data, length, gram, values)
            low, high = _string_ranges(position, h, len(text), length, gram)
            use = np.nonzero((low <= high) & _among(h, repeated_hashes))[0]
            if not len(use):
                continue
            bucket = np.searchsorted(splitters, _leading(data, position[use]).view(np.int64), "right")
            often = _among(h[use], frequent_hashes)
            for a, lo, hi, where, single in zip(
                position[use].tolist(), low[use].tolist(), high[use].tolist(), bucket.tolist(), often.tolist()
            ):
                if not single:
                    out.add(where, text[lo:hi + length], a - lo, doc, mark, lo)
                    continue
                for p in range(lo, hi + 1):
                    string = text[p:p + length]
                    where = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little") % n_buckets
                    out.add(where, string, a - p, doc, mark, p)
        return out.table()

    return run


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


# ---------------------------------------------------------------- buckets


def equal_runs(buffer: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings at ``starts``: which share all ``length`` bytes and their group, and runs.

    Sorts by one eight-byte word after the other; what is alone in its part is done, what is
    equal so far goes on to the next word.
    """
    active = np.arange(len(starts))
    for at in range(0, length, 8):
        first = min(at, max(length - 8, 0))  # the last word may overlap the one before it
        width = min(8, length)
        word = np.zeros((len(active), 8), np.uint8)
        word[:, 8 - width:] = buffer[starts[active][:, None] + first + np.arange(width)]
        word = word.view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((word, group))
        active, group, word = active[order], group[order], word[order]
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        active, group = active[several], group[several]
        if not len(active):
            break
    return active, group


def _sorting(length: int, gram: int):
    def run(table):
        blocks = np.repeat(
            np.array(table["block"].to_pylist(), np.int64), [len(v) // 2 for v in table["sizes"].to_pylist()]
        )
        sizes = _unpack(table["sizes"], "<u2").astype(np.int64)
        anchor = _unpack(table["anchors"], "<u2").astype(np.int64)
        doc, mark, start = (_unpack(table[c], "<i8") for c in ("doc", "mark", "start"))
        whole = b"".join(table["bytes"].to_pylist())
        begins = np.cumsum(sizes) - sizes
        # of equal suffixes the earliest stands for all: the others start only strings that repeat
        earliest: dict[bytes, int] = {}
        order = np.lexsort((start, mark, doc))
        repeats = []
        grams: dict[bytes, list[int]] = {}
        for i in order.tolist():
            b = int(begins[i])
            key = bytes((int(anchor[i]),)) + whole[b:b + int(sizes[i])]
            if key in earliest:
                repeats.append(i)
            else:
                earliest[key] = i
                at = b + int(anchor[i])
                grams.setdefault(whole[at:at + gram], []).append(i)
        repeats = np.array(repeats, np.int64)
        marked = [(repeats, start[repeats], start[repeats] + sizes[repeats] - length)]
        # only strings that share an anchor with another suffix are left to compare
        several = [members for members in grams.values() if len(members) > 1]
        if several:
            suffix = np.concatenate([np.array(m) for m in several])
            number = np.repeat(np.arange(len(several)), [len(m) for m in several])
            n_strings = sizes[suffix] - length + 1
            owner = np.repeat(np.arange(len(suffix)), n_strings)
            shift = np.arange(len(owner)) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings)
            own = suffix[owner]
            # equal strings have their anchor at one offset
            group = number[owner] * (length + 1) + anchor[own] - shift
            same, runs = equal_runs(np.frombuffer(whole, np.uint8), begins[own] + shift, length, group)
            p, who = start[own[same]] + shift[same], own[same]
            order = np.lexsort((p, mark[who], doc[who], runs))
            first = np.ones(len(order), bool)
            first[1:] = runs[order][1:] != runs[order][:-1]
            later = order[~first]
            marked.append((who[later], p[later], p[later]))
        who, low, high = (np.concatenate(c) for c in zip(*marked))
        order = np.argsort(blocks[who], kind="stable")
        who, low, high = who[order], low[order], high[order]
        parts = np.split(np.arange(len(who)), np.nonzero(np.diff(blocks[who]))[0] + 1) if len(who) else []
        return pa.table({
            "block": pa.array([int(blocks[who[x[0]]]) for x in parts], pa.int32()),
            "doc": pa.array([_pack(doc[who[x]], "<i8") for x in parts], pa.binary()),
            "mark": pa.array([_pack(mark[who[x]], "<i8") for x in parts], pa.binary()),
            "start": pa.array([_pack(low[x], "<i8") for x in parts], pa.binary()),
            "stop": pa.array([_pack(high[x], "<i8") for x in parts], pa.binary()),
        })

    return run


def _within(length: int):
    """Strings that a block knew itself to repeat, as marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stops = [
                (np.frombuffer(s.as_py(), "<i8") + np.frombuffer(n.as_py(), "<u2") - length).astype("<i8").tobytes()
                for s, n in zip(batch.column(3), batch.column(4))
            ]
            yield pa.record_batch([*batch.columns[:4], pa.array(stops, pa.binary())], ["block", "doc", "mark", "start", "stop"])

    return run


# ---------------------------------------------------------------- cutting


def _cutting(length: int, rest: bool, as_text: bool):
    def run(bundles, marks_and_copies):
        docs = unbundled(bundles, (*COLUMNS, "rest"))
        kinds = np.array(marks_and_copies["copy"].to_pylist(), bool)
        skip = _copied(marks_and_copies.filter(pa.array(kinds)))
        marks = marks_and_copies.filter(pa.array(~kinds))
        doc, mark, low, high = (_unpack(marks[c], "<i8") for c in ("doc", "mark_list", "start", "stop"))
        spans: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(doc.tolist(), mark.tolist())):
            spans.setdefault(key, []).append(i)
        rows, out = [], []
        for row, doc_id, mark_, text, again in _ordered(docs):
            key, n = (doc_id, mark_), len(text)
            if (again or key in skip) and n >= length:
                kept, removed, runs = b"", n, 1
            elif key in spans:
                own = np.array(spans[key])
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, low[own], 1)
                np.add.at(edge, high[own] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                removed = int(gone.sum())
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            else:
                kept, removed, runs = text, 0, 0
            rows.append(row)
            digest = hashlib.sha256(kept).hexdigest()
            out.append((n, removed, runs, digest, kept.decode("utf-8", "ignore") if as_text else kept))
        columns = list(zip(*out)) or [[]] * 5
        rows = pa.array(rows, pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary()]
        table = {"doc_id": docs["doc_id"].take(rows)}
        table |= {
            name: pa.array(c, k)
            for name, c, k in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), columns, kinds)
        }
        return pa.table(table | ({"rest": docs["rest"].take(rows)} if rest else {}))

    return run


def cut_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rest: list[str] | None = None, as_text: bool = False
) -> DataFrame:
    """Every row with what is left after removing all bytes covered by a string that starts earlier.

    Columns: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary`` and, if ``rest`` names columns to
    carry along, a struct ``rest``. ``as_text`` gives ``kept`` as a string, without characters that lost some of their
    bytes. A string is ``length`` consecutive bytes of one text (UTF-8, NULL is
    empty). It starts earlier in a smaller ``doc_id`` or further ahead in the same text; strings are judged
    on the input. NULL ids come last, rows that share an id follow each other in the order of a hash of their texts, and rows
    equal in both count as one after the other. Texts shorter than ``length`` stay whole. Other columns are not read.
    """
    if not 8 <= gram <= length <= 150:
        raise ValueError("needs 8 <= gram <= length <= 150")
    n_rows, size = volume(docs)
    n_blocks = block_count(size + n_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n_blocks)).cast("int").alias("block")

    carry = F.struct(*[F.col(f"`{c}`") for c in rest or ()]).alias("rest")

    def blocks(carried: bool) -> DataFrame:
        more = [carry] if carried and rest else []
        rows = docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text, F.lit("content")).alias("mark"),
            text.cast("binary").alias("data"), *more,
        )
        return bundled(rows.select(key, *rows.columns)).groupBy("block")

    facts = stored(digests(docs), "digests")
    firsts = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = attach(facts, stored(firsts, "firsts"), "digest", "n", n_rows)
    copies = copies.filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = stored(copies.select("doc_id", F.col("check").alias("mark")).distinct(), "copies").select(key, "doc_id", "mark")

    n_shards = max(1, size // (SHARD_HASHES * (length - gram) // 2))
    named = stored(
        blocks(False).cogroup(copies.groupBy("block")).applyInArrow(frugal(_naming(length, gram, n_shards)), NAMED), "named"
    )
    counted = named.filter("shard >= 0").groupBy("shard").applyInArrow(_counting(FREQUENT), REPEATED)
    repeated = stored(counted.filter("length(hashes) > 0"), "repeated")

    n_repeated = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(1, int(n_repeated) * (2 * length - gram) // BUCKET_BYTES)
    splitters = _splitters(named, n_buckets)

    nothing = F.lit(None)
    answers = repeated.select(
        "block", F.lit(False).alias("copy"), nothing.cast("bigint").alias("doc_id"), nothing.cast("bigint").alias("mark"),
        "hashes", "frequent",
    ).unionByName(copies.select(
        "block", F.lit(True).alias("copy"), "doc_id", "mark",
        nothing.cast("binary").alias("hashes"), nothing.cast("binary").alias("frequent"),
    ))
    suffixes = stored(
        blocks(False).cogroup(answers.groupBy("block")).applyInArrow(frugal(_dealing(length, gram, splitters, n_buckets)), SUFFIXES),
        "suffixes",
    )
    marks = suffixes.filter("bucket >= 0").groupBy("bucket").applyInArrow(_sorting(length, gram), MARKED)
    within = suffixes.filter(F.col("bucket") == WITHIN).select("block", "doc", "mark", "start", "sizes")
    marks = stored(marks.unionByName(within.mapInArrow(_within(length), MARKED)), "marks")

    cuts = marks.select(
        "block", F.lit(False).alias("copy"), nothing.cast("bigint").alias("doc_id"), nothing.cast("bigint").alias("mark"),
        "doc", F.col("mark").alias("mark_list"), "start", "stop",
    ).unionByName(copies.select(
        "block", F.lit(True).alias("copy"), "doc_id", "mark",
        *[nothing.cast("binary").alias(c) for c in ("doc", "mark_list", "start", "stop")],
    ))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
    ])
    if rest:
        schema = schema.add("rest", docs.select(carry).schema["rest"].dataType)
    return blocks(True).cogroup(cuts.groupBy("block")).applyInArrow(frugal(_cutting(length, bool(rest), as_text)), schema)


def _splitters(named: DataFrame, n_buckets: int) -> np.ndarray:
    """Bounds that divide the sampled leading words into equal shares: one number per bucket."""
    if n_buckets == 1:
        return np.empty(0, np.int64)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_unpack(pa.chunked_array([batch.column(0)]), "<i8"))], ["word"])

    sample = named.filter(F.col("shard") == LEADING).select("hashes").mapInArrow(words, "word bigint")
    shares = [k / n_buckets for k in range(1, n_buckets)]
    bounds = sample.agg(F.percentile_approx("word", shares, max(10_000, 10 * n_buckets))).first()[0]
    return np.unique(np.array(bounds or [], np.int64))


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the remaining text of every row; ``n_chars``, if there is one, counts it anew.

    A character that a cut leaves without some of its bytes goes as a whole.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    texts = cut_repeats(docs, length, rest=others, as_text=True)
    count = F.length("kept").cast("bigint")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": count} | {
        c: F.col(f"rest.`{c}`") for c in others if c != "n_chars"
    }
    return texts.select(*[columns[c].alias(c) for c in docs.columns])
