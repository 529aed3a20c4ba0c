"""Near-duplicate documents by SimHash with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints at most
three bits apart, one segment differs in at most one bit. Every distinct fingerprint is
indexed under each segment as it is and under its 32 variants with one bit taken out:
equal segments meet under the first, segments one bit apart under one of the variants.
Fingerprints that meet are verified over all 64 bits. Links are kept as a spanning
forest per bucket, never as all pairs of it, and joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import attach, drop_rows, stored, text_bytes, text_digest
from .components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Fingerprints of one bucket that are compared pair by pair. More go to ``_crowded``, which is linear.
PAIRWISE = 4096
#: Entries of the index that a task compares at a time.
CHUNK = 200_000

FINGERPRINTS = "doc_id bigint, fp bigint, digest binary"
MEETINGS = "crowded boolean, u bigint, v bigint"


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text; 64 bits, unsigned."""
    import xxhash

    words = data.lower().split()  # bytes: only A-Z and only the six ASCII separators
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    stops = ends[width - 1:].tolist()
    hash64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash64(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        rows = hashes[at:at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, digest`` of every row, the fingerprint as a signed long, the digest SHA-256 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "digest"])

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes(), text_digest()).mapInArrow(run, FINGERPRINTS)


def _index(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of all index entries: per segment the whole and 32 variants."""
    keys = []
    for segment, part in enumerate((fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))):
        for gap in range(33):
            mask = 0xFFFFFFFF ^ (1 << gap - 1 if gap else 0)
            keys.append((part & np.uint64(mask)) | np.uint64((segment * 33 + gap) << 32))
    return np.concatenate(keys), np.tile(fps, 66)


def _segment(fps: np.ndarray, keys: np.ndarray) -> np.ndarray:
    upper = (keys >> np.uint64(32)) < 33
    return np.where(upper, fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))


def _forest(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of verified links inside runs of equal keys (sorted)."""
    segment = _segment(fps, keys)
    gapped = ((keys >> np.uint64(32)) % np.uint64(33)) > 0
    label = np.arange(len(keys))
    active = np.nonzero(keys[1:] == keys[:-1])[0]
    lag = 1
    while len(active):
        p, q = active, active + lag
        # equal segments are compared where no bit is taken out, and only there
        meant = ~gapped[p] | (segment[p] != segment[q])
        p, q = p[meant], q[meant]
        near = np.bitwise_count(fps[p] ^ fps[q]) <= max_bits
        _union(label, p[near], q[near])
        lag += 1
        active = active[active + lag < len(keys)]
        active = active[keys[active] == keys[active + lag]]
    linked = np.nonzero(label != np.arange(len(keys)))[0]
    return fps[linked], fps[label[linked]]


def _union(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    while len(p):
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, nxt := label[label]):
            label[:] = nxt


def _meet(batches: Iterator[pa.RecordBatch], max_bits: int, pairwise: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of every bucket; members of crowded buckets leave as (key, fingerprint)."""
    held_keys, held = [], []

    def out(crowded: bool, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(np.full(len(u), crowded)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))],
            ["crowded", "u", "v"],
        )

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        keys, fps = np.concatenate(held_keys), np.concatenate(held)
        held_keys.clear(), held.clear()
        cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        if not last and len(keys) - cut > pairwise and crowding[0] != keys[-1]:
            crowding[0] = keys[-1]
        starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        size = np.repeat(np.diff(starts), np.diff(starts))
        many = (size > pairwise) | (keys == crowding[0]) if crowding[0] is not None else size > pairwise
        done = many | (np.arange(len(keys)) < cut)
        if many.any():
            yield out(True, keys[many], fps[many])
        yield out(False, *_forest(keys[done & ~many], fps[done & ~many], max_bits))
        if not done.all():
            held_keys.append(keys[~done]), held.append(fps[~done])

    crowding = [None]
    for batch in batches:
        held_keys.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        held.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, held)) >= CHUNK:
            yield from flush(False)
    if held:
        yield from flush(True)


def _crowded(members: DataFrame, max_bits: int) -> DataFrame:
    """Edges inside buckets of any size, in time linear in their members.

    Members of a bucket agree in one segment up to its gap. They are grouped by that segment's
    value and by the other segment with every choice of as many bits taken out as may still
    differ; all of such a group are linked, so each is tied to the group's smallest.
    """
    # under a gap one bit differs already and the rest may differ in one bit less
    tables = {gap: np.array(
        [0xFFFFFFFF ^ sum(1 << b for b in bits) for bits in combinations(range(32), max_bits - gap)], np.uint64
    ) for gap in (0, 1)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for key, fp in zip(keys, fps):
                gap = int((int(key) >> 32) % 33 > 0)
                other = np.uint64(int(fp) & 0xFFFFFFFF if (int(key) >> 32) < 33 else int(fp) >> 32)
                n = len(tables[gap])
                yield pa.record_batch([
                    pa.array(np.full(n, key).view(np.int64)), pa.array(np.arange(n)),
                    pa.array((tables[gap] & other).view(np.int64)), pa.array(np.full(n, fp).view(np.int64)),
                ], ["key", "mask", "rest", "fp"])

    wide = members.mapInArrow(spread, "key bigint, mask bigint, rest bigint, fp bigint")
    least = wide.groupBy("key", "mask", "rest").agg(F.min("fp").alias("m"), F.max("fp").alias("top"))
    # a second pass ties every member to the smallest of each of its groups
    least = least.filter("m <> top").drop("top")
    return wide.join(least, ["key", "mask", "rest"]).filter("fp <> m").select(
        F.col("fp").alias("u"), F.col("m").alias("v")
    ).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints (column ``fp``) that connect all within ``max_bits`` (1 to 3).

    An edge says that its ends are connected, by a link or a chain of them.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("two segments serve distances of 1 to 3 bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = _index(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(values.view(np.int64))], ["key", "fp"])

    entries = fps.select("fp").mapInArrow(spread, "key bigint, fp bigint")
    met = entries.repartition("key").sortWithinPartitions("key").mapInArrow(
        lambda batches: _meet(batches, max_bits, pairwise), MEETINGS
    )
    met = stored(met, "meetings")
    members = met.filter("crowded").select("u", "v")
    edges = met.filter(~F.col("crowded")).select("u", "v")
    return edges.unionByName(_crowded(members, max_bits)) if members.take(1) else edges


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE
) -> DataFrame:
    """Every row with its fingerprint and the smallest ``doc_id`` reachable over links.

    Columns: ``doc_id, fingerprint, component_id``. A fingerprint bit is set if it is in over half of the
    XXH64 values (seed 42) of the word shingles, repeats included; texts of fewer words are one shingle. NULL
    and empty texts have fingerprint zero and link like others. Rows that repeat an id are rows of their own. NULL
    ids are never the smallest unless the component has no other. Other columns are not read.
    """
    return _grouped(docs, shingle, max_bits, pairwise).drop("digest")


def _grouped(docs: DataFrame, shingle: int, max_bits: int, pairwise: int = PAIRWISE) -> DataFrame:
    """What ``near_groups`` says, and the ``digest`` of each row's text."""
    facts = stored(fingerprints(docs, shingle), "fingerprints")
    total = facts.count()
    groups = stored(facts.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = stored(components(links(groups, max_bits, pairwise)), "roots")
    rooted = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    named = attach(rooted, stored(least, "least"), "root", "m", groups.count()).select("fp", "n", "component_id")
    return attach(facts, stored(named, "named"), "fp", "n", total).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "digest"
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows whose ``doc_id`` is the smallest of their component, all columns as they were.

    Rows that share an id each follow their own text. Rows without an id stay where their component has no id.
    """
    groups = _grouped(docs, shingle, max_bits)
    gone = stored(groups.filter("not doc_id <=> component_id").select("doc_id", "digest"), "gone")
    return drop_rows(docs, gone, {"doc_id": F.col("doc_id").cast("bigint"), "digest": text_digest()})
