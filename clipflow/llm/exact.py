"""Exact deduplication over a sharded cuckoo-filter index of live digests.

A shard holds a cuckoo filter of 16-bit fingerprints and, in buckets beside it, the
content key of every live digest: the whole SHA-256, the byte length and a second
64-bit hash of the text. An offered digest that the filter does not know is new. A hit
is checked against the content keys of its bucket, so false positives of the filter
never decide. When an insertion finds no place, the shard's filter is built anew with
twice the buckets from the stored keys. Deletion takes a fingerprint out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import attach, fresh, if_small, stored

#: Slots of a filter bucket, and moves before an insertion counts as overflow.
SLOTS = 4
MAX_MOVES = 200
#: Digests that a shard of the index holds on average.
SHARD_KEYS = 50_000
#: Partial groups per digest before the shards see them: bounds what a hot digest sends.
SPREAD = 16

OFFERS = "shard int, digest binary, n_bytes bigint, check bigint, doc_id bigint, copies bigint"
OUTCOME = "digest binary, n_bytes bigint, check bigint, keep_id bigint, group_size bigint"


class CuckooFilter:
    """Partial-key cuckoo filter over byte digests, with deletion."""

    def __init__(self, n_buckets: int = 64):
        self.n = n_buckets  # a power of two
        self.slots = [[] for _ in range(n_buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & (self.n - 1)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a] or mark in self.slots[b]

    def insert(self, digest: bytes) -> bool:
        """False on overflow; one stored mark is then without a place and the filter is to be rebuilt."""
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return True
        bucket = b
        for move in range(MAX_MOVES):
            row = self.slots[bucket]
            mark, row[move % SLOTS] = row[move % SLOTS], mark
            bucket = self._other(bucket, mark)
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if mark in self.slots[bucket]:
                self.slots[bucket].remove(mark)
                return True
        return False


class Shard:
    """Filter and content keys of one shard of the index."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.content: dict[int, list[list]] = {}  # bucket -> [digest, n_bytes, check, live id, copies]
        self.n_keys = 0

    def _bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:12], "little")

    def find(self, digest: bytes, n_bytes: int, check: int) -> list | None:
        if digest not in self.filter:
            return None
        for entry in self.content.get(self._bucket(digest), ()):
            if entry[0] == digest and entry[1] == n_bytes and entry[2] == check:
                return entry
        return None

    def offer(self, digest: bytes, n_bytes: int, check: int, doc_id: int | None, copies: int) -> None:
        """Count the copies; the largest id becomes the live one."""
        entry = self.find(digest, n_bytes, check)
        if entry is None:
            self._insert([digest, n_bytes, check, doc_id, copies])
            return
        copies += entry[4]
        if doc_id is not None and (entry[3] is None or doc_id > entry[3]):
            self.retract(digest, n_bytes, check)
            self._insert([digest, n_bytes, check, doc_id, copies])
        else:
            entry[4] = copies

    def retract(self, digest: bytes, n_bytes: int, check: int) -> bool:
        """Take a live digest out of the filter and the stored keys."""
        entry = self.find(digest, n_bytes, check)
        if entry is None:
            return False
        self.filter.delete(digest)
        bucket = self.content[self._bucket(digest)]
        bucket.remove(entry)
        if not bucket:
            del self.content[self._bucket(digest)]
        self.n_keys -= 1
        return True

    def _insert(self, entry: list) -> None:
        self.content.setdefault(self._bucket(entry[0]), []).append(entry)
        self.n_keys += 1
        if not self.filter.insert(entry[0]):
            self._resize()

    def _resize(self) -> None:
        n = self.filter.n
        fits = False
        while not fits:
            n *= 2
            self.filter = CuckooFilter(n)
            fits = all(self.filter.insert(e[0]) for e in self.entries())

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and content key of every row; a NULL text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.xxhash64(text, F.lit("content")).alias("check"),
    )


def _rows(shard: Shard) -> pa.Table:
    columns = list(zip(*shard.entries())) or [[]] * 5
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["digest", "n_bytes", "check", "keep_id", "group_size"]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def update_index(index: DataFrame | None, offers: DataFrame, retracted: DataFrame | None = None) -> DataFrame:
    """The live digests after deleting ``retracted`` from ``index`` and inserting ``offers``.

    ``index`` and the result have one row per live digest (``OUTCOME``), ``offers`` has
    ``OFFERS``; ``retracted`` needs ``shard, digest, n_bytes, check``. Every shard is one group of a
    bounded number of distinct digests, held by its own filter.
    """
    empty = F.lit(None).cast("bigint")
    rows = offers.select("shard", F.lit(2).alias("step"), "digest", "n_bytes", "check", "doc_id", "copies")
    if index is not None:
        rows = rows.unionByName(index.select(
            "shard", F.lit(0).alias("step"), "digest", "n_bytes", "check",
            F.col("keep_id").alias("doc_id"), F.col("group_size").alias("copies"),
        ))
    if retracted is not None:
        rows = rows.unionByName(retracted.select(
            "shard", F.lit(1).alias("step"), "digest", "n_bytes", "check", empty.alias("doc_id"), empty.alias("copies")
        ))

    def run(key, table):
        shard = Shard()
        table = table.sort_by([("step", "ascending"), ("doc_id", "ascending")])
        for step, digest, n_bytes, check, doc_id, copies in zip(*(table[c].to_pylist() for c in (
            "step", "digest", "n_bytes", "check", "doc_id", "copies"
        ))):
            if step == 1:
                shard.retract(digest, n_bytes, check)
            else:
                shard.offer(digest, n_bytes, check, doc_id, copies)
        return _rows(shard)

    return rows.groupBy("shard").applyInArrow(run, OUTCOME)


def with_shard(df: DataFrame, n_shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int"))


def exact_groups(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Every row with its group of identical texts; the largest ``doc_id`` of a group stays.

    Columns: ``doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal when their
    bytes are; NULL counts as the empty text, which is a text like any other. Rows that repeat a ``doc_id`` and
    a text count as copies and are all marked as kept if theirs is the largest id. A NULL id ranks below
    every id; where a group has no other, all its rows are kept. Other columns are not read.
    """
    facts = stored(digests(docs), "digests")
    total = facts.count()
    n_shards = max(1, -(-total // shard_keys))
    partial = (
        facts.groupBy("digest", "n_bytes", "check", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).alias("part"))
        .agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        .drop("part")
    )
    groups = stored(update_index(None, with_shard(partial, n_shards)).select("digest", "keep_id", "group_size"), "live")
    return attach(facts, groups, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row per text: the one with the largest ``doc_id``, all columns as they were.

    Of rows that repeat both id and text one stays. Rows without an id go only if another row of the
    text has one or is such a row too.
    """
    own = fresh(docs, "_sha")
    groups = stored(exact_groups(docs), "groups")
    marked = groups.select("doc_id", F.col("text_sha256").alias(own), "kept")
    gone = stored(marked.filter(~F.col("kept")).drop("kept").distinct(), "gone")
    again = stored(marked.filter("kept").groupBy("doc_id", own).count().filter("count > 1").drop("count"), "again")
    if gone.count() == 0 and again.count() == 0:
        return docs
    tagged = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256))
    gone, again = if_small(gone), if_small(again)
    same = [F.col("_d.doc_id").eqNullSafe(F.col("_g.doc_id")), F.col(f"_d.{own}") == F.col(f"_g.{own}")]
    left = tagged.alias("_d").join(gone.alias("_g"), same, "left_anti")
    single = left.alias("_d").join(again.alias("_g"), same, "left_anti")
    repeated = left.alias("_d").join(again.alias("_g"), same, "left_semi").dropDuplicates(["doc_id", own])
    return single.unionByName(repeated).drop(own)
