"""What the operators share: written intermediates, joins with hot keys, row drops, blocks."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot when it holds more than this share of all rows, so at most 1,000 keys are.
HOT_SHARE = 1000
#: Ids that may be broadcast: 8 MB of them. More go through a shuffled join.
MAX_BROADCAST_IDS = 1_000_000
#: UTF-8 bytes of text that one block of documents holds on average.
BLOCK_BYTES = 12_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, so that lost executors cost no recomputation of earlier steps,
    and fixes one outcome of the work for every later reader.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")  # what the write has shuffled is of no use after it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def attach(facts: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of facts to one row per key, whatever share of the facts a key holds.

    ``groups`` has how many of the ``total`` facts hold each key in ``size``. Keys above
    ``1 / HOT_SHARE`` of them are broadcast, which the share bounds to ``HOT_SHARE``
    rows; the others join by a shuffle, each at most that share. Both sides are
    read more than once and should be stored tables.
    """
    limit = max(1, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > limit)
    cold = groups.filter(F.col(size) <= limit)
    few = facts.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return facts.join(F.broadcast(hot), key).unionByName(few)


def text_digest() -> Column:
    """SHA-256 of a text, NULL as the empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def drop_rows(df: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows whose keys are not together in a row of the stored table ``dropped``; NULL equals NULL.

    ``keys`` says per column of ``dropped`` what it is compared with in ``df``.
    """
    tagged, own = df, {}
    for column, value in keys.items():
        own[column] = fresh(tagged, f"_{column}")
        tagged = tagged.withColumn(own[column], value)
    gone = if_small(dropped.select(*keys).distinct())
    same = [F.col(f"_d.{mark}").eqNullSafe(F.col(f"_g.{column}")) for column, mark in own.items()]
    return tagged.alias("_d").join(gone.alias("_g"), same, "left_anti").drop(*own.values())


def if_small(keys: DataFrame, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Marked for broadcast if counted to be at most ``limit`` rows, else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, NULL as none."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def volume(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def block_count(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the bytes make: grows with the data, so that a block does not."""
    return max(1, -(-n_bytes // block_bytes))


def block_of(columns: Sequence[str | Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def bundled(df: DataFrame, key: str = "block") -> DataFrame:
    """``df`` with the rows that a task has of a key packed into few: ``key, bundle binary``.

    A bundle is a compressed Arrow stream, about half as large in a shuffle as the rows would be.
    """
    columns = [c for c in df.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rest = batch.select(columns)
            order = np.argsort(keys, kind="stable")
            found, bundles = [], []
            for rows in np.split(order, np.nonzero(np.diff(keys[order]))[0] + 1) if len(order) else ():
                sink = pa.BufferOutputStream()
                part = rest.take(pa.array(rows))
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_batch(part)
                found.append(keys[rows[0]]), bundles.append(sink.getvalue().to_pybytes())
            yield pa.record_batch([pa.array(found, pa.int32()), pa.array(bundles, pa.binary())], [key, "bundle"])

    return df.select(key, *[f"`{c}`" for c in columns]).mapInArrow(run, f"{key} int, bundle binary")


def frugal(run):
    """``run`` for cogroups, giving memory that Arrow has freed back to the system after each."""

    def wrapped(left, right):
        out = run(left, right)
        pa.default_memory_pool().release_unused()
        return out

    return wrapped


def unbundled(table: pa.Table, columns: Sequence[str]) -> pa.Table:
    """The rows of bundles; without any an empty table of these columns."""
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in table["bundle"]]
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.null()) for c in columns})


def worker_store() -> dict:
    """A dictionary that outlives tasks in a reused Python worker, for caches and loaded models."""
    return sys.modules.setdefault("_clipflow_worker_store", types.ModuleType("store")).__dict__
