"""Ordered per-key work and lookups that survive one key holding most rows.

A plain window puts every row of a key into one task. Here the few heaviest keys
are found first; only their rows are cut into contiguous slices, each slice is
scanned on its own, and what the earlier slices of the key contribute is added
from a small table. Which keys are sliced decides speed only, never results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import HOT_ROWS, scratch_path, setting

#: The heaviest keys that are treated. Any other key holds under 1/10000 of the rows.
MAX_HOT_KEYS = 10_000
#: Upper bound on slices over all hot keys; also bounds every table broadcast here.
MAX_SLICES = 16_384

SLICE = "_slice"
SALT = "_salt"

HotKeys = dict

#: Profiles remembered per process.
MAX_PROFILES = 256
_known: dict[tuple, HotKeys] = {}


def hot_keys(df: DataFrame, key: str, weight: int = 1) -> HotKeys:
    """The heaviest keys above the row threshold with their counts, each row counted as ``weight`` of them.

    One pass over the key column with map-side counts; at most ``MAX_HOT_KEYS``
    rows reach the driver. The answer is kept for the session: if the data has
    changed since, work is balanced less well and results stay the same.
    """
    spark = df.sparkSession
    limit = setting(spark, HOT_ROWS)
    keys = df.select(key)
    asked = (spark.sparkContext.applicationId, keys.semanticHash(), key, limit, weight)
    if asked not in _known:
        heaviest = (
            keys.groupBy(key).count()
            .filter((F.col("count") * weight > limit) & F.col(key).isNotNull())
            .orderBy(F.desc("count"), key)
            .limit(MAX_HOT_KEYS)
        )
        if len(_known) >= MAX_PROFILES:
            _known.clear()
        _known[asked] = {row[0]: row[1] * weight for row in heaviest.collect()}
    return dict(_known[asked])


def is_hot(key: str, hot: HotKeys) -> Column:
    return F.coalesce(F.col(key).isin(list(hot)), F.lit(False))


def split_hot(df: DataFrame, key: str, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    return df.filter(~is_hot(key, hot)), df.filter(is_hot(key, hot))


def lookup(
    facts: DataFrame, dim: DataFrame, key: str, hot: HotKeys, how: str = "left", on: tuple[str, ...] = ()
) -> DataFrame:
    """Join facts to attributes of which there are one or a few rows per key, or per key and the columns ``on``.

    Whether the small side is broadcast is left to Spark, which knows its size;
    when it is shuffled, rows of hot keys spread over as many tasks as they need.
    """
    if not hot:
        return facts.join(dim, [key, *on], how)
    salts = _salts(facts, key, hot)
    values = [c for c, kind in facts.dtypes if c != key and not kind.startswith(("array", "map", "struct", "binary"))]
    spread = F.pmod(F.xxhash64(*values), salts).cast("int") if values else F.lit(0)
    copies = F.explode(F.sequence(F.lit(0), _salts(facts, key, hot) - 1))
    salted = facts.withColumn(SALT, spread)
    return salted.join(dim.withColumn(SALT, copies), [key, *on, SALT], how).drop(SALT)


def _salts(facts: DataFrame, key: str, hot: HotKeys) -> Column:
    """Tasks a key's rows are spread over: by its own count, in powers of two; one for keys that are not hot."""
    rows = setting(facts.sparkSession, HOT_ROWS)
    steps: dict[int, list] = {}
    for value, count in hot.items():
        steps.setdefault(1 << max(1, math.ceil(math.log2(count / rows))), []).append(value)
    salts = F.lit(1)
    for n, keys in sorted(steps.items()):
        salts = F.when(F.col(key).isin(keys), n).otherwise(salts)
    return F.coalesce(salts, F.lit(1))


def running_totals(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    before: dict[str, Column],
    total: dict[str, Column] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Sums over the earlier rows of the key, and sums over the whole key."""
    total = total or {}
    hot = hot_keys(df, key) if hot is None else hot
    if not hot:
        earlier = _earlier(Window.partitionBy(key).orderBy(*order))
        whole = Window.partitionBy(key)
        return df.withColumns(
            {name: F.coalesce(F.sum(v).over(earlier), F.lit(0).cast("bigint")) for name, v in before.items()}
            | {name: F.sum(v).over(whole) for name, v in total.items()}
        )

    cold_rows, hot_rows = split_hot(df, key, hot)
    sliced = _slice(hot_rows, key, order, hot)
    earlier = _earlier(Window.partitionBy(key, SLICE).orderBy(*order))
    slices = sliced.groupBy(key, SLICE).agg(
        *[F.sum(v).alias(name) for name, v in before.items()],
        *[F.sum(v).alias(name) for name, v in total.items()],
    )
    prior = _earlier(Window.partitionBy(key).orderBy(SLICE))
    carried = slices.select(
        key,
        SLICE,
        *[F.coalesce(F.sum(name).over(prior), F.lit(0)).alias(f"_c_{name}") for name in before],
        *[F.sum(name).over(Window.partitionBy(key)).alias(f"_c_{name}") for name in total],
    )
    local = sliced.withColumns(
        {name: F.coalesce(F.sum(v).over(earlier), F.lit(0).cast("bigint")) for name, v in before.items()}
    )
    # carried has one row per slice, at most MAX_SLICES + MAX_HOT_KEYS of them
    joined = local.join(F.broadcast(carried), [key, SLICE])
    numbered = joined.withColumns(
        {name: F.col(name) + F.col(f"_c_{name}") for name in before}
        | {name: F.col(f"_c_{name}") for name in total}
    ).drop(SLICE, *[f"_c_{name}" for name in [*before, *total]])
    return running_totals(cold_rows, key, order, before, total, hot={}).unionByName(numbered)


def number_rows(df: DataFrame, key: str, order: Sequence[str], out: str, hot: HotKeys | None = None) -> DataFrame:
    """0-based position of each row within its key."""
    hot = hot_keys(df, key) if hot is None else hot
    if not hot:
        position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return df.withColumn(out, position.cast("bigint") - 1)
    return running_totals(df, key, order, {out: F.lit(1).cast("bigint")}, hot=hot)


def carry_forward(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str, hot: HotKeys | None = None
) -> DataFrame:
    """The latest non-NULL value of the key up to and including each row."""
    hot = hot_keys(df, key) if hot is None else hot
    latest = F.last(value, ignorenulls=True)
    if not hot:
        return df.withColumn(out, latest.over(_up_to_here(Window.partitionBy(key).orderBy(*order))))

    cold_rows, hot_rows = split_hot(df, key, hot)
    sliced = _slice(hot_rows, key, order, hot)
    seen = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = sliced.groupBy(key, SLICE).agg(F.max_by(value, seen).alias("_end"))
    carried = ends.select(
        key, SLICE,
        F.last("_end", ignorenulls=True).over(_earlier(Window.partitionBy(key).orderBy(SLICE))).alias("_carried"),
    )
    local = sliced.withColumn(out, latest.over(_up_to_here(Window.partitionBy(key, SLICE).orderBy(*order))))
    # carried has one row per slice, at most MAX_SLICES + MAX_HOT_KEYS of them
    filled = (
        local.join(F.broadcast(carried), [key, SLICE])
        .withColumn(out, F.coalesce(out, "_carried"))
        .drop(SLICE, "_carried")
    )
    return carry_forward(cold_rows, key, order, value, out, hot={}).unionByName(filled)


def _slices(df: DataFrame, hot: HotKeys) -> int:
    rows = setting(df.sparkSession, HOT_ROWS)
    return max(2, min(MAX_SLICES, math.ceil(sum(hot.values()) / rows) * 2))


def _slice(rows: DataFrame, key: str, order: Sequence[str], hot: HotKeys) -> DataFrame:
    """Cut the rows of hot keys into contiguous slices.

    The range shuffle draws its bounds from a sample, so its outcome is written to
    the shared folder once; every later reader, and every retry, sees one division.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "slices")
    (
        rows.repartitionByRange(_slices(rows, hot), key, *order)
        .withColumn(SLICE, F.spark_partition_id())
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def _earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _up_to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
