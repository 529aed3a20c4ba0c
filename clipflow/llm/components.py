"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import attach, stored


def _edges(df: DataFrame) -> DataFrame:
    return stored(df.filter("u <> v").distinct(), "edges")


def _star(both: DataFrame, total: int) -> DataFrame:
    """Per node the smallest of its neighbours and itself, attached to its edges."""
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return attach(both, stored(least, "least"), "u", "n", total)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``u, v``); the root is the component's smallest node.

    Nodes with very many edges are joined through ``attach``. Every round is written to the shared
    folder. Loops and repeated edges are ignored; no edges give no rows.
    """
    edges = _edges(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _edges(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        # now u > v: every node's smaller neighbours meet at the smallest of them
        small = _star(large, large.count())
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = _edges(linked.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: u is the root of v
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
