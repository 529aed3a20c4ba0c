"""Nearest neighbours by largest inner product: vantage-point trees, one per shard of the vectors.

Vectors get one more component that brings all to one length, so that a larger inner product with a query is a
smaller distance from it, and the triangle inequality can prune. A subtree is left out when
its distance from the query, times ``factor``, exceeds the distance of the worst neighbour found so far: with factor
one nothing that could belong to the result is left out; larger factors prune more and may miss some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

#: Vectors of a shard on average, of a leaf at most, and queries of a block at most.
SHARD_ROWS = 20_000
LEAF_ROWS = 256
QUERY_BLOCK = 512
FACTOR = 1.0
#: Rounding allowance of distances between vectors of length one.
SLACK = 1e-6

INDEX = "shard int, dim int, n int, ids binary, vectors binary, nodes binary"
FOUND = "query_id bigint, vec_id bigint, score double"


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id, dim, data`` (little-endian doubles) of every usable row.

    Rows take no part if the id or vector is NULL or the vector is empty, zero, or holds NULL, NaN or an infinity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or not value or None in value:
                    continue
                row = np.array(value, np.float64)
                if np.isfinite(row).all() and row.any():
                    rows.append((vec_id, len(row), row.astype("<f8").tobytes()))
            columns = list(zip(*rows)) or [[]] * 3
            kinds = [pa.int64(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["vec_id", "dim", "data"])

    return table.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(
        run, "vec_id bigint, dim int, data binary"
    )


def _reach(x: np.ndarray, length: float) -> np.ndarray:
    """Vectors scaled and completed to length one."""
    scaled = x / length
    return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))])


def build(x: np.ndarray, ids: np.ndarray, length: float, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Row order and nodes ``(begin, end, middle, near low, near high, far low, far high)`` of a tree over ``x``.

    A node's first row is its vantage point; rows up to ``middle`` are the nearer half. A leaf has ``middle`` 0.
    Halves are cut by rank, so that repeated vectors are divided too.
    """
    points = _reach(x, length)
    order = np.argsort(ids, kind="stable")
    nodes: list[tuple] = []
    todo = [(0, len(x))]
    while todo:
        begin, end = todo.pop()
        if end - begin <= leaf_rows:
            nodes.append((begin, end, 0, 0, 0, 0, 0))
            continue
        rows = order[begin:end]
        # the row farthest from the first lies at the edge and tells the others apart
        edge = int(np.argmax(((points[rows] - points[rows[0]]) ** 2).sum(axis=1)))
        rows[[0, edge]] = rows[[edge, 0]]
        d = np.sqrt(((points[rows[1:]] - points[rows[0]]) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        order[begin + 1:end] = rows[1:][by]
        d = d[by]
        half = len(d) // 2
        middle = begin + 1 + half
        nodes.append((begin, end, middle, d[0], d[half - 1], d[half], d[-1]))
        todo += [(begin + 1, middle), (middle, end)]
    return order, np.array(nodes, np.float64).reshape(-1, 7)


def scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component after component."""
    out = np.zeros((len(queries), len(x)))
    for q, v in zip(queries.T, x.T):
        out += q[:, None] * v[None, :]
    return out


class Search:
    """The ``k`` best rows of one tree for a block of queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, nodes: np.ndarray, length: float, k: int, factor: float):
        self.x, self.ids, self.length, self.k, self.factor = x, ids, length, k, factor
        self.nodes = {(int(n[0]), int(n[1])): n for n in nodes}
        self.visited = 0

    def __call__(self, queries: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.q, self.q_ids = queries, query_ids
        self.q_length = np.sqrt((queries * queries).sum(axis=1))
        self.best = np.full((len(queries), self.k), -np.inf)
        self.who = np.full((len(queries), self.k), np.iinfo(np.int64).max)
        if len(self.x):
            self._visit(0, len(self.x), np.arange(len(queries)))
        return self.best, self.who

    def _distance(self, score: np.ndarray, own: np.ndarray) -> np.ndarray:
        score = np.maximum(score, -self.length * self.q_length[own])
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * score / (self.length * self.q_length[own])))

    def _offer(self, own: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Scores of some rows by one matrix product; those that may belong to the result are summed again in order."""
        rough = self.q[own] @ self.x[begin:end].T
        self.visited += rough.size
        ids = self.ids[begin:end]
        margin = 1e-10 * self.length * self.q_length[own]
        row, column = np.nonzero(rough >= (self.best[own, -1] - margin)[:, None])
        other = ids[column] != self.q_ids[own[row]]
        row, column = row[other], column[other]
        if not len(row):
            return rough
        who, place = own[row], ids[column]
        exact = np.zeros(len(row))
        for q, v in zip(self.q.T, self.x.T):
            exact += q[who] * v[begin + column]
        better = (exact > self.best[who, -1]) | ((exact == self.best[who, -1]) & (place < self.who[who, -1]))
        who, place, exact = who[better], place[better], exact[better]
        if not len(who):
            return rough
        changed = np.unique(who)
        who = np.concatenate([np.repeat(changed, self.k), who])
        exact = np.concatenate([self.best[changed].ravel(), exact])
        place = np.concatenate([self.who[changed].ravel(), place])
        order = np.lexsort((place, -exact, who))
        first = np.searchsorted(who[order], changed)
        kept = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.best[changed] = exact[kept].reshape(-1, self.k)
        self.who[changed] = place[kept].reshape(-1, self.k)
        return rough

    def _visit(self, begin: int, end: int, own: np.ndarray) -> None:
        _, _, middle, near_low, near_high, far_low, far_high = self.nodes[begin, end]
        if not middle:
            self._offer(own, begin, end)
            return
        d = self._distance(self._offer(own, begin, begin + 1)[:, 0], own)
        middle = int(middle)
        near = np.maximum(0.0, np.maximum(d - near_high, near_low - d))
        far = np.maximum(0.0, np.maximum(d - far_high, far_low - d))
        halves = [(begin + 1, middle, near), (middle, end, far)]
        if (far < near).sum() * 2 > len(own):  # first where most queries lie
            halves.reverse()
        for a, b, bound in halves:
            limit = self._distance(self.best[own, -1], own)
            limit[np.isneginf(self.best[own, -1])] = np.inf
            left = bound * self.factor <= limit + SLACK
            if left.any():
                self._visit(a, b, own[left])


def index(usable: DataFrame, length: float, n_shards: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per shard and dimension with its tree (``INDEX``). Every usable row is in one."""

    def run(table):
        dim = table["dim"][0].as_py()
        x = np.frombuffer(b"".join(table["data"].to_pylist()), "<f8").reshape(-1, dim)
        ids = table["vec_id"].to_numpy()
        order, nodes = build(x, ids, length, leaf_rows)
        return pa.table({
            "shard": table["shard"].slice(0, 1), "dim": table["dim"].slice(0, 1), "n": pa.array([len(x)], pa.int32()),
            "ids": pa.array([ids[order].astype("<i8").tobytes()]), "vectors": pa.array([x[order].astype("<f8").tobytes()]),
            "nodes": pa.array([nodes.astype("<f8").tobytes()]),
        })

    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id", "data"), F.lit(n_shards)).cast("int"))
    return dealt.groupBy("shard", "dim").applyInArrow(run, INDEX)


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` best rows of ``table``.

    Both have ``vec_id, embedding``. Nearness is the inner product in double precision, ties go to the smaller id. Rows with
    the query's own id are no candidates; all others are, repeated rows each. A query id that repeats is one
    query, by its smallest vector. Vectors of another dimension than the query's are no candidates. Queries visit every
    shard in blocks, streamed past one tree at a time.
    """
    usable = stored(vectors(table), "vectors")
    asked = stored(vectors(queries).groupBy("vec_id", "dim").agg(F.min("data").alias("data")), "queries")
    n, n_queries = usable.count(), asked.count()
    n_shards = max(1, -(-n // shard_rows))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(np.sqrt((np.frombuffer(v.as_py(), "<f8") ** 2).sum())) for v in batch.column(0)]
            yield pa.record_batch([pa.array([max(found, default=0.0)])], ["length"])

    length = usable.select("data").mapInArrow(longest, "length double").agg(F.max("length")).first()[0] or 1.0
    trees = stored(index(usable, length, n_shards), "trees")

    def gather(rows):
        return pa.table({
            "dim": rows["dim"].slice(0, 1), "ids": pa.array([rows["vec_id"].to_numpy().astype("<i8").tobytes()]),
            "vectors": pa.array([b"".join(rows["data"].to_pylist())]),
        })

    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).groupBy("block", "dim")
    blocks = stored(blocks.applyInArrow(gather, "dim int, ids binary, vectors binary"), "blocks")
    visits = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "dim", F.lit(1).alias("step"), "ids", "vectors",
        F.lit(None).cast("binary").alias("nodes"),
    )
    stream = trees.select("shard", "dim", F.lit(0).alias("step"), "ids", "vectors", "nodes").unionByName(visits)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for shard, dim, step, ids, vectors_, nodes in zip(*(batch.column(c) for c in range(6))):
                dim, ids = dim.as_py(), np.frombuffer(ids.as_py(), "<i8")
                x = np.frombuffer(vectors_.as_py(), "<f8").reshape(-1, dim)
                if step.as_py() == 0:
                    at = (shard.as_py(), dim)
                    tree = Search(x, ids, np.frombuffer(nodes.as_py(), "<f8").reshape(-1, 7), length, k, factor)
                elif at == (shard.as_py(), dim):
                    best, who = tree(x, ids)
                    found = np.nonzero(np.isfinite(best.ravel()))[0]
                    yield pa.record_batch(
                        [pa.array(np.repeat(ids, k)[found]), pa.array(who.ravel()[found]), pa.array(best.ravel()[found])],
                        ["query_id", "vec_id", "score"],
                    )

    found = stream.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "step").mapInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
