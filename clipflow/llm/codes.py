"""Product codes of integer vectors: k-means per part under adaptive distance bounds, exact in integers.

With every part of a vector goes an upper bound of the distance to its entry, its ``b`` closest other entries with
lower bounds in ascending order, and one outer bound for all entries beside these. Between rounds bounds give way by
as much as entries moved. A part whose upper bound stays below its first lower bound is left alone. Otherwise its
own distance is computed, the listed entries that may be as near are compared in integers, and only a part that
may be nearer to an entry off its list is compared with all. Bounds are rounded to their safe side, so that what they
leave out is never as near, also in a tie. After each round ``b`` shrinks to what the parts had use for.

The vectors with codes and bounds are written after each round; a round collects the sums of its entries, whose number
is fixed by the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import attach, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Listed entries of a part: at first, at least; the share of parts that a shorter list must still serve.
LISTED = 32
LEAST_LISTED = 4
SERVED = 0.99
#: Integers beyond this magnitude are refused: squared distances of theirs might not fit a long.
LARGEST = 1 << 26

ROWS = "vec_id bigint, label string, dim int, ints binary"
STATE = "vec_id bigint, label string, ints binary, code binary, error bigint, listed int, bounds binary, order binary, need binary"
SUMS = "kind int, part int, entry int, place int, total bigint"
CODES = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"


def integer_rows(table: DataFrame, scale: int, label: str | None = None) -> DataFrame:
    """``vec_id, label, dim, ints`` (little-endian 32-bit) of the rows with usable vectors: floor(scale * x) by component.

    Vectors that are NULL or empty or hold a NULL or non-finite component are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
            flat = column.flatten()
            values = np.asarray(flat.fill_null(float("nan")), np.float64)
            fine = np.isfinite(values)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = sizes > 0
            good[owner[~fine]] = False
            kept = good[owner]
            found = np.floor(scale * values[kept])
            if len(found) and np.abs(found).max() >= LARGEST:
                raise ValueError(f"integer components of {LARGEST} and more are out of range")
            sizes = sizes[good]
            offsets = np.concatenate([[0], np.cumsum(4 * sizes)]).astype(np.int64)
            data = pa.py_buffer(found.astype("<i4").tobytes())
            ints = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), data]).cast(pa.binary())
            mask = pa.array(good)
            yield pa.record_batch(
                [batch.column(0).filter(mask), batch.column(2).filter(mask), pa.array(sizes.astype(np.int32)), ints],
                ["vec_id", "label", "dim", "ints"],
            )

    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    chosen = table.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), named.alias("label"))
    return chosen.mapInArrow(run, ROWS)


def smallest(rows: DataFrame, n: int) -> list:
    """The ``n`` rows with the smallest ids, ascending; rows without an id come last, equal ids by content."""
    return rows.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(n).collect()


def as_matrix(column: pa.Array, kind: str = "<i4") -> np.ndarray:
    """Binary cells of one length as the rows of a matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``left`` to all of ``right``, as longs."""
    top = max(np.abs(left).max(initial=0), np.abs(right).max(initial=0))
    if 4 * int(top) ** 2 * left.shape[1] < 1 << 53:  # then doubles hold every sum exactly
        left, right = left.astype(np.float64), right.astype(np.float64)
    else:
        left, right = left.astype(np.int64), right.astype(np.int64)
    return ((left * left).sum(1)[:, None] - 2 * (left @ right.T) + (right * right).sum(1)).astype(np.int64)


def _above(distance: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(distance.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _below(distance: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(distance.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), 0)


class Bounds:
    """What is known of one part of a batch of vectors: entry, upper bound, listed entries, their bounds, outer bound."""

    # need: how many listed entries each part was compared with; one more than are listed for all entries
    def __init__(self, ints: np.ndarray, entries: np.ndarray, listed: int):
        self.ints, self.entries = ints, entries.astype(np.int64)
        self.listed = min(listed, len(entries) - 1)
        n = len(ints)
        self.entry = np.zeros(n, np.int64)
        self.upper = np.full(n, np.inf, np.float32)
        self.order = np.zeros((n, self.listed), np.int64)
        self.lower = np.zeros((n, self.listed), np.float32)
        self.outer = np.zeros(n, np.float32)
        self.need = np.zeros(n, np.int64)

    def resume(self, entry, order, bounds, moved: np.ndarray) -> None:
        """Bounds of the round before, shifted by how far each entry has moved."""
        width = order.shape[1]
        moved = np.nextafter(moved.astype(np.float32), np.float32(np.inf))
        far = moved.max(initial=0)
        self.entry[:] = entry
        self.upper = np.nextafter(bounds[:, 0] + moved[self.entry], np.float32(np.inf))
        lower = np.nextafter(bounds[:, 1:1 + width] - moved[order], np.float32(-np.inf))
        outer = np.nextafter(bounds[:, -1] - far, np.float32(-np.inf))
        keep = self.listed
        if keep < width:  # what leaves the list goes under the outer bound
            outer = np.minimum(outer, lower[:, keep:].min(axis=1))
        self.order, self.lower, self.outer = order[:, :keep].astype(np.int64), lower[:, :keep], outer
        self._sort()

    def _sort(self) -> None:
        """Lower bounds in ascending order: each gives way to those behind it."""
        chain = np.concatenate([self.lower, self.outer[:, None]], axis=1)
        chain = np.minimum.accumulate(chain[:, ::-1], axis=1)[:, ::-1]
        self.lower = np.ascontiguousarray(chain[:, :-1])

    def _exact(self, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = self.ints[rows].astype(np.int64)
        gap = (gap[:, None, :] if entry.ndim == 2 else gap) - self.entries[entry]
        return (gap * gap).sum(-1)

    def assign(self) -> None:
        """Every part to its nearest entry, the first of equally near ones."""
        first = self.lower[:, 0] if self.listed else self.outer
        unsure = np.nonzero(self.upper >= first)[0]
        known = unsure[np.isfinite(self.upper[unsure])]
        self.upper[known] = _above(self._exact(known, self.entry[known]))
        unsure = unsure[self.upper[unsure] >= first[unsure]]
        whole = self.upper[unsure] >= self.outer[unsure]
        self._among_all(unsure[whole])
        rest = unsure[~whole]
        self.need[rest] = (self.lower[rest] <= self.upper[rest, None]).sum(1)
        for m in np.unique(self.need[rest]):
            rows = rest[self.need[rest] == m]
            for at in range(0, len(rows), 4096):
                self._among_first(rows[at:at + 4096], int(m))
        self._sort()

    def _among_first(self, rows: np.ndarray, m: int) -> None:
        choice = np.concatenate([self.entry[rows, None], self.order[rows, :m]], axis=1)
        distance = self._exact(rows, choice)
        rank = np.lexsort((choice, distance), axis=1)
        choice = np.take_along_axis(choice, rank, axis=1)
        distance = np.take_along_axis(distance, rank, axis=1)
        self.entry[rows], self.upper[rows] = choice[:, 0], _above(distance[:, 0])
        self.order[rows, :m], self.lower[rows, :m] = choice[:, 1:], _below(distance[:, 1:])

    def _among_all(self, rows: np.ndarray) -> None:
        self.need[rows] = self.listed + 1
        for at in range(0, len(rows), 4096):
            some = rows[at:at + 4096]
            distance = squared(self.ints[some], self.entries)
            rank = np.argsort(distance, axis=1, kind="stable")  # ties by index
            distance = np.take_along_axis(distance, rank, axis=1)
            self.entry[some], self.upper[some] = rank[:, 0], _above(distance[:, 0])
            self.order[some], self.lower[some] = rank[:, 1:1 + self.listed], _below(distance[:, 1:1 + self.listed])
            beyond = 1 + self.listed
            self.outer[some] = _below(distance[:, beyond]) if beyond < distance.shape[1] else np.inf


def _assigned(rows: DataFrame, books: list[np.ndarray], moved: np.ndarray | None, listed: int) -> DataFrame:
    """One round of assignment (``STATE``); without ``moved`` the rows are new and have no bounds."""
    parts, first = len(books), moved is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = as_matrix(batch.column(2))
            width = ints.shape[1] // parts
            out = []
            if not first:
                code = as_matrix(batch.column(3), np.uint8)
                before = batch.column(4)[0].as_py()
                bounds = as_matrix(batch.column(5), "<f4").reshape(len(ints), parts, before + 2)
                order = as_matrix(batch.column(6), np.uint8).reshape(len(ints), parts, before)
            for p, entries in enumerate(books):
                known = Bounds(ints[:, p * width:(p + 1) * width], entries, listed)
                if not first:
                    known.resume(code[:, p], order[:, p], bounds[:, p], moved[p])
                known.assign()
                out.append(known)
            everyone = np.arange(len(ints))
            error = sum(known._exact(everyone, known.entry) for known in out)
            cells = lambda columns, kind: pa.array([row.tobytes() for row in np.stack(columns, axis=1).astype(kind)], pa.binary())
            yield pa.record_batch([
                batch.column(0), batch.column(1), batch.column(2), cells([k.entry for k in out], np.uint8), pa.array(error),
                pa.array(np.full(len(ints), out[0].listed, np.int32)),
                cells([np.concatenate([k.upper[:, None], k.lower, k.outer[:, None]], axis=1) for k in out], "<f4"),
                cells([k.order for k in out], np.uint8), cells([np.minimum(k.need, 255) for k in out], np.uint8),
            ], [f.split()[0] for f in STATE.split(", ")])

    if first:
        return rows.select("vec_id", "label", "ints").mapInArrow(run, STATE)
    return rows.select("vec_id", "label", "ints", "code", "listed", "bounds", "order").mapInArrow(run, STATE)


def _sums(state: DataFrame, parts: int) -> DataFrame:
    """Per entry its number of parts (place -1) and sum by place; kind 1: how many parts had use for how long a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ints, code = as_matrix(batch.column(0)).astype(np.int64), as_matrix(batch.column(1), np.uint8)
            need = as_matrix(batch.column(2), np.uint8)
            width = ints.shape[1] // parts
            for p in range(parts):
                rank = np.argsort(code[:, p], kind="stable")
                entry, starts, counts = np.unique(code[rank, p], return_index=True, return_counts=True)
                sums = np.add.reduceat(ints[rank, p * width:(p + 1) * width], starts, axis=0)
                for e, row in zip(entry.tolist(), np.concatenate([counts[:, None], sums], axis=1)):
                    totals[0, p, e] = totals.get((0, p, e), 0) + row
                use, many = np.unique(need[:, p], return_counts=True)
                for u, c in zip(use.tolist(), many.tolist()):
                    totals[1, p, u] = totals.get((1, p, u), 0) + np.array([c])
        lines = [(*key, place - 1, int(v)) for key, row in totals.items() for place, v in enumerate(row)]
        columns = list(zip(*lines)) or [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "part", "entry", "place", "total"])

    partial = state.select("ints", "code", "need").mapInArrow(run, SUMS)
    return partial.groupBy("kind", "part", "entry", "place").agg(F.sum("total").alias("total"))


def _fewer(uses: dict[int, int], listed: int) -> int:
    """The shortest list that serves its share of the parts that the present one serves."""
    served = {use: n for use, n in uses.items() if use <= listed}
    total, within = sum(served.values()), 0
    for use in sorted(served):
        within += served[use]
        if within >= SERVED * total:
            return max(use, min(LEAST_LISTED, listed))
    return listed


def train(
    rows: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS, listed: int = LISTED
) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """Codes of the stored ``rows`` after the rounds, the final codebooks, and the list lengths that were used.

    A codebook entry becomes the floor of the mean of its parts; an entry without parts stays.
    """
    books = [book.astype(np.int64) for book in books]
    listed = min(listed, len(books[0]) - 1)
    lengths = [listed]
    state = stored(_assigned(rows, books, None, listed), "codes")
    for _ in range(rounds):
        after = [book.copy() for book in books]
        uses: dict[int, int] = {}
        means: dict[tuple[int, int], dict[int, int]] = {}
        for kind, p, e, place, total in _sums(state, len(books)).collect():  # bounded by the codebooks
            if kind:
                uses[e] = uses.get(e, 0) + total
            else:
                means.setdefault((p, e), {})[place] = total
        for (p, e), sums in means.items():
            after[p][e] = [sums[k] // sums[-1] for k in range(books[p].shape[1])]
        moved = np.sqrt(np.stack([((a - b).astype(np.float64) ** 2).sum(1) for a, b in zip(after, books)])) * (1 + 1e-12)
        books = after
        listed = _fewer(uses, listed)
        lengths.append(listed)
        state = stored(_assigned(state, books, moved, listed), "codes")
    return state, books, lengths


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(v) for book in books for v in book.ravel().tolist())


def encode(
    table: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
    scale: int = SCALE, listed: int = LISTED,
) -> DataFrame:
    """Every usable row with its code and errors (``CODES``).

    Rows whose vector is NULL, empty, or holds a NULL or non-finite component are dropped, as are vectors of another
    length than that of the smallest kept id; a length that the parts do not divide is refused. Rows that repeat an
    id, and rows without one, are coded like others; the latter come last for the first codebooks. With fewer rows
    than entries the codebooks are as long as the rows. Equal labels share ``label_error``, NULLs together. Other columns
    are not read; a table without usable rows gives none.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code byte has 1 to 256 values")
    rows = stored(integer_rows(table, scale, label), "vectors")
    first = smallest(rows, 1)
    if not first:
        return table.sparkSession.createDataFrame([], CODES)
    dim = first[0]["dim"]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components have no {parts} equal parts")
    rows = rows.filter(F.col("dim") == dim)
    start = np.stack([np.frombuffer(r["ints"], "<i4") for r in smallest(rows, entries)])
    state, books, _ = train(rows, np.split(start, parts, axis=1), rounds, listed)
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))
    facts = state.select("vec_id", "code", "error", key.alias("label"))
    groups = facts.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("size"))
    named = attach(facts, stored(groups, "labels"), "label", "size", facts.count())
    return named.select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
