"""Dot products and softmax over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arith import as_col, let


def dot(a, b) -> Column:
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits) -> Column:
    """Softmax of one array, shifted by its maximum so that large logits stay finite."""

    def shifted(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))

    def normed(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(e, lambda v: v / t))

    return let(let(as_col(logits), shifted), normed)
