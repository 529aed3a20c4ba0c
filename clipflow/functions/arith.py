"""Small expression helpers the Column API has no operator for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def int_div(a, b) -> Column:
    """``a`` divided by ``b`` as whole numbers."""
    return F.call_function("div", as_col(a), as_col(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
