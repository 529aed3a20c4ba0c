"""Compare a query's rows with its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cells = [[_cell(v) for v in frame[c].astype(object)] for c in frame.columns]
    return sorted(zip(*cells), key=repr)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"row {x!r:.800} and {y!r:.800}"
    return None


def types_differ(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    for c in mine.columns:
        a, b = _kind(mine[c]), _kind(theirs[c])
        if a != b and "empty" not in (a, b):
            return f"{c}: {a} and {b}"
    return None


def _kind(s: pd.Series) -> str:
    kinds = {type(v).__name__ for v in s.astype(object) if v is not None and v == v}
    return ",".join(sorted(kinds)) or "empty"


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return v.item()
    return v
