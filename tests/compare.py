"""Runs registered queries next to their SQL and compares rows, types and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def _kind(values: pd.Series) -> str:
    if values.isna().all():
        return "null"
    kind = str(values.dtype)
    return "float64" if kind in ("Int64", "Int32") and values.isna().any() else kind.lower() if kind in ("Int64", "Int32") else kind


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else (value + 0.0)
    if hasattr(value, "tolist"):
        return tuple(value.tolist())
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def difference(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    left, right = rows_of(spark_frame), rows_of(duck_frame)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    kinds = {
        c: (_kind(spark_frame[c]), _kind(duck_frame[c]))
        for c in spark_frame.columns if _kind(spark_frame[c]) != _kind(duck_frame[c])
        and "null" not in (_kind(spark_frame[c]), _kind(duck_frame[c]))
    }
    return f"types {kinds}" if kinds and len(left) else None
