"""Holds a query's rows against those of its SQL."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd


def database(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return str([plain(v) for v in value])
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, (bool, int, float)):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


def same(query, sql: str, spark, folder: str) -> None:
    got, want = query(spark, folder).toPandas(), database(folder).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
