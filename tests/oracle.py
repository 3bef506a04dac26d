"""Comparing a query with its SQL as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    names = sorted(frame.columns)
    return sorted(tuple(map(text, r)) for r in frame[names].astype(object).itertuples(index=False))
