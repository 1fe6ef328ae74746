"""Runs a query and its SQL twin and gives both as sorted rows of text."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "\0"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, int | np.integer):
        return str(int(x))
    return repr(float(x)) if isinstance(x, float | np.floating) else str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(zip(*(frame[c].map(_cell).tolist() for c in frame.columns), strict=True)) if len(frame) else []


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
