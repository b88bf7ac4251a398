"""Holds a query's rows against DuckDB's, as multisets."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (float, np.floating)):
        return f"{value:.9g}"
    if isinstance(value, (np.ndarray, list)):
        return str([shown(v) for v in value])
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame = frame.assign(**{c: frame[c].astype("datetime64[us]").astype(str)})
    return sorted([tuple(shown(v) for v in r) for r in frame.itertuples(index=False)], key=str)


def same_rows(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    have, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)
