"""Rows of a query and of its SQL in one comparable form."""

import glob
import os

import pandas as pd

DATA = os.environ.get("CORVANE_TEST_DATA", "/root/testdata/sf0.001")


def database():
    import duckdb

    connection = duckdb.connect()
    for table in glob.glob(DATA + "/*.parquet"):
        connection.execute(f"create view {os.path.basename(table)[:-8]} as select * from '{table}'")
    return connection


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    return f"{x:.6f}" if isinstance(x, float) else repr(x.tolist()) if hasattr(x, "tolist") else str(x)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_cell, r)) for r in frame.astype(object).itertuples(index=False, name=None))
