"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def rows_of(frame, columns):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float) and x == int(x):
            return int(x)
        return list(x) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else x

    return sorted(map(str, ([plain(x) for x in r] for r in frame[columns].astype(object).itertuples(index=False))))


def differences(spark, run, sql, data=DATA):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = run(spark, data).toPandas(), db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = rows_of(got, columns), rows_of(want, columns)
    return [] if a == b else [(x, y) for x, y in zip(a + [None] * len(b), b + [None] * len(a)) if x != y][:3]
