"""Runs a query and its SQL and compares their rows."""

from __future__ import annotations

import os

import duckdb


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con.sql(sql).df()


def _plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def same(df, sql: str, folder: str) -> None:
    got, want = df.toPandas(), sql_rows(sql, folder)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted(str(tuple(_plain(v) for v in r)) for r in x[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)
