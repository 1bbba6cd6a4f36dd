"""Runs SQL in DuckDB over a folder of Parquet tables and compares results without regard to order."""

from __future__ import annotations

import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got, want = [tuple(r) for r in df.collect()], con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
