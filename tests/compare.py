"""Comparing a query with its SQL: rows as multisets, columns by name, and their types."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return bytes(x) if isinstance(x, bytearray) else x


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def check(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    got = bag(df.columns, map(tuple, df.collect()))
    rel = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    want = bag(rel.columns, rel.fetchall())
    assert got == want, f"only here: {list((got - want).items())[:3]}; only in SQL: {list((want - got).items())[:3]}; rows {sum(got.values())}, {sum(want.values())}"
    kinds = {c: t for c, t in df.dtypes}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<int>": "INTEGER[]"}
    for c, t in zip(rel.columns, rel.types):
        assert same[kinds[c]] == str(t), (c, kinds[c], str(t))
    return sum(got.values())
