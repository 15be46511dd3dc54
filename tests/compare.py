"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(frame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def oracle(sql: str, sf_dir: str = DATA):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection.execute(sql).fetchdf()


def assert_same(spark, query, sql: str, sf_dir: str = DATA) -> None:
    got, want = query(spark, sf_dir).toPandas(), oracle(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
