"""Every registered query that has SQL gives the same rows as DuckDB does."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op")]


def same(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall())))


@pytest.mark.parametrize("name", ENGINE)
def test_equals_sql(spark, sf, name):
    same(spark, sf, name)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["surface", "n"] and df.count() > 0
