"""Every registered query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return repr([value(x) for x in v]) if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    df = driver.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(driver.oracle_sql()[name])
    assert sorted(want.columns) == columns
    got = sorted(tuple(map(value, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(value, r)) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_fixed_chunks_query(spark, sf_dir):
    rows = driver.queries()["chunk_fixed"](spark, sf_dir).collect()
    assert rows and all(r.chunk_text.strip() == r.chunk_text != "" for r in rows)


@pytest.mark.parametrize("name", ["summarize_stub", "cards_stub"])
def test_stub_queries(spark, sf_dir, name):
    assert driver.queries()[name](spark, sf_dir).count() == 1
