"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from sparkroom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf():
    from conftest import SF

    return SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=str)
    ours = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
