"""Rows are dealt by key before they are many, so that a task's memory stays small."""

import re
from collections import Counter

import duckdb

from sparkroom import catalog
from sparkroom.operators import tags

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    rows = Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in cur.fetchall())
    got = catalog.QUERIES[name](spark, SF).select(*names).collect()
    assert Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got) == rows


def test_difference_counts_repeats(spark):
    a = spark.createDataFrame([(1, 0, "x")] * 3 + [(1, None, "y"), (2, 0, "x")], "image_id int, ifd int, name string")
    b = spark.createDataFrame([(1, 0, "x"), (1, None, "y"), (2, 0, "x"), (2, 0, "x"), (3, 0, "z")], "image_id int, ifd int, name string")
    got = Counter(tuple(r) for r in tags.difference(a, b).collect())
    assert got == {(1, 0, "x", "missing"): 2, (2, 0, "x", "extra"): 1, (3, 0, "z", "extra"): 1}


def test_difference_reads_each_side_once(spark):
    physical, executed = plan(catalog.QUERIES["tag_diff"](spark, SF))
    assert len(re.findall("FileScan", physical)) == 2
    assert len(re.findall(r"Exchange hashpartitioning", executed)) == 1
    equal_to_sql(spark, "tag_diff")


def test_headers_are_dealt_before_their_tags(spark):
    _, executed = plan(catalog.QUERIES["fits_tags"](spark, SF))
    assert len(re.findall("Exchange hashpartitioning", executed)) == 1
    assert executed.index("Generate") < executed.index("Exchange hashpartitioning")
    equal_to_sql(spark, "fits_tags")
