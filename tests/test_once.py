"""Values that stand in an expression many times are computed once."""

import time

from pyspark.sql import functions as F

from sparkroom.functions import points
from sparkroom.operators import fits, tags


def test_let_computes_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        calls.add(1)
        return i + 1

    value = F.lit(0) + counted(F.col("id"))
    got = spark.range(7).select(points.let(value, lambda v: v * v + v).alias("r")).collect()
    assert [r.r for r in got] == [(i + 1) ** 2 + i + 1 for i in range(7)] and calls.value == 7


def test_expressions_do_not_multiply(spark):
    """Before, 948,000, 20,000 and 10,000 characters of expressions, and milliseconds a row."""
    df = spark.range(1).select(F.create_map(F.lit("RA"), F.lit("1 2 3")).alias("h"), F.lit("<a/>").alias("p"))
    for made, most in ((fits.avm(F.col("h")), 60_000), (fits.wcs(F.col("h")), 15_000), (tags.xmp_lists(F.col("p")), 7_000)):
        assert len(df.select(made)._jdf.queryExecution().analyzed().toString()) < most


def test_last_of_repeated_keys(spark):
    packet = '<rdf:Description a:x="1" b:y="2" a:x="3"><b:y>4</b:y><c:z><rdf:Seq><rdf:li>5</rdf:li><rdf:li>6</rdf:li></rdf:Seq></c:z></rdf:Description>'
    df = spark.createDataFrame([(packet,)], "p string")
    assert df.select(tags.xmp_lists(F.col("p")).alias("m")).first().m == {"a:x": ["3"], "b:y": ["4"], "c:z": ["5", "6"]}
    start = time.time()
    many = spark.range(2000).select(F.concat(F.lit(packet), F.col("id").cast("string")).alias("p"))
    assert many.select(F.explode(tags.xmp_lists(F.col("p")))).count() == 6000
    assert time.time() - start < 60
