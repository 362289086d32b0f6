"""What a conversion computes once, and how."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkroom import queries_statistics
from sparkroom.plans import convert


def test_mosaics_are_encoded_once(spark, sf):
    files = queries_statistics._mosaic_files(spark, sf)
    assert files.inputFiles() and not any("events.parquet" in f for f in files.inputFiles())


def test_rendering_leaves_no_method_that_is_not_compiled(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    px = spark.range(2).select(*[(F.col("id") / 2).alias(c) for c in convert.RGB], F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("m"), F.lit(0.0).alias("exposure"), F.lit(0.0).alias("shadows"), F.lit(None).cast("array<double>").alias("tone"))
    assert convert.shown_rgb(px).count() == 2 and int(spark.conf.get(limit)) <= 8000
