"""Rasters and metadata as views over the driver's tables.

The tables hold no images; these views give them the shape of some, with every
row in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroom.functions.points import clamp
from sparkroom.operators.raster import RGB, Raster

CFA_WIDTH = 100
RGB_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cfa(spark: SparkSession, sf_dir: str) -> Raster:
    """events as one mosaic of 100 columns; values over 500 are white."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.lit(0).alias("image_id"), F.expr("event_id div 100").alias("y"), (F.col("event_id") % CFA_WIDTH).alias("x"), (clamp(F.col("value") / 500.0) + 0.0).alias("v"))
    height = (events.agg(F.max("event_id")).first()[0] or 0) // CFA_WIDTH + 1
    return Raster(rows, height, CFA_WIDTH)


def rgb(spark: SparkSession, sf_dir: str) -> Raster:
    """embeddings as an image of 64 columns; a pixel is a component and the two
    after it, around the end."""
    vectors = table(spark, sf_dir, "embeddings")
    value = lambda i: clamp(F.get("embedding", ((F.col("x") + i) % RGB_WIDTH).cast("int")).cast("double") * 0.5 + 0.5) + 0.0
    rows = vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(RGB_WIDTH - 1))).alias("x"))
    df = rows.select(F.lit(0).alias("image_id"), F.col("vec_id").alias("y"), F.col("x").cast("long").alias("x"), *[value(i).alias(c) for i, c in enumerate(RGB)])
    height = (vectors.agg(F.max("vec_id")).first()[0] or 0) + 1
    return Raster(df, height, RGB_WIDTH, RGB)


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as one image for each supplier: whole sensor values in cents."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.floor(F.col("l_extendedprice")).cast("double").alias("v"))


def order_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tag sets."""
    o = table(spark, sf_dir, "orders")
    cells = F.array(
        F.struct(F.lit("Status").alias("name"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("Priority").alias("name"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("Owner").alias("name"), F.col("o_custkey").cast("string").alias("value")),
    )
    return o.select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 3).cast("int").alias("ifd"), F.explode(cells).alias("t")).select("image_id", "ifd", "t.*")


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as tag sets, under registered and other names."""
    p = table(spark, sf_dir, "part")
    cell = lambda name, value, dtype, count: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(dtype).alias("dtype"), count.alias("count"))
    cells = F.array(
        cell("Make", F.col("p_brand"), "ASCII", F.octet_length("p_brand") + 1),
        cell("Model", F.col("p_name"), "ASCII", F.octet_length("p_name") + 1),
        cell("ImageWidth", F.col("p_size"), "LONG", F.lit(1)),
        cell("ExposureTime", F.col("p_retailprice"), "RATIONAL", F.lit(1)),
        cell("ColorMatrix1", F.col("p_size"), "SRATIONAL", F.col("p_size") % 10),
        cell("Orientation", F.col("p_size"), "DOUBLE", F.lit(1)),
        cell("BlackLevel", F.col("p_size"), "SHORT", F.lit(1)),
        cell("x-type", F.col("p_type"), "ASCII", F.octet_length("p_type") + 1),
    )
    ifd = (F.col("p_partkey") % 4).cast("int")
    kinds = F.when(ifd == 0, F.array(F.lit("ifd0"))).when(ifd == 1, F.array(F.lit("raw"))).when(ifd == 2, F.array(F.lit("exif"))).otherwise(F.array(F.lit("ifd0"), F.lit("raw")))
    return p.select(F.col("p_partkey").alias("image_id"), ifd.alias("ifd"), kinds.alias("kinds"), F.explode(cells).alias("t")).select("image_id", "ifd", "kinds", "t.*")
