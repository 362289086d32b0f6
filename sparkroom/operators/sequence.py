"""Numbering rows in a global order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkroom.sources.files import shared_dir


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with the row's place in the order of ``order``.

    Rows are dealt into sorted ranges; a range's first number is the count of the
    ranges before it, one row for each range. The ranges are kept in the shared
    folder meanwhile, so both readings see the same ones."""
    spark = df.sparkSession
    shared_dir(spark)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = sorted((r["_range"], r.n) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    first, rows = start, []
    for part, n in sizes:
        rows.append((part, first))
        first += n
    bases = spark.createDataFrame(rows, "_range int, _first long")
    within = Window.partitionBy("_range").orderBy(*order)
    return dealt.join(F.broadcast(bases), "_range").withColumn(name, F.col("_first") + F.row_number().over(within) - 1).drop("_range", "_first")
