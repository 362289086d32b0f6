"""File-source streams of frames: per-frame statistics as they arrive.

The batch operators work on streams unchanged where they are projections; totals
for a frame use a watermark on its time, so state is dropped once a frame can
have no more rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_levels(stream: DataFrame, time: str = "ts", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and range of values in each window of time."""
    # watermarks need an instant; the session's zone is UTC where it matters
    held = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if stream.isStreaming else stream
    w = held.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return w.select(F.col("window.start").alias("start"), "n", "mean", "low", "high")


def run_once(stream: DataFrame, sink_path: str, checkpoint: str, mode: str = "append"):
    """Everything that has arrived, written as Parquet, then stop."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
