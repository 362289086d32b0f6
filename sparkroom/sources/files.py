"""Folders, settings files, and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("Temperature", T.DoubleType()),
        T.StructField("Tint", T.DoubleType()),
        T.StructField("Exposure2012", T.DoubleType()),
        T.StructField("orientation", T.IntegerType()),
    ]
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it
    is unset, a local session gets a temporary one; a cluster has none to fall back on."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sparkroom-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Bytes of files' contents that Python gets at once (a file is never cut).
BATCH_BYTES = 1 << 24
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(rows: DataFrame) -> DataFrame:
    """Rows that hold contents, to be handed to Python by so many bytes, not only by their
    number: a Spark setting of the session, lowered where it is higher. (Ten thousand
    files, Spark's default, may be gigabytes.)"""
    conf = rows.sparkSession.conf
    if int(conf.get(_BATCH, str(2**31 - 1)).rstrip("bB")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows


#: Bytes of a generated method beyond which the JVM compiles none of it.
METHOD_BYTES = 8000
_METHOD = "spark.sql.codegen.hugeMethodLimit"


def by_steps(rows: DataFrame) -> DataFrame:
    """Rows with long chains of expressions, to be computed step by step where one
    generated method would be too large for the JVM to compile: a Spark setting of the
    session, lowered where it is higher."""
    conf = rows.sparkSession.conf
    if int(conf.get(_METHOD, "65535")) > METHOD_BYTES:
        conf.set(_METHOD, str(METHOD_BYTES))
    return rows


def folder(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files of a folder by lower-cased suffix, without their content; order by path."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)).orderBy("path")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings of each file, with a fixed schema."""
    return spark.read.csv(path, schema=SETTINGS, header=True)


def with_settings(files: DataFrame, s: DataFrame) -> DataFrame:
    """Files and their settings, by name; files without keep nulls."""
    return files.join(s.withColumnRenamed("filename", "name"), "name", "left")


def write_stage(pixels: DataFrame, path: str, mode: str = "error") -> None:
    """Pixels as Parquet, a folder for each image."""
    pixels.write.mode(mode).partitionBy("image_id").parquet(path)
