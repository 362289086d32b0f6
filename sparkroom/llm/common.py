"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder is set only where a local session names none, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sparkroom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, kept in the shared folder; lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of texts that Python gets at once (a text is never cut).
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python by so many bytes, not only by their number
    (ten thousand long texts, on both sides of the pipe, are much of an executor's
    memory): a Spark setting of the session, lowered where it is higher and then put back."""
    before = spark.conf.get(_BATCH)
    if int(before.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is.

    ``lower`` does that for pure ASCII; it would also change letters such as
    "É", so texts with more bytes than code points go through ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    An expression that stands inside a lambda is computed for each element; a
    lambda's own variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
