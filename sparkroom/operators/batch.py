"""Batch jobs: which inputs to take, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("overwrite", "skip", "error")


def select_inputs(files: DataFrame, existing: DataFrame, policy: str = "skip", key: str = "name") -> DataFrame:
    """Inputs in order of path, without those whose output is there already."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}")
    if policy == "skip":
        files = files.join(existing.select(key), key, "left_anti")
    elif policy == "error":
        clash = F.raise_error(F.concat(F.lit("exists already: "), F.col(key)))
        files = files.join(existing.select(key, F.lit(True).alias("_old")), key, "left").withColumn(key, F.when(F.col("_old"), clash).otherwise(F.col(key))).drop("_old")
    return files


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    return results.groupBy(status).agg(F.count("*").alias("n"))


def summarize(results: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, written, skipped and errored."""
    n = lambda s: F.count(F.when(F.col(status) == s, True))
    return results.agg(F.count("*").alias("total"), n("written").alias("written"), n("skipped").alias("skipped"), n("errored").alias("errored"))
