"""The corpus pipeline: stages over documents, each one operator of sparkroom.llm.

Every stage works on all that the one before it kept. Defined results: tables
may be empty; all stages but the last carry columns beside doc_id, text and lang
along whatever their names (the last gives doc_id and what it made); of rows that
repeat doc_id and text one stays, the same whatever their order; and nulls go the
way each operator states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroom.llm import decontam, langid, secrets, sentencepiece, simhash
from sparkroom.llm.common import cut, scratch_path, table
from sparkroom.llm.queries import learning_rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors tell by a clear margin."""
    model = langid.train(learning_rows(docs))
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = nested.withColumn("language", langid.predict(F.col("row.text"), model, spark))
    return judged.where("language.accepted").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 between sets of
    five-word shingles connect: the one of least doc_id."""
    found = simhash.similar_documents(docs)
    # the rows of a group's first text; more than one if they repeat doc_id and shingles
    own = F.coalesce("doc_id", F.lit(simhash.NO_ID)) == F.col("root.id")
    first = found.where(own & (F.col("name") == F.col("root.name"))).groupBy("doc_id", "name").agg(F.min("text_hash").alias("h"), F.count("*").alias("n"))
    kept = cut(first.select(F.col("doc_id").alias("__doc"), F.col("h").alias("__hash"), "n"))
    nested = docs.select("doc_id", F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = nested["doc_id"].eqNullSafe(kept["__doc"]) & (nested["h"] == kept["__hash"])
    ones = nested.join(kept, same, "left_semi")
    if not kept.where("n > 1").isEmpty():
        # of rows that differ in other columns alone, the first by their text form
        ones = ones.groupBy("doc_id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return ones.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return found.where("n_hit = 0").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark."""
    found = secrets.find_secrets(docs, secrets.train(docs), carry=tuple(docs.columns))
    text = F.when(F.size("spans") > 0, secrets.redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return found.select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and whether they give it back."""
    import public_tokenizers

    coded = sentencepiece.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", tokens),
]

# zstandard sizes and trained models have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-').lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
