"""Language identification by compression.

Every learned language has raw-content zstandard dictionaries: sampled labelled
text, reduced to lower-case letters and single blanks. A text, reduced alike, is
cut into blocks of ``BLOCK`` bytes, each block is compressed with each
dictionary, and the language whose sizes add up to least wins. Blocks keep the
dictionary in reach through a long text and bound memory; all blocks of a text
count. Texts of all lengths are compressed alike, at a level that takes matches
of three bytes where they pay: faster ones leave most texts of a few words as they
are, whatever the dictionary, and can't tell them apart.

A text is accepted if the runner-up needs more than ``MIN_MARGIN`` of the
winner's bytes in addition, and ``MIN_BYTES`` at least; others are rejected. The
score is the winner's share when sizes are turned into likelihoods. ``WAYS`` is
the number of dictionaries of disjoint samples for each language, whose sizes are
averaged.

The sample is bounded: about ``SAMPLE_DOCS`` documents of each language, chosen
by the hash of number and text (so that null or equal numbers are no matter, and equal
rows are one), give ``PIECE`` characters each, and all of them stand in the
dictionaries. Four times as many rows are the most that the driver takes.

Defined results: a text that is null or has no letter is "und" with score 0 and
rejected; so is every text if there is nothing to learn from; ties go to the
language with more training documents, then to the lesser name; rows that repeat
are each judged; labels that are null teach nothing; other columns are carried,
save one with the name of ``identify``'s output, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
SAMPLE_DOCS, PIECE = 700, 256
WAYS, BLOCK = 1, 2048
#: Level and least match length of zstandard.
LEVEL, MATCH = 11, 3
MIN_MARGIN, MIN_BYTES = 0.002, 1.0
#: Nats that a byte of difference counts in the score.
BYTE_NATS = 0.6

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

_OTHER = re.compile(r"[\W\d_]+")

#: Name of a language and its dictionaries, in the order that ties follow.
Model = list[tuple[str, list[bytes]]]


def letters(text: str) -> bytes:
    """The words of a text: lower-case letters, a blank around each."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def train(df: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, piece: int = PIECE) -> Model:
    """Dictionaries from labelled rows. One count for each language and a sample
    whose expected size the parameters bound reach the driver."""
    rows = df.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(label).alias("label"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), F.col(text).alias("text"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(False)
    for name, n in counts.items():
        share = share | ((F.col("label") == name) & (F.pmod("h", F.lit(n)) < sample_docs))
    # a stretch of the text from anywhere in it
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - piece + 1, F.lit(1)).cast("long")).cast("int") + 1
    pieces = rows.where(share).select("label", "h", F.substring("text", start, F.lit(piece)).alias("s"))
    sample: dict[str, set[tuple[int, str]]] = {name: set() for name in counts}
    for r in pieces.distinct().orderBy("h", "label", "s").limit(4 * sample_docs * len(counts)).collect():
        sample[r.label].add((r.h, r.s))
    model = []
    for name in sorted(counts, key=lambda x: (-counts[x], x)):
        some = [s for _, s in sorted(sample[name])]
        dicts = [b"".join(map(letters, some[way::WAYS])) for way in range(WAYS)]
        if dicts := [d for d in dicts if len(d) >= 8]:
            model.append((name, dicts))
    return model


class Classifier:
    def __init__(self, model: Model, min_margin: float = MIN_MARGIN, min_bytes: float = MIN_BYTES) -> None:
        self.names = [name for name, _ in model]
        self.min_margin, self.min_bytes = min_margin, min_bytes
        self.compress = [[self._compressor(d) for d in dicts] for _, dicts in model]

    @staticmethod
    def _compressor(raw: bytes):
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(raw), min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        raw = letters(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(f(b)) for b in blocks for f in own) / len(own) for own in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        least = sizes[best]
        margin = min((s for i, s in enumerate(sizes) if i != best), default=math.inf) - least
        score = 1 / sum(math.exp(-min(700.0, BYTE_NATS * (s - least))) for s in sizes)
        return self.names[best], score, margin > self.min_margin * least and margin >= self.min_bytes


def predict(text: Column, model: Model, spark, min_margin: float = MIN_MARGIN) -> Column:
    """lang_pred, score and accepted of whole texts; no other column is read."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's parameters for each language

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = Classifier(shared.value, min_margin)
        for batch in texts:
            yield pd.DataFrame([classify(t) for t in batch], columns=["lang_pred", "score", "accepted"], index=batch.index)

    return F.pandas_udf(judge, PREDICTION)(text)


def identify(df: DataFrame, model: Model, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df`` with the struct column ``language``."""
    return df.withColumn("language", predict(F.col(f"`{text}`"), model, df.sparkSession, min_margin))
