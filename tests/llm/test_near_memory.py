"""Near-dedup hands texts to Python by bytes, and a prefix-filter task gives its pairs bit by bit."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from sparkroom.llm import common, simhash

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    before, seen, own = spark.conf.get(BATCH), [], simhash.cut
    rows = lambda: spark.range(0, 400, 1, 1).select(F.pandas_udf(lambda t: pd.Series([len(t)] * len(t)), "long")(F.repeat(F.lit("x"), 1000)).alias("n"))
    monkeypatch.setattr(common, "BATCH_BYTES", 20_000)
    with common.small_batches(spark):
        assert max(r.n for r in rows().collect()) < 100
    monkeypatch.setattr(simhash, "cut", lambda df: seen.append(int(spark.conf.get(BATCH).rstrip("bB"))) or own(df))
    df = spark.createDataFrame([(k, f"a b c d e f {k}") for k in range(9)], "doc_id long, text string")
    assert simhash.similar_documents(df).count() == 9
    assert sum(x <= 20_000 for x in seen) >= 5
    assert spark.conf.get(BATCH) == before and max(r.n for r in rows().collect()) == 400


def test_meetings_are_bounded(monkeypatch):
    """All pairs of different groups and like sizes, no more than so many at once."""
    monkeypatch.setattr(simhash, "PREFIX_PAIRS", 60)
    rng = np.random.default_rng(5)
    name = np.repeat(rng.integers(-(2**62), 2**62, 50), 4)
    one = pd.DataFrame({"token": rng.integers(0, 6, 200), "name": name, "group": np.repeat(rng.integers(0, 20, 50), 4), "size": np.repeat(rng.integers(70, 130, 50), 4)}).drop_duplicates(["token", "name"])
    one = one.assign(block=0, lo=0, hi=0)
    want = Counter()
    both = one.merge(one, on="token", suffixes=("_u", "_v"))
    for r in both[(both.name_u < both.name_v) & (both.group_u != both.group_v)].itertuples():
        if 5 * min(r.size_u, r.size_v) >= 4 * max(r.size_u, r.size_v):
            want[r.name_u, r.name_v] += 1
    got, most = Counter(), 0
    for part in simhash._meetings(0.8)(iter([one[:80], one[80:]])):
        most = max(most, len(part))
        for r in part.itertuples():
            got[r.u_name, r.v_name] += r.shared
    assert want and got == want and most <= 60
