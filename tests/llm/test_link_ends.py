"""Near-dedup links that no walked stretch finds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from sparkroom.llm import simhash


def _texts() -> list[str]:
    """Families around the similarity, and pairs of a few words and one more, which are at it."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    out = []
    for _ in range(40):
        base = words(120)
        for _ in range(8):
            text = list(base)
            for at in rng.choice(120, 2, replace=False):
                text[at] = words(1)[0]
            out.append(text)
    for _ in range(50):
        base = words(8)
        out += [base, base + words(1), base + words(3)]
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("found, crowd", [("tries", simhash.PREFIX_CROWD), ("nothing", 3)])
def test_links_that_tries_leave_out(spark, monkeypatch, found, crowd):
    """Every pair at the similarity is linked, whatever the tries find, and no other."""
    monkeypatch.setattr(simhash, "PREFIX_CROWD", crowd)
    if found == "nothing":
        own = simhash.similar_links
        monkeypatch.setattr(simhash, "similar_links", lambda *a: own(*a).limit(0))
    shared = " ".join(f"s{k}" for k in range(45))
    family = [f"{shared} x{k} y{k} z{k}" for k in range(12)] if crowd == 3 else []
    texts = _texts() + family
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = {r.doc_id: r.root.id for r in simhash.similar_documents(df).collect()}
    assert got == dict(enumerate(root))
