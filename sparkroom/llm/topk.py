"""Exact top-k search by inner product with no-random-access aggregation.

Candidates are cut into blocks. In a block each of the dimensions is a list sorted by
value, which a query reads from the top where its own component is positive and from
the bottom where it is negative. Lists are read in steps, those first that the query
weighs most: a step reads the next ``STEP`` dimensions whole and adds their products,
and nothing that was read is read again. What a list that is not read yet can add to a
candidate lies between the product with the list's ends and, as a whole for all unread
lists, within the lengths of the unread parts of query and candidate; so every
candidate has a lower and an upper bound.

Outsiders, whose upper bound is under the k-th best lower bound of the block or the k-th
best score of the blocks before, cannot qualify and are read no further. When the lists
have all been read, both bounds are the score: final scores come out of the same sums,
there is no other product.

Blocks are made of candidates of like length and come in the order of falling length.
By its longest candidate a block bounds all scores that a query can have with it; where
that is under the query's k-th best score, the query passes the block over, and all later
ones with it. What queries reach at least is known before vectors move: their k best
scores among the longest candidates, ``PROBES`` for each task, are looked for first, and
a candidate goes to the queries of a group only if its length can reach the least of
those scores of the group.

Scores are exact while they stay under 2^53.

Defined results: rows with a null key, or a vector that is null, empty or with null or
non-finite components take no part; a query meets candidates of its own length alone;
rows that repeat a key are one candidate each and never meet a query with their own key,
and of queries that repeat a key the least vector is asked; ties go to the smaller key;
with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroom.llm.common import cut, shared_dir

K = 20
#: Candidates and queries of a block, and of a task at most.
BLOCK, QUERY_BLOCK = 4096, 1024
TASK_ROWS, TASK_QUERIES = 65_536, 8_192
#: Dimensions that a step reads, and longest candidates that are looked at before all.
STEP, PROBES = 8, 1024

OUT = "query_id long, vec_id long, score long"


def block_top_k(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int, floor: float, ends: tuple[np.ndarray, np.ndarray], rest: np.ndarray, read: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of one block's candidates that may be among the k best of one
    query, as far as they are at or over ``floor``. ``x`` holds a list in each row, and
    ``ends`` their least and largest values; ``rest`` are the candidates' squared lengths;
    ``read`` counts components by ``read`` and, all there are, ``all``."""
    order = np.argsort(-np.abs(q) * (ends[1] - ends[0] + 1e-9), kind="stable")
    alive = np.flatnonzero(ids != query_id)
    total = np.zeros(len(alive))
    # what the lists from each place in the order on can add, at most and at least
    most = np.maximum(q * ends[1], q * ends[0])[order]
    least = np.minimum(q * ends[1], q * ends[0])[order]
    most, least = (np.append(np.cumsum(v[::-1])[::-1], 0.0) for v in (most, least))
    own = np.append(np.sqrt(np.cumsum((q[order] ** 2)[::-1])[::-1]), 0.0)
    square = rest[alive]
    if read is not None:
        read["all"] += len(alive) * len(q)
    for a in range(0, len(q), STEP):
        dims = order[a : a + STEP]
        part = np.take(x[dims], alive, axis=1)
        total = total + q[dims] @ part
        square = square - np.einsum("ij,ij->j", part, part, dtype=float)
        if read is not None:
            read["read"] += part.size
        b = a + len(dims)
        unread = own[b] * np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-6
        upper = total + np.minimum(most[b], unread)
        lower = total + np.maximum(least[b], -unread)
        kth = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
        stay = upper >= max(kth, floor) - (1e-6 if b < len(q) else 0)
        alive, total, square = alive[stay], total[stay], square[stay]
        if not len(alive):
            break
    return alive, total


def task_top_k(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, block: int = BLOCK, read: Counter | None = None) -> pd.DataFrame:
    """The k best of all candidates for each query, block by block of falling length."""
    square = (x.astype(float) ** 2).sum(1)
    order = np.lexsort((ids, -square))
    ids, x, square = ids[order], x[order], square[order]
    size = np.sqrt((q.astype(float) ** 2).sum(1))
    best = [(np.empty(0, np.int64), np.empty(0))] * len(q)
    for b in range(0, len(x), block):
        own, some, rest = ids[b : b + block], np.ascontiguousarray(x[b : b + block].T), square[b : b + block]
        ends = some.min(1).astype(float), some.max(1).astype(float)
        reach = size * np.sqrt(rest[0]) * (1 + 1e-9)
        for i in range(len(q)):
            held, scores = best[i]
            floor = scores[k - 1] if len(scores) >= k else -np.inf
            if reach[i] < floor:
                if read is not None:
                    read["all"] += int((own != query_ids[i]).sum()) * x.shape[1]
                continue
            at, s = block_top_k(own, some, query_ids[i], q[i].astype(float), k, floor, ends, rest, read)
            held, scores = np.concatenate((held, own[at])), np.concatenate((scores, s))
            top = np.lexsort((held, -scores))[:k]
            best[i] = held[top], scores[top]
    rows = [(i, h, s) for i, (h, s) in zip(query_ids.tolist(), best)]
    return pd.DataFrame({"query_id": np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64), "vec_id": np.concatenate([r[1] for r in rows]).astype(np.int64), "score": np.rint(np.concatenate([r[2] for r in rows])).astype(np.int64)}) if rows else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def whole(vector: Column) -> Column:
    """Whether a vector has components that are all finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _reach(probes: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """For a query the length from which a candidate may be among its k best."""

    def run(ids: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for i, v in zip(ids, vectors):
            names, x = probes.get(len(v), (np.empty(0, np.int64), np.empty((0, len(v)))))
            q = np.asarray(v, float)
            scores, size = np.sort((x @ q)[names != i]), math.sqrt(float(q @ q))
            out.append(max(0.0, scores[-k] / size * (1 - 1e-9)) if len(scores) >= k and size else 0.0)
        return pd.Series(out, dtype=float)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best.

    ``vector`` holds whole numbers as doubles."""
    fits = F.col("id").isNotNull() & whole(F.col("v")) & (F.size("v") > 0)
    named = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(fits).withColumn("d", F.size("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    rows = named(candidates).withColumn("length", length)
    asked = named(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    common = rows.groupBy("d").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    if common is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = rows.where(F.col("d") == common.d).orderBy(F.desc("length"), "id").limit(PROBES).collect()
    probes = {common.d: (np.array([r.id for r in longest], np.int64), np.array([r.v for r in longest], float))}
    reached = asked.withColumn("need", F.pandas_udf(_reach(probes, k), "double")("id", "v"))
    shared_dir(candidates.sparkSession)
    wanted = cut(reached)
    n = wanted.count()
    query_blocks = max(1, -(-n // TASK_QUERIES))
    # queries of like need share a group, so that its least need says much
    bounds = wanted.approxQuantile("need", [i / query_blocks for i in range(1, query_blocks)], 0.01) if query_blocks > 1 else []
    group = sum((F.when(F.col("need") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    grouped = wanted.withColumn("qb", group)
    least = {r.qb: r.need for r in grouped.groupBy("qb").agg(F.min("need").alias("need")).collect()}
    if not least:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    needs = F.array(*[F.struct(F.lit(q).alias("qb"), F.lit(float(v)).alias("need")) for q, v in sorted(least.items())])
    # few and large groups, as a row goes to each of the other side's; but enough of them for all cores
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-common.c // TASK_ROWS), min(-(-common.c // block), 2 * cores))
    pack = lambda side: F.struct(F.lit(side).alias("query"), "id", "v")
    # rows are dealt by a hash of key and vector, so equal keys do not share a fate
    met = F.explode(F.transform(F.filter(needs, lambda n: F.col("length") * (1 + 1e-9) >= n["need"]), lambda n: n["qb"]))
    left = rows.select("d", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), met.alias("qb"), pack(False).alias("r"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    right = grouped.select("d", every.alias("block"), "qb", pack(True).alias("r"))
    best = left.union(right).select("d", "block", "qb", "r.*").groupBy("d", "block", "qb").applyInPandas(_task(k, block), OUT)
    within = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _task(k: int, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["query"].to_numpy()
        c, q = pdf[~is_query], pdf[is_query]
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return task_top_k(c["id"].to_numpy(), np.stack(c["v"].to_numpy()), q["id"].to_numpy(), np.stack(q["v"].to_numpy()), k, block)

    return run
