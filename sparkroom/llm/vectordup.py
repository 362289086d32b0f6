"""Embedding near-duplicates by randomised-rotation binary codes.

A vector of length one is turned by several random rotations; the signs of all turned
components are its code. The even rotations' signs, turned back and added up, give
an approximation, and so do the odd ones'; each is stored as its signs and one
correction factor, by which its product with the vector itself becomes 1. As the
remaining error is at right angles to the vector in a random direction, the product
of one vector's even approximation with the other's odd one is an unbiased estimate
of their cosine, and its spread follows from the factors. ``SPREADS`` such spreads
are the confidence bound: pairs whose bound stays under the limit are no links, all
others are compared exactly in double precision.

Which codes meet: tables of ``depth`` bits of the code; a pair at the limit agrees in
a table with chance (1 - angle / pi)^depth, and there are as many tables as find it
with a chance of ``RECALL`` (closer pairs more surely; with one task's rows there is
one table without bits, and nothing is missed but by the confidence bound). Codes go
to their buckets first, without vectors. Only codes with a candidate then get
their vectors, for the exact comparison in the same buckets. A pair is counted where it
meets first, in no other table. Buckets with too many rows are cut into chunks, and
each pair of chunks is a task, so a crowd costs time but loses no link.

Families of near copies are balls: a leader and all that lie within half the angle of
the limit around it. Members of a ball are links of each other without any
comparison, so they are counted by the ball's size and joined to its leader, and
chunks of one ball never meet. Leaders are taken from long codes that a thousandth
of all vectors (``LEADERS``) or more share, so there are few of them whatever the
input. No pair leaves a task: tasks give the number of links of each vector and a
spanning forest.

Defined results: vectors that are null, zero, or hold null or non-finite components
keep a row without links; equal vectors are links of each other and one vertex of
the search; vectors of different lengths never link; repeated keys are rows of their
own; a component of null keys alone has a null component_id; an empty table gives no
rows; other columns are not read. Lengths below 64 are filled up with zeros.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom.llm.common import cut
from sparkroom.llm.simhash import NO_ID, Forest, _by_key, components

LIMIT = 0.9
#: Chance that a pair just at the limit meets in some table.
RECALL = 0.995
#: Vectors of a bucket on average, of a chunk, and from which a bucket is cut.
TASK_ROWS, CHUNK, CROWD = 4096, 4096, 16_384
#: Bits of a code at least, and standard deviations of an estimate that are allowed for.
CODE_BITS, SPREADS = 512, 4.0
#: Leading bits that members of a family share, tables of them, and the least family:
#: a share of all vectors, at least so many.
LEADER_BITS, LEADER_TABLES, LEADERS, LEADER_LEAST = 16, 8, 1000, 256
#: Rows of a block of estimates.
BLOCK = 1024
SEED = 11

CODE = "code array<long>, even float, odd float"


def width(length: int) -> int:
    """Components after filling up: whole words of bits."""
    return 64 * max(1, -(-length // 64))


@functools.lru_cache(maxsize=8)
def rotations(length: int, bits: int) -> np.ndarray:
    """(rotation, width, width): an even number of random rotations with ``bits`` rows
    in all, at least."""
    d = width(length)
    rng = np.random.default_rng((SEED, d))
    n = 2 * max(1, -(-bits // (2 * d)))
    q, r = np.linalg.qr(rng.standard_normal((n, d, d)))
    return q * np.sign(np.einsum("kii->ki", r))[:, None, :]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; large and small components do not overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width(x.shape[1]) - x.shape[1])))


def encode(x: np.ndarray, bits: int = CODE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (words of 64 bits) of unit rows and the even and odd correction factors."""
    turns = rotations(x.shape[1], bits)
    full = padded(x)
    turned = np.einsum("nd,kpd->nkp", full, turns, optimize=True)
    signs = np.ascontiguousarray(np.packbits((turned > 0).reshape(len(x), -1), axis=1)).view(">u8").astype(np.uint64)
    size = np.abs(turned).sum(2)  # product of a vector with its signs turned back
    return signs, 1 / size[:, ::2].sum(1), 1 / size[:, 1::2].sum(1)


def decode(codes: np.ndarray, even: np.ndarray, odd: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Even and odd approximations, scaled by their factors."""
    turns = rotations(length, codes.shape[1] * 64)
    signs = np.unpackbits(np.ascontiguousarray(codes).astype(">u8").view(np.uint8), axis=1).reshape(len(codes), len(turns), -1).astype(np.float32) * 2 - 1
    back = lambda part, factor: np.einsum("nkp,kpd->nd", signs[:, part::2], turns[part::2].astype(np.float32), optimize=True) * factor[:, None].astype(np.float32)
    return back(0, even), back(1, odd)


def spread(a: np.ndarray, b: np.ndarray, d: int) -> float:
    """Standard deviation of the mean of both estimates, at most, for approximations
    ``a`` and ``b`` whose errors lie at right angles to their vectors."""
    error = max((np.square(v, dtype=float).sum(1).max(initial=1.0) - 1 for v in (a, b)), default=0.0)
    # one estimate: error of either side by the other's vector, and of both together; the
    # two estimates come from different rotations, so their errors are independent
    one = (2 * error + error * error) / max(d - 1, 1)
    return math.sqrt(one / 2)


def table_count(limit: float, depth: int) -> int:
    """Tables that find a pair at the limit with the wanted chance."""
    p = (1 - math.acos(limit) / math.pi) ** depth
    return 1 if p >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - p))


def table_key(t: int, depth: int) -> Column:
    """The ``t``-th run of ``depth`` bits of the code, which starts anew behind its end
    within a word's borders."""
    per = max(1, 64 // max(depth, 1))
    word, at = t // per, (t % per) * depth
    if not depth:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(F.shiftleft(F.get("code", F.lit(word)), at), 64 - depth)


def key_array(codes: np.ndarray, t: int, depth: int) -> np.ndarray:
    """``table_key`` of codes."""
    if not depth:
        return np.zeros(len(codes), np.uint64)
    per = max(1, 64 // depth)
    return (codes[:, t // per] << np.uint64((t % per) * depth)) >> np.uint64(64 - depth)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """name (two hashes), id (the least key), n (rows) and v of the different vectors."""
    return rows.where("name is not null").groupBy("name").agg(F.coalesce(F.min("key"), F.lit(NO_ID)).alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))


def _coded(bits: int):
    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in vectors:
            out = [None] * len(batch)
            lengths = batch.map(len).to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                codes, even, odd = encode(unit(np.stack(batch.to_numpy()[at]).astype(float)), bits)
                for i, c, a, b in zip(at, codes.view(np.int64), even, odd):
                    out[i] = (c, a, b)
            yield pd.DataFrame(out, columns=["code", "even", "odd"])

    return run


def _ball_of(leaders: dict[int, np.ndarray], inner: float):
    """For each vector the place of the first leader within the inner cosine."""

    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            out = np.full(len(batch), -1, np.int32)
            lengths = batch.map(len).to_numpy()
            for d in np.unique(lengths):
                if d in leaders:
                    at = np.flatnonzero(lengths == d)
                    places, centres = leaders[d]
                    near = unit(np.stack(batch.to_numpy()[at]).astype(float)) @ centres.T >= inner
                    out[at] = np.where(near.any(1), places[near.argmax(1)], -1)
            yield pd.Series(out)

    return run


def find_leaders(coded: DataFrame, total: int, inner: float) -> list[tuple[int, object, np.ndarray]]:
    """(id, name, unit vector) of one vector of each family: of long codes shared by
    many vectors the least member, unless a leader before it is as near as that."""
    words = max(1, CODE_BITS // 64)
    at = lambda t: F.shiftrightunsigned(F.get("code", F.lit(t % words)), 64 - LEADER_BITS) if t < words else F.lit(None).cast("long")
    runs = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), at(t).alias("top")) for t in range(min(LEADER_TABLES, words))]))
    many = coded.select(F.size("v").alias("d"), runs.alias("r"), F.struct("id", "name").alias("vertex")).groupBy("d", "r.t", "r.top").agg(F.count("*").alias("n"), F.min("vertex").alias("vertex"))
    # at most LEADERS codes a table
    large = many.where(F.col("n") > max(LEADER_LEAST, total // LEADERS)).select("vertex", "n").groupBy("vertex").agg(F.max("n").alias("n"))
    named = coded.join(F.broadcast(large.select(F.col("vertex.id").alias("id"), F.col("vertex.name").alias("name"), F.col("n").alias("crowd"))), ["id", "name"])
    out: list[tuple[int, object, np.ndarray]] = []
    for r in sorted(named.select("id", "name", "v", "crowd").collect(), key=lambda r: (-r.crowd, r.id, tuple(r.name))):
        x = unit(np.array([r.v], float))[0]
        if not any(len(x) == len(y) and x @ y >= inner for _, _, y in out):
            out.append((r.id, r.name, x))
    return out


def _pairs_of(limit: float, depth: int, exact: bool):
    """The task of a bucket or of two of its chunks: names of codes with a candidate, or
    (``exact``) numbers of links and the edges of a spanning forest."""

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d, t, lo, hi = int(key[0]), int(key[1]), int(key[3]), int(key[4])
        pdf = pdf.sort_values(["id", "h1", "h2"], kind="stable")
        codes = np.stack(pdf["code"].to_numpy()).view(np.uint64)
        even, odd = decode(codes, pdf["even"].to_numpy(), pdf["odd"].to_numpy(), d)
        bound = limit - SPREADS * spread(even, odd, width(d))
        ball, chunk, size = pdf["ball"].to_numpy(), pdf["chunk"].to_numpy(), pdf["n"].to_numpy()
        before = [key_array(codes, s, depth) for s in range(t)]
        x = unit(np.stack(pdf["v"].to_numpy()).astype(float)) if exact else None
        links, found = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        forest = Forest(len(pdf))
        for a in range(0, len(pdf), BLOCK):
            for b in range(a, len(pdf), BLOCK):
                estimate = (even[a : a + BLOCK] @ odd[b : b + BLOCK].T + odd[a : a + BLOCK] @ even[b : b + BLOCK].T) / 2
                i, j = np.nonzero(estimate >= bound)
                i, j = i + a, j + b
                open_ = (i < j) & ((ball[i] != ball[j]) | (ball[i] < 0))
                if lo != hi:  # two chunks: only pairs between them
                    open_ &= chunk[i] != chunk[j]
                i, j = i[open_], j[open_]
                for keys in before:  # a pair that met in an earlier table is counted there
                    new = keys[i] != keys[j]
                    i, j = i[new], j[new]
                if exact and len(i):
                    for s in range(0, len(i), BLOCK * 64):
                        p, q = i[s : s + BLOCK * 64], j[s : s + BLOCK * 64]
                        near = np.einsum("nd,nd->n", x[p], x[q]) >= limit
                        p, q = p[near], q[near]
                        np.add.at(links, p, size[q])
                        np.add.at(links, q, size[p])
                        forest.link(p, q)
                elif len(i):
                    found[i] = found[j] = True
        if not exact:
            return pdf.loc[found, ["id", "h1", "h2"]].assign(d=d, t=t, top=key[2], lo=lo, hi=hi, chunk=chunk[found])
        root = forest.root
        own = np.flatnonzero(links > 0)
        out = pdf.iloc[own][["id", "h1", "h2"]].assign(links=links[own])
        return out.assign(**{f"r_{c}": pdf[c].to_numpy()[root[own]] for c in ("id", "h1", "h2")})

    return task


ACTIVE = "id long, h1 long, h2 long, d int, t int, top long, lo int, hi int, chunk int"
LINKS = "id long, h1 long, h2 long, links long, r_id long, r_h1 long, r_h2 long"


def _dealt(codes: DataFrame, depth: int, tables: int, crowd: int, chunk: int) -> DataFrame:
    """Codes in their buckets; those of crowded ones in pairs of chunks. Members of one
    ball share chunks that hold nothing else."""
    runs = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), table_key(t, depth).alias("top")) for t in range(tables)]))
    rows = codes.select("*", runs.alias("r")).select("*", "r.*").drop("r")
    full = rows.groupBy("d", "t", "top").agg(F.count("*").alias("m")).where(F.col("m") > crowd)
    cells = rows.join(F.broadcast(full.select("d", "t", "top")), ["d", "t", "top"]).groupBy("d", "t", "top", "ball").agg(F.count("*").alias("m")).collect()
    if not cells:
        return rows.select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("chunk"))
    # small balls share chunks with what is in none
    groups: dict[tuple, dict[int, int]] = {}
    for r in cells:
        own = groups.setdefault((r.d, r.t, r.top), {-1: 0})
        ball = r.ball if r.m > chunk else -1
        own[ball] = own.get(ball, 0) + r.m
    plan = []
    for (d, t, top), own in groups.items():
        at, places = 0, {}
        for ball, m in sorted(own.items()):
            places[ball] = (at, max(1, -(-m // chunk)))
            at += places[ball][1]
        plan += [(d, t, top, r.ball, *places[r.ball if r.m > chunk else -1], at) for r in cells if (r.d, r.t, r.top) == (d, t, top)]
    cellar = codes.sparkSession.createDataFrame(plan, "d int, t int, top long, ball int, first int, chunks int, all int")
    placed = rows.join(F.broadcast(cellar), ["d", "t", "top", "ball"], "left")
    mine = F.coalesce(F.col("first") + F.pmod(F.xxhash64("id", "name"), F.col("chunks")).cast("int"), F.lit(0))
    # a chunk meets all others but those of its own ball, and itself unless it is a ball's;
    # what is in no large ball has the first chunks
    apart = lambda c: (F.col("first") == 0) | (c < F.col("first")) | (c >= F.col("first") + F.col("chunks"))
    others = F.when(F.col("first").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("all") - 1), apart))
    spread_ = placed.withColumn("chunk", mine).withColumn("other", F.explode(others))
    return spread_.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("other", "first", "chunks", "all")


def link_counts(vectors: DataFrame, limit: float = LIMIT, task_rows: int = TASK_ROWS, crowd: int = CROWD, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of different vectors (name, id, n, v): the vectors with their ball and code; rows
    (id, name, links) to be added up; and edges u > v."""
    inner = math.sqrt((1 + limit) / 2) + 1e-9  # within it around a leader, any two are within the limit
    total = vectors.count()
    depth = min(32, (max(total, 1) // task_rows).bit_length())
    tables = table_count(limit, depth)
    bits = max(CODE_BITS, 64 * -(-tables // max(1, 64 // max(depth, 1))))
    coded = cut(vectors.select("*", F.pandas_udf(_coded(bits), CODE)("v").alias("c")).select("name", "id", "n", "v", "c.*"))
    leaders = find_leaders(coded, total, inner)
    at = {}
    for d in {len(x) for _, _, x in leaders}:
        own = [i for i, (_, _, x) in enumerate(leaders) if len(x) == d]
        at[d] = (np.array(own, np.int32), np.stack([leaders[i][2] for i in own]))
    ball = F.pandas_udf(_ball_of(at, inner), "int")("v") if leaders else F.lit(-1)
    known = coded.withColumn("ball", ball)
    thin = known.select("id", "name", "n", "ball", "code", "even", "odd", F.size("v").alias("d"))
    dealt = _dealt(thin, depth, tables, max(crowd, total // LEADERS), max(chunk, total // LEADERS))
    group = ["d", "t", "top", "lo", "hi"]
    flat = dealt.select(*group, "chunk", "id", "name.h1", "name.h2", "n", "ball", "code", "even", "odd")
    active = flat.groupBy(*group).applyInPandas(_pairs_of(limit, depth, False), ACTIVE)
    named = known.select("id", "name.h1", "name.h2", "n", "ball", "code", "even", "odd", "v")
    whole = active.join(named, ["id", "h1", "h2"])
    found = cut(whole.groupBy(*group).applyInPandas(_pairs_of(limit, depth, True), LINKS))
    vertex = lambda p: F.struct(F.col(f"{p}id").alias("id"), F.struct(F.col(f"{p}h1").alias("h1"), F.col(f"{p}h2").alias("h2")).alias("name"))
    edges = found.select(vertex("").alias("u"), vertex("r_").alias("v")).where("u <> v")
    if leaders:
        centre = F.get(F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.struct(F.lit(n.h1).alias("h1"), F.lit(n.h2).alias("h2")).alias("name")) for i, n, _ in leaders]), F.col("ball"))
        own = known.where("ball >= 0").select(F.struct("id", "name").alias("u"), centre.alias("v")).where("u <> v")
        edges = edges.unionByName(own)
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return known, found, ordered


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, **sizes: int) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    x = F.col(vector)
    fits = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    name = F.when(fits, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    rows = df.select(F.col(key).cast("long").alias("key"), name.alias("name"), x.alias("v"))
    vectors = cut(distinct_vectors(rows))
    known, found, edges = link_counts(vectors, limit, **sizes)
    roots = components(edges).select(F.col("u.id").alias("id"), F.col("u.name").alias("name"), F.col("root.id").alias("root"))
    sums = found.groupBy("id", F.struct("h1", "h2").alias("name")).agg(F.sum("links").alias("links"))
    balls = known.where("ball >= 0").groupBy("ball").agg(F.sum("n").alias("members"))
    joined = known.select("id", "name", "n", "ball").join(sums, ["id", "name"], "left").join(roots, ["id", "name"], "left").join(F.broadcast(balls), "ball", "left")
    own = F.coalesce("members", "n") - 1 + F.coalesce("links", F.lit(0))
    settled = joined.select("name", own.alias("n_links"), F.coalesce("root", "id").alias("root"), "n")
    linked = _by_key(cut(rows.where("name is not null").select("key", "name")), cut(settled), "name", vectors.agg(F.sum("n")).first()[0] or 0)
    alone = rows.where("name is null").select("key", F.lit(0).cast("long").alias("n_links"), F.coalesce("key", F.lit(NO_ID)).alias("root"))
    both = linked.select("key", "n_links", "root").unionByName(alone)
    component = F.nullif("root", F.lit(NO_ID))
    return both.select(F.col("key").alias("vec_id"), "n_links", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
