"""Centroid clustering of whole-number vectors with bounds loosened by planar geometry.

Each row carries an upper bound of the distance to its own centroid and a lower
bound of the distance to every other one. After the centroids have moved, the upper
bound grows by its centroid's move. How much the lower bound must shrink depends on
where the cluster lies: its rows are in a sphere around the old centroid whose radius
is the largest upper bound of the cluster. Another centroid that moves from ``p`` to
``q`` comes nearer to a point by at most ``|pq| cos(a)``, where ``a`` is the angle at
the middle of ``pq`` between the move and the point (all points that gain more lie in
a narrower cone around the move). In the plane of the sphere's centre, ``p`` and
``q`` the least such angle of the sphere is that of its centre less the angle that
the sphere fills, so clusters beside or behind a move loosen little or nothing, and
none more than the whole drift.

A row keeps its cluster while its upper bound is under its lower bound or under half
the distance from its centroid to the next one; else its own distance is computed,
and if that does not settle it, all centroids are compared exactly. Ties and all
results are those of whole-number arithmetic.

A round is one pass over a table of vectors and bounds, written to the shared folder,
from which sums and radii are then aggregated; only the centroids (``k`` rows) and
their sums come to the driver. A lost executor's tasks are read again from the table
of the round before.

Defined results: vectors that are null, of another number of components, or with
null or non-finite components are left out, as are those with a component of
``2^27`` or more after scaling, whose distances would not fit a long; null keys take
part (as an empty name in the order of starts); repeated rows are rows of their own,
and may give equal starts, of which the smaller number gets all rows; fewer rows
than ``k`` start as many clusters; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom.llm.common import scratch_path

K, ROUNDS, SCALE, LENGTH = 40, 5, 256, 64
#: Components must be under this size; from SMALL on, sums are not exact in doubles.
LARGEST, SMALL = 2**27, 2**21
#: Bounds are doubles of exact squares; a relative margin keeps them on the safe side.
MARGIN = 1e-9
#: Rows of a block of the exact comparison.
BLOCK = 8192

STATE = "key long, v array<int>, cluster int, upper double, lower double, exact long"


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int, length: int) -> DataFrame:
    """key and v, the scaled whole numbers of the vectors that take part."""
    x = F.col(vector)
    fits = x.isNotNull() & (F.size(x) == length) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < LARGEST))
    return df.where(fits).select(F.col(key).cast("long").alias("key"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("v"))


def starts(rows: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The ``k`` vectors whose seeded names hash least, as the first centroids."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in rows.orderBy(name, "key", "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < SMALL else np.int64
    a, b = x.astype(kind), c.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return d.astype(np.int64)


def own_squared(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    diff = x.astype(np.int64) - c[cluster]
    return (diff * diff).sum(1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the most by which another centroid came nearer to any point of
    its sphere: the largest entry of its row of ``gains``, its own one left out."""
    g = gains(old, new, radius)
    np.fill_diagonal(g, 0.0)
    return g.max(axis=1, initial=0.0)


def gains(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(cluster, centroid): a bound of how much nearer the centroid's move from ``old``
    to ``new`` brings it to any point within ``radius`` of the cluster's old centroid."""
    move = (new - old).astype(float)
    drift = np.sqrt((move * move).sum(1))
    middle = (old + new) / 2
    to = old[:, None, :] - middle[None, :, :]
    far = np.sqrt((to * to).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip(np.einsum("ijd,jd->ij", to, move) / (far * drift), -1, 1)
        filled = np.arcsin(np.minimum(radius[:, None] / far, 1.0))
    least = np.where(far > radius[:, None], np.maximum(np.arccos(cosine) - filled, 0.0), 0.0)
    bound = drift * np.clip(np.cos(least), 0.0, 1.0) * (1 + MARGIN)
    return np.where(drift > 0, np.minimum(np.nan_to_num(bound, nan=np.inf), drift * (1 + MARGIN)), 0.0)


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), its squared distance, and the
    distance to the next other one."""
    d = squared(x, c)
    best = d.argmin(1)
    rows = np.arange(len(x))
    least = d[rows, best]
    if len(c) == 1:
        return best, least, np.full(len(x), np.inf)
    d[rows, best] = np.iinfo(np.int64).max
    return best, least, np.sqrt(d.min(1).astype(float)) * (1 - MARGIN)


def tighten(x: np.ndarray, c: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters, bounds and squared distances (-1 where not computed) under the
    centroids ``c``, for bounds that hold for them; and how many rows were scanned."""
    apart = np.sqrt(squared(c, c).astype(float))
    np.fill_diagonal(apart, np.inf)
    half = apart.min(axis=1, initial=np.inf) / 2 * (1 - MARGIN)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    exact = np.full(len(x), -1, np.int64)
    safe = np.maximum(lower, half[cluster])
    doubt = np.flatnonzero(upper >= safe) if not last else np.arange(len(x))
    exact[doubt] = own_squared(x[doubt], c, cluster[doubt])
    upper[doubt] = np.sqrt(exact[doubt].astype(float)) * (1 + MARGIN)
    scan = doubt[upper[doubt] >= safe[doubt]]
    for at in range(0, len(scan), BLOCK):
        some = scan[at : at + BLOCK]
        cluster[some], exact[some], lower[some] = assign(x[some], c)
        upper[some] = np.sqrt(exact[some].astype(float)) * (1 + MARGIN)
    return cluster, upper, lower, exact, len(scan)


def _pass(c: np.ndarray, drift: np.ndarray | None, loose: np.ndarray | None, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if drift is None:
                cluster, exact, lower = assign(x, c)
                upper = np.sqrt(exact.astype(float)) * (1 + MARGIN)
            else:
                cluster = batch.column("cluster").to_numpy()
                upper = batch.column("upper").to_numpy() + drift[cluster]
                lower = batch.column("lower").to_numpy() - loose[cluster]
                cluster, upper, lower, exact, _ = tighten(x, c, cluster, upper, lower, last)
            arrays = [batch.column("key"), v, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(exact)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "v", "cluster", "upper", "lower", "exact"])

    return run


def _moved(rows: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after the rows' means, rounded down, and each cluster's radius."""
    sums = [F.sum(F.get("v", F.lit(j)).cast("long")).alias(f"s{j}") for j in range(c.shape[1])]
    new, radius = c.copy(), np.zeros(len(c))
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), *sums).collect():
        new[r.cluster] = [r[f"s{j}"] // r.n for j in range(c.shape[1])]
        radius[r.cluster] = r.radius
    return new, radius


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, length: int = LENGTH) -> tuple[DataFrame, np.ndarray]:
    """key, v, cluster and exact (the squared distance) of every vector that takes
    part, and the last centroids."""
    rows = whole_vectors(df, key, vector, scale, length)
    c = starts(rows, k)
    if not len(c):
        return df.sparkSession.createDataFrame([], STATE), c
    state, drift, loose = rows, None, None
    for _ in range(rounds):
        path = scratch_path(df.sparkSession, "centroids")
        state.mapInArrow(_pass(c, drift, loose, False), STATE).write.parquet(path)
        state = df.sparkSession.read.parquet(path)
        new, radius = _moved(state, c)
        drift = np.sqrt(((new - c).astype(float) ** 2).sum(1)) * (1 + MARGIN)
        loose, c = loosening(c, new, radius), new
    path = scratch_path(df.sparkSession, "centroids")
    state.mapInArrow(_pass(c, drift, loose, True), STATE).write.parquet(path)
    return df.sparkSession.read.parquet(path), c


def with_inertia(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """Rows of ``cluster`` with cluster_inertia, inertia and their centroid's hash."""
    total = lambda name: F.sum(F.col("exact").cast("decimal(38,0)")).alias(name)
    own = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(total("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster")) if values else F.lit(None).cast(kind)
    columns = {"cluster_inertia": at([own.get(i, 0) for i in range(len(c))], "long"), "inertia": F.lit(sum(own.values())).cast("long"), "centroid_sha256": at(names, "string")}
    return rows.withColumns(columns)


def distance() -> Column:
    return F.col("exact").alias("distance")
