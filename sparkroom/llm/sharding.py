"""Sharding on a consistent-hash ring with bounded loads.

Every shard owns ``vnodes`` points of a ring of ``cells`` cells. A row's key
hashes to a cell; the next point clockwise names its home shard. A shard takes
rows up to its capacity; what overflows continues clockwise to the next point
whose shard has room. Capacities add up to the number of rows when ``slack`` is
0, so that shard counts differ by one at most; with more slack fewer rows leave
their home.

Only counts for each cell, of which there is a fixed number, reach the driver.
Rows get their rank inside a cell by a window, and a table of segments (cell,
rank range, shard, first slot) turns rank into shard and slot. A cell that holds
far more rows than the mean (a key that repeats) is split by a salt first.

Defined results: a null text has no bytes, so size 1 and checksum 0; a null key
is a key like any other; rows that are equal throughout each get a slot of
their own; an empty table gives no rows; columns other than the key and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkroom.llm.common import cut

SHARDS = 8
VNODES = 128
CELLS = 16384
#: A cell with so many times the mean, and at least so many rows, is salted.
HOT_TIMES, HOT_LEAST = 8, 20_000


def ring(n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; a cell has one owner."""
    owner: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.md5(f"{shard}:{v}".encode()).digest()[:8], "big") % cells
            owner[at] = min(shard, owner.get(at, shard))
    return sorted(owner.items())


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may take; at ``slack`` 0 they add up to ``rows``."""
    total = max(rows, int(rows * (1 + slack)))
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def segments(counts: dict[int, int], n_shards: int, slack: float, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot, home) of all rows."""
    points = ring(n_shards, vnodes, cells)
    room = capacities(sum(counts.values()), n_shards, slack)
    homes, p = {}, 0
    for cell in range(cells):
        while p < len(points) and points[p][0] < cell:
            p += 1
        homes[cell] = p % len(points)
    taken: list[tuple[int, int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []
    for cell in sorted(counts):
        home = points[homes[cell]][1]
        take = min(counts[cell], room[home])
        room[home] -= take
        if take:
            taken.append((cell, 0, take, home, home))
        if take < counts[cell]:
            over.append((cell, take, counts[cell]))
    for cell, lo, hi in over:
        p, home = homes[cell], points[homes[cell]][1]
        while lo < hi:
            p = (p + 1) % len(points)
            shard = points[p][1]
            take = min(hi - lo, room[shard])
            if take:
                room[shard] -= take
                taken.append((cell, lo, lo + take, shard, home))
                lo += take
    slot: dict[int, int] = defaultdict(int)
    out = []
    for cell, lo, hi, shard, home in sorted(taken):
        out.append((cell, lo, hi, shard, slot[shard], home))
        slot[shard] += hi - lo
    return out


def shard(df: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text", slack: float = 0.0, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """``key``, size, text_crc32, shard, slot and home_shard of every row."""
    spark = df.sparkSession
    hashed = F.xxhash64(F.col(key).cast("string"))
    cell = F.pmod(hashed, F.lit(cells)).cast("int")
    rows = {r.cell: r.n for r in df.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    whole = F.coalesce(F.col(text), F.lit(""))
    thin = df.select(
        F.col(key).alias("__key"),
        (F.octet_length(whole).cast("long") + 1).alias("__size"),
        F.crc32(whole).alias("__crc"),
        cell.alias("__cell"),
        hashed.alias("__hash"),
    )
    mean = sum(rows.values()) / cells
    hot = {c: 1 + n // max(HOT_LEAST, int(HOT_TIMES * mean)) for c, n in rows.items() if n > max(HOT_LEAST, HOT_TIMES * mean)}
    first: list[tuple[int, int, int]] = []
    if hot:
        # the salt is a row's place in the kept table, the same at every reading
        thin = cut(thin)
        salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(hot.items()) for x in kv]), F.col("__cell")), F.lit(1))
        thin = thin.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
        split = thin.where(F.col("__cell").isin(sorted(hot))).groupBy("__cell", "__salt").agg(F.count("*").alias("n")).collect()
        base: dict[int, int] = defaultdict(int)
        for r in sorted(split, key=lambda r: (r["__cell"], r["__salt"])):
            first.append((r["__cell"], r["__salt"], base[r["__cell"]]))
            base[r["__cell"]] += r.n
    else:
        thin = thin.withColumn("__salt", F.lit(0))
    inside = Window.partitionBy("__cell", "__salt").orderBy("__hash", "__key", "__crc", "__size")
    ranked = thin.withColumn("__rank", F.row_number().over(inside).cast("long") - 1)
    if first:
        bases = spark.createDataFrame(first, "__cell int, __salt int, __base long")
        ranked = ranked.join(F.broadcast(bases), ["__cell", "__salt"], "left").withColumn("__rank", F.col("__rank") + F.coalesce("__base", F.lit(0)))
    # no more segments than cells and shards together, so this side is small at any size
    plan = spark.createDataFrame(segments(rows, n_shards, slack, vnodes, cells), "__at int, __lo long, __hi long, __shard int, __first long, __home int")
    placed = ranked.join(F.broadcast(plan), (F.col("__cell") == F.col("__at")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return placed.select(
        F.col("__key").alias(key),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__first") + F.col("__rank") - F.col("__lo")).alias("slot"),
        F.col("__home").alias("home_shard"),
    )
