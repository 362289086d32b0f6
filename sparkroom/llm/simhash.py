"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint bit is 1 where over half of a text's shingle hashes have it.
Distinct fingerprints form a binary trie; pairs of its nodes are walked together
from the top, differing bits add up, and a pair is pruned as soon as it is over
its error budget.

``near_duplicates`` links fingerprints of 64 bits at 4 or fewer differing ones.
Three tries are walked, each over the bits turned by a third of their length: of
at most 4 differing bits some third holds at most one, so in each trie the
leading third has a budget of 1 and the whole one of 4, and no link is missed.
The top levels of a trie deal the work: the node pairs at depth ``d`` within the
leading budget (a node with itself, or with one that differs in one bit) are the
tasks, and each fingerprint goes to d + 1 of them in each trie, 63 at most. Node
pairs with a crowded node are dealt at the leading third's whole depth.

``similar_documents`` links texts whose sets of shingles have a Jaccard
similarity of ``similarity`` or more. Such pairs differ in up to 15 % of the bits
of a fingerprint, so it takes ``WIDE`` bits and walks a trie over each of several
stretches of them: a task holds the texts that agree in a stretch's first bits
and walks the next ones with a budget. As many stretches are walked as find a
pair just at the similarity with a chance of ``RECALL``; closer pairs are found
more surely. Distances far under the limit are links; distances around it are
compared set by set, exactly. Links that the tries leave out come from a prefix
filter (``left_out``), which is exact: two sets of a link share one of the first
shingles of each in any one order of all shingles. Only pairs of different groups
are looked at there, so that families that the tries have linked cost nothing.

Tasks give a spanning forest of the links that they find, no pairs. Vertices are
named by their least document, so that components, which grow from the links by
alternating large-star and small-star steps, are named by theirs.

Defined results: a null text, or one without words, has fingerprint 0 (and an
empty set) and is linked like any other; fewer words than a shingle are one
shingle; equal rows each keep a row; a component whose doc_ids are all null has a
null component_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkroom.llm.common import cut, small_batches

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Bits by which each trie is turned, and its leading part.
TURNS, LEAD_BITS, LEAD_BUDGET = (0, 21, 42), 21, 1
#: Distinct fingerprints that a task gets on average; fixes the dealing depth.
TASK_ROWS = 1024
#: Rows that a group of tasks gets on average.
GROUP_ROWS = 1 << 15
MIN_DEPTH, MAX_DEPTH = 6, 20
#: Fingerprints of a node from which its tasks are dealt deeper.
CROWDED = 20_000
#: Node pairs in memory at once, and fingerprint pairs from which a node pair is compared leaf by leaf.
FRONTIER, LEAVES = 1 << 18, 64
#: A key with over a ten-thousandth of all rows, and so many rows at least, is
#: joined by broadcast: that is 10,000 keys at most. Smaller tables have one join.
HOT_KEYS, HOT_LEAST, SMALL = 10_000, 100, 5_000

#: Bits of a wide fingerprint, texts in a task on average, and the walk's bits and budget.
WIDE, WIDE_TASK, WALK_BITS, WALK_BUDGET = 1024, 4096, 14, 3
RECALL = 0.995
#: Standard deviations between the limit and a distance that needs no comparing, and shingles that this takes.
SURE_BY, SURE_LEAST = 3.5, 64
#: Compared texts up to which their names are broadcast.
BROADCAST_ROWS = 500_000
#: Texts whose shingles are counted, and counts from which a shingle comes late in
#: the order of all shingles (the order decides the work alone), and how many do.
ORDER_TEXTS, ORDER_LEAST, ORDER_MOST = 10_000, 3, 200_000
#: Rows of a prefix-filter task on average, of one shingle in a task, and pairs in memory at once.
PREFIX_ROWS, PREFIX_CROWD, PREFIX_PAIRS = 1 << 17, 1 << 17, 1 << 19
#: Stands for a null doc_id, the last of all.
NO_ID = 2**63 - 1

VERTEX = "struct<id:long,name:long>"


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of every shingle of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(shingle, len(words))
    start, stop = np.concatenate(([0], ends[: len(words) - size])), ends[size - 1 :] - 1
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist())], np.uint64)


def _majority(words: np.ndarray, step: int = 255) -> np.ndarray:
    """Bits set in over half of the rows of 64-bit words. Sums of ``step`` rows fit
    a byte."""
    n, width = words.shape
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, n, step):
        bits = np.unpackbits(words[at : at + step].astype(">u8").view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a whole text."""
    return int(_majority(shingle_hashes(text, shingle)[:, None])[0])


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` bits of a set of hashes; each word of them mixes the hashes anew."""
    ones = [np.zeros(0, np.uint64)] * (WIDE // 64)
    with np.errstate(over="ignore"):
        for i in range(len(ones)):  # the published 64-bit finalizer over hashes moved by odd steps
            z = hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & NO_ID * 2 + 1)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            ones[i] = z ^ z >> np.uint64(31)
    return _majority(np.stack(ones, axis=1))


def _fingerprints(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in text:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64), index=batch.index)


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long with the same bits."""
    return F.pandas_udf(_fingerprints, LongType())(text)


class Forest:
    """Sets of the places of a sorted array; a root is its set's least place."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(nxt := self.root[self.root], self.root):
                self.root = nxt


def _pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of each interval a with all of its interval b."""
    na, nb = a1 - a0, b1 - b0
    total = na * nb
    which = np.repeat(np.arange(len(total)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return a0[which] + k // nb[which], b0[which] + k % nb[which]


def walk(keys: np.ndarray, depth: int, budget: Callable[[int], int], forest: Forest, compare: Callable[[np.ndarray, np.ndarray], None], cross: bool = False, frontier: int | None = None) -> None:
    """Walk pairs of nodes of the trie over the sorted ``keys``, which share their
    first ``depth`` bits or (``cross``) are two nodes of that depth to be paired;
    call ``compare`` with the places of the leaf pairs that no budget has pruned.
    Pairs of nodes whose members are all one set of ``forest`` are left out."""
    n = len(keys)
    if n < 2:
        return
    top = keys >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    half = int(np.searchsorted(top, top[-1]))
    if cross and not half:
        return
    first = (0, half, half, n, int(np.bitwise_count(top[0] ^ top[-1]))) if cross else (0, n, 0, n, 0)
    stack = [(depth, *(np.array([v]) for v in first))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > (frontier or FRONTIER):
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, err))), (bit, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        # a pair of nodes that are one set already has nothing to add
        change = np.concatenate(([0], np.cumsum(forest.root[1:] != forest.root[:-1])))
        same = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (forest.root[a0] == forest.root[b0])
        a0, a1, b0, b1, err = (x[~same] for x in (a0, a1, b0, b1, err))
        small = ((a1 - a0) * (b1 - b0) <= LEAVES) | (bit >= 64)
        if small.any():
            i, j = _pairs(a0[small], a1[small], b0[small], b1[small])
            compare(i[i < j], j[i < j])
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        mask = np.uint64((~((1 << (64 - bit)) - 1)) & (2**64 - 1))
        mark = np.uint64(1 << (63 - bit))
        am = np.clip(np.searchsorted(keys, (keys[a0] & mask) | mark), a0, a1)
        bm = np.clip(np.searchsorted(keys, (keys[b0] & mask) | mark), b0, b1)
        self_pair = a0 == b0
        parts = [
            (a0, am, b0, bm, err, np.full(len(a0), True)),
            (am, a1, bm, b1, err, np.full(len(a0), True)),
            (a0, am, bm, b1, err + 1, np.full(len(a0), True)),
            (am, a1, b0, bm, err + 1, ~self_pair),
        ]
        joined = [np.concatenate(x) for x in zip(*parts)]
        alive = joined[5] & (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget(bit))
        if alive.any():
            stack.append((bit + 1, *(x[alive] for x in joined[:5])))


def trie_forest(keys: np.ndarray, depth: int, cross: bool) -> np.ndarray:
    """Roots of the sorted distinct ``keys`` (turned, unsigned), linked by the walk
    from ``depth``: one node with itself, or (``cross``) two nodes that differ there."""
    forest = Forest(len(keys))

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(keys[i] ^ keys[j]) <= MAX_BITS
        forest.link(i[near], j[near])

    walk(keys, depth, lambda bit: LEAD_BUDGET if bit < LEAD_BITS else MAX_BITS, forest, compare, cross)
    return forest.root


def _stars(root: np.ndarray, ids: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of every member of a set but its least vertex, and of that vertex."""
    order = np.lexsort((names, ids, root))
    first = np.concatenate(([True], root[order][1:] != root[order][:-1])) if len(order) else np.empty(0, bool)
    centre = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    return order[~first], centre[~first]


def _turn(fp: Column, bits: int) -> Column:
    return fp if not bits else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def links(prints: DataFrame, task_rows: int = TASK_ROWS, crowded: int = CROWDED) -> DataFrame:
    """u > v, vertices of id and name (the fingerprint): links between distinct
    fingerprints (columns ``fp`` and ``id``) that span every component of the link
    relation."""
    n = prints.count()
    depth = min(MAX_DEPTH, max(MIN_DEPTH, (max(n, 1) // task_rows).bit_length()))
    tries = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), _turn(F.col("fp"), t).alias("key")) for t in TURNS]))
    keyed = prints.select(tries.alias("t"), "id").select("t.*", "id")
    node = lambda d: F.shiftrightunsigned("key", 64 - d)
    flips = lambda top, a, b: [top.bitwiseXOR(F.lit(1 << j)) for j in range(a, b)]
    full = keyed.groupBy("turn", node(depth).alias("top")).agg(F.count("*").alias("n")).where(F.col("n") > max(crowded, n // HOT_KEYS)).select("turn", "top").collect()

    def pairs(rows: DataFrame, tops: list[Column], other: Column, d: int) -> DataFrame:
        own = tops[0]
        return rows.select("turn", "key", "id", own.alias("top"), F.explode(other).alias("other")).select("turn", "key", "id", F.lit(d).alias("depth"), F.least("top", "other").alias("lo"), F.greatest("top", "other").alias("hi"))

    dealt = pairs(keyed, [node(depth)], F.array(node(depth), *flips(node(depth), 0, depth)), depth)
    if full:
        hot = F.lit(False)
        for t in TURNS:
            tops = [r.top for r in full if r.turn == t]
            if tops:
                hot = hot | ((F.col("turn") == t) & (F.col("lo").isin(tops) | F.col("hi").isin(tops)))
        more = LEAD_BITS - depth
        deep = node(LEAD_BITS)
        # both nodes of a pair that differs already go on in step; a node with itself has its budget left
        apart = F.shiftleft(F.col("lo").bitwiseXOR(F.col("hi")), more)
        other = F.when(F.col("lo") == F.col("hi"), F.array(deep, *flips(deep, 0, more))).otherwise(F.array(deep.bitwiseXOR(apart)))
        dealt = dealt.where(~hot).union(pairs(dealt.where(hot), [deep], other, LEAD_BITS))

    def tasks(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids, turn, d, lo, hi = pdf.key.to_numpy().view(np.uint64), *(pdf[c].to_numpy() for c in ("id", "turn", "depth", "lo", "hi"))
        order = np.lexsort((keys, hi, lo, d, turn))
        keys, ids, turn, d, lo, hi = (x[order] for x in (keys, ids, turn, d, lo, hi))
        new = (np.diff(turn) != 0) | (np.diff(d) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
        out = [np.empty((4, 0), np.int64)]
        for a, b in itertools.pairwise([0, *(np.flatnonzero(new) + 1).tolist(), len(keys)]):
            if b - a > 1:
                own, t = keys[a:b], int(turn[a])
                fps = (((own >> np.uint64(t)) | (own << np.uint64(64 - t))) if t else own).view(np.int64)
                member, centre = _stars(trie_forest(own, int(d[a]), lo[a] != hi[a]), ids[a:b], fps)
                out.append(np.stack((ids[a:b][member], fps[member], ids[a:b][centre], fps[centre])))
        return pd.DataFrame(dict(zip(("u_id", "u_name", "v_id", "v_name"), np.concatenate(out, axis=1))))

    # tasks that are small share a group
    groups = max(1, 3 * n * (depth + 1) // GROUP_ROWS)
    named = dealt.withColumn("group", F.pmod(F.xxhash64("turn", "depth", "lo", "hi"), F.lit(groups)))
    found = named.groupBy("group").applyInPandas(tasks, "u_id long, u_name long, v_id long, v_name long").distinct()
    return found.select(*[F.struct(F.col(f"{c}_id").alias("id"), F.col(f"{c}_name").alias("name")).alias(c) for c in "uv"])


def _by_key(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows``, so many in all, joined with ``side``, which has one row for each key
    and, in ``n``, the rows that it meets. Crowded keys are broadcast, so that no
    task gets all rows of one."""
    plain = side.drop("n")
    if total <= SMALL:
        return rows.join(plain, key)
    hot = F.col("n") > max(HOT_LEAST, total // HOT_KEYS)
    crowd = F.broadcast(side.where(hot).drop("n"))
    return rows.join(crowd, key).unionByName(rows.join(crowd.select(key), key, "left_anti").join(side.where(~hot).drop("n"), key))


def components(edges: DataFrame) -> DataFrame:
    """u and root, the least member of its component, of every linked u > root.

    Large-star joins each node's larger neighbours to its least neighbour,
    small-star its smaller ones; both keep the components, and edges are stars
    when neither changes anything."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = cut(edges)
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _by_key(both.where("v > u"), least, "u", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node's own edges to lesser ones are few after a large-star
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        if (after := state(edges)) == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row; ``key`` holds whole numbers."""
    thin = cut(df.select(F.col(key).cast("long").alias("doc_id"), fingerprint_column(F.col(text)).alias("fp")))
    prints = cut(thin.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), F.count("*").alias("n")))
    found = components(links(prints.select("fp", "id")))
    roots = found.select(F.col("u.name").alias("fp"), F.col("root.id").alias("root"))
    named = prints.join(roots, "fp", "left").select("fp", F.nullif(F.coalesce("root", "id"), F.lit(NO_ID)).alias("component_id"), "n")
    return _by_key(thin, cut(named), "fp", thin.count()).select("doc_id", "fp", "component_id")


def _sketch_column(text: Column, shingle: int) -> Column:
    """The set's name, its size, and its wide fingerprint."""

    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                one = np.unique(shingle_hashes(t, shingle))
                name = np.uint64(xxhash.xxh64_intdigest(one.tobytes())).astype(np.int64)
                out.append((name, len(one), wide_fingerprint(one).view(np.int64)))
            yield pd.DataFrame(out, columns=["name", "size", "fp"], index=batch.index)

    return F.pandas_udf(sketch, "name long, size int, fp array<long>")(text)


def _set_column(text: Column, shingle: int) -> Column:
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch], index=batch.index)

    return F.pandas_udf(sets, ArrayType(LongType()))(text)


def _share(cosine: float) -> float:
    """Part of the bits that differ between texts of a cosine, on average."""
    return math.acos(min(1.0, cosine)) / math.pi


def _limits(similarity: float) -> tuple[int, int, int]:
    """Distances up to which a pair is a link for sure, may be one, and may be one
    if a set is small."""
    off = lambda p: SURE_BY * math.sqrt(WIDE * p * (1 - p))
    at, sure = _share(2 * similarity / (1 + similarity)), _share(math.sqrt(similarity))
    return int(WIDE * sure - off(sure)), int(WIDE * at + off(at)), int(WIDE * at * 1.25 + off(at))


def _stretches(similarity: float, depth: int) -> int:
    """Tries that find a pair at the similarity with the wanted chance, as far as
    the fingerprint has stretches of 32 bits."""
    p = _share(2 * similarity / (1 + similarity))
    within = sum(math.comb(WALK_BITS, k) * p**k * (1 - p) ** (WALK_BITS - k) for k in range(WALK_BUDGET + 1))
    one = (1 - p) ** depth * within
    return min(WIDE // 32, math.ceil(math.log(1 - RECALL) / math.log(1 - one))) if one < 1 else 1


def _closest(forest: Forest, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs that join the sets of ``forest`` at the least distances."""
    joined = Forest(len(forest.root))
    joined.root = forest.root.copy()
    order = np.lexsort((j, i, d))
    i, j, chosen = i[order], j[order], []
    left = np.arange(len(order))
    while len(left):
        a, b = joined.root[i[left]], joined.root[j[left]]
        left, a, b = (x[a != b] for x in (left, a, b))
        best = np.full(len(joined.root), len(order))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        take = np.unique(best[best < len(order)])
        chosen.append(take)
        joined.link(i[take], j[take])
    return order[np.concatenate(chosen)] if chosen else order


def _similar_task(similarity: float, depth_of: Callable[[tuple], int]):
    sure_at, at, small_at = _limits(similarity)
    out = ["u_id", "u_name", "v_id", "v_name", "sure"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, depth = int(key[0]), depth_of(key)
        wide = np.stack(pdf.fp.to_numpy()).view(np.uint64)
        word = wide[:, t // 2]
        keys = word if t % 2 == 0 else (word << np.uint64(32)) | (wide[:, (t // 2 + 1) % wide.shape[1]] >> np.uint64(32))
        order = np.argsort(keys, kind="stable")
        keys, wide = keys[order], wide[order]
        ids, names, sizes = (pdf[c].to_numpy()[order] for c in ("id", "name", "size"))
        forest, held = Forest(len(keys)), [np.empty((3, 0), np.int64)]

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            open_ = forest.root[i] != forest.root[j]
            i, j = i[open_], j[open_]
            d = np.zeros(len(i), np.int64)
            for w in range(wide.shape[1]):
                d += np.bitwise_count(wide[i, w] ^ wide[j, w])
                if w == 3:  # a quarter of the bits drops most pairs
                    some = d <= small_at // 2
                    i, j, d = i[some], j[some], d[some]
            least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            fits = (d <= np.where(least < SURE_LEAST, small_at, at)) & (least >= similarity * most)
            sure = fits & (d <= sure_at) & (least >= SURE_LEAST)
            forest.link(i[sure], j[sure])
            rest = fits & ~sure
            held.append(np.stack([i[rest], j[rest], d[rest]]))
            if sum(h.shape[1] for h in held) > 1 << 18:
                joined = np.concatenate(held, axis=1)
                held[:] = [joined[:, _closest(forest, *joined)]]

        walk(keys, depth, lambda bit: WALK_BUDGET if bit < depth + WALK_BITS else 64, forest, compare, frontier=1 << 14)
        member, centre = _stars(forest.root, ids, names)
        joined = np.concatenate(held, axis=1)
        i, j = joined[:2, _closest(forest, *joined)]
        u, v = np.concatenate((member, i)), np.concatenate((centre, j))
        return pd.DataFrame(dict(zip(out, (ids[u], names[u], ids[v], names[v], np.arange(len(u)) < len(member)))))

    return run


def similar_links(sets: DataFrame, similarity: float, task_rows: int = WIDE_TASK) -> DataFrame:
    """u > v, vertices, and whether they are similar for sure, of distinct sets
    (columns name, id, size, fp)."""
    n = sets.count()
    depth = min(24, max(2, (max(n, 1) // task_rows).bit_length()))
    stretches = range(_stretches(similarity, depth))
    head = lambda t: F.get("fp", F.lit(t // 2)) if t % 2 == 0 else F.shiftleft(F.get("fp", F.lit(t // 2)), 32)
    tops = sets.select("name", "id", "size", "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.shiftrightunsigned(head(t), 32).alias("head")) for t in stretches])).alias("s")).select("name", "id", "size", "fp", "s.*")
    node = lambda d: F.shiftrightunsigned("head", 32 - d)
    # a crowded node (a family of near copies) is dealt by more bits, as its count asks
    most = max(4 * task_rows, n // HOT_KEYS)
    full = tops.groupBy("t", node(depth).alias("top")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()
    deeper = F.lit(depth)
    for bits in sorted({(r.n // task_rows).bit_length() for r in full}):
        at = {t: [r.top for r in full if r.t == t and (r.n // task_rows).bit_length() == bits] for t in stretches}
        hot = [(F.col("t") == t) & node(depth).isin(x) for t, x in at.items() if x]
        any_ = hot[0]
        for h in hot[1:]:
            any_ = any_ | h
        deeper = F.when(any_, F.lit(min(30, depth + bits))).otherwise(deeper)
    dealt = tops.withColumn("depth", deeper).select("t", "depth", F.expr("shiftrightunsigned(head, 32 - depth)").alias("top"), "name", "id", "size", "fp")
    found = dealt.groupBy("t", "depth", "top").applyInPandas(_similar_task(similarity, lambda key: int(key[1])), "u_id long, u_name long, v_id long, v_name long, sure boolean")
    both = found.select(*[F.struct(F.col(f"{c}_id").alias("id"), F.col(f"{c}_name").alias("name")).alias(c) for c in "uv"], "sure")
    return both.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.max("sure").alias("sure"))


def _prefix_column(text: Column, shingle: int, similarity: float, late: np.ndarray, counts: np.ndarray) -> Column:
    """The set's name and size, its first shingles in the order of all (of shingles in
    the sorted ``late`` by their counts, after all others), and the last of them."""

    def prefix(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                one = np.unique(shingle_hashes(t, shingle))
                name = np.uint64(xxhash.xxh64_intdigest(one.tobytes())).astype(np.int64)
                own, rank = one.view(np.int64), np.zeros(len(one), np.int64)
                if len(late):
                    at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                    rank = np.where(late[at] == own, counts[at], 0)
                order = np.lexsort((own, rank))[: len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1]
                first = own[order]
                out.append((name, len(own), first, int(rank[order[-1]]) if len(own) else 0, int(first[-1]) if len(own) else 0))
            yield pd.DataFrame(out, columns=["name", "size", "prefix", "rank", "last"], index=batch.index)

    return F.pandas_udf(prefix, "name long, size int, prefix array<long>, rank long, last long")(text)


def _meetings(similarity: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """u < v, names of different groups that share a shingle and whose sizes allow the
    similarity, and how many of these rows they share. Pairs go out as they are made, so
    that a task holds its rows and ``PREFIX_PAIRS`` pairs, or those of one row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("token", "group", "name", "size", "block", "lo", "hi")
        token, root, name, size, block, lo, hi = (np.concatenate(x) for x in zip(*([p[c].to_numpy() for c in columns] for p in parts)))
        cross = lo[0] != hi[0]
        order = np.lexsort((root, token))
        token, root, name, size, block = (x[order] for x in (token, root, name, size, block))
        names, place = np.unique(name, return_inverse=True)
        ends = lambda new: np.repeat(e := np.append(np.flatnonzero(new) + 1, len(token)), np.diff(e, prepend=0))
        other = np.diff(token) != 0
        stop, start = ends(other), ends(other | (np.diff(root) != 0))  # those after the rows of one's own group
        many = np.cumsum(stop - start)
        at = 0
        while at < len(token):
            to = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + PREFIX_PAIRS, "right")))
            i, j = _pairs(np.arange(at, to), np.arange(at, to) + 1, start[at:to], stop[at:to])
            fits = np.minimum(size[i], size[j]) + 1e-6 >= similarity * np.maximum(size[i], size[j])
            if cross:
                fits &= block[i] != block[j]
            i, j = place[i[fits]], place[j[fits]]
            if len(i):
                pair, shared = np.unique(np.minimum(i, j) * len(names) + np.maximum(i, j), return_counts=True)
                yield pd.DataFrame({"u_name": names[pair // len(names)], "v_name": names[pair % len(names)], "shared": shared})
            at = to

    return run


def left_out(hashed: DataFrame, grouped: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u > v, vertices: all pairs of sets of different groups that may be similar, by
    the shingles that their prefixes share. ``hashed`` has text_hash and text,
    ``grouped`` a row for each set: name, id, and group (the name of its root)."""
    n = grouped.count()
    some = hashed.where(F.pmod(F.xxhash64("text_hash"), F.lit(max(1, n // ORDER_TEXTS))) == 0).dropDuplicates(["text_hash"])
    seen = some.select(F.explode(_set_column(F.col("text"), shingle)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= ORDER_LEAST)
    often = seen.orderBy(F.desc("n"), "token").limit(ORDER_MOST).toPandas().sort_values("token")
    late, counts = often.token.to_numpy(np.int64), often.n.to_numpy(np.int64)
    made = hashed.select(_prefix_column(F.col("text"), shingle, similarity, late, counts).alias("p")).select("p.*")
    one = made.groupBy("name").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "rank", "last")])
    known = cut(one.join(grouped.select("name", "id", "group"), "name"))
    rows = known.select(F.explode("prefix").alias("token"), "name", "group", "size")
    # a shingle of very many sets is dealt as pairs of blocks of them; it is one of the frequent ones
    spark = hashed.sparkSession
    frequent = spark.createDataFrame(pd.DataFrame({"token": late}), "token long")
    crowd = rows.join(F.broadcast(frequent), "token").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > PREFIX_CROWD).select("token", F.ceil(F.col("n") / PREFIX_CROWD).cast("int").alias("blocks")).collect()
    total = known.agg(F.sum(F.size("prefix"))).first()[0] or 0
    plain = F.pmod(F.xxhash64("token"), F.lit(max(1, total // PREFIX_ROWS)))
    zero = F.lit(0)
    if crowd:
        side = F.broadcast(spark.createDataFrame(crowd, "token long, blocks int"))
        own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
        hot = rows.join(side, "token").select("token", "name", "group", "size", own.alias("block"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("with"))
        dealt = rows.join(side, "token", "left_anti").select(plain.alias("part"), zero.alias("lo"), zero.alias("hi"), "token", "name", "group", "size", zero.alias("block"))
        dealt = dealt.unionByName(hot.select(F.xxhash64("token").alias("part"), F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "token", "name", "group", "size", "block"))
    else:
        dealt = rows.select(plain.alias("part"), zero.alias("lo"), zero.alias("hi"), "token", "name", "group", "size", zero.alias("block"))
    met = dealt.groupBy("part", "lo", "hi").applyInPandas(_meetings(similarity), "u_name long, v_name long, shared long")
    pairs = met.groupBy("u_name", "v_name").agg(F.sum("shared").alias("shared"))
    a, b = (known.select(F.col("name").alias(f"{c}_name"), F.struct("id", "name").alias(c), F.struct("rank", "last").alias(f"{c}_last"), F.col("size").alias(f"{c}_size"), F.size("prefix").alias(f"{c}_first")) for c in "uv")
    both = pairs.join(a, "u_name").join(b, "v_name")
    need = F.ceil(similarity / (1 + similarity) * (F.col("u_size") + F.col("v_size")) - 1e-6)
    # all shared shingles up to the earlier of the two prefixes' ends are counted; beyond it are so many of one set
    beyond = F.when(F.col("u_last") <= F.col("v_last"), F.col("u_size") - F.col("u_first")).otherwise(F.col("v_size") - F.col("v_first"))
    fits = (F.least("u_size", "v_size") + 1e-6 >= similarity * F.greatest("u_size", "v_size")) & (F.col("shared") + beyond >= need)
    return both.where(fits).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _true_links(doubt: DataFrame, hashed: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of vertices among ``doubt`` whose sets are similar."""
    # the sets of the texts in doubt, once
    asked = cut(doubt.select(F.explode(F.array("u.name", "v.name")).alias("name")).distinct().join(sets.select("name", "text_hash"), "name"))
    side = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda x: x)
    held = cut(hashed.select("text_hash", "text").join(side(asked), "text_hash").dropDuplicates(["name"]).select("name", _set_column(F.col("text"), shingle).alias("set")))
    a, b = (held.select(F.col("name").alias(f"{c}_name"), F.col("set").alias(f"{c}_set")) for c in "uv")
    pairs = doubt.withColumns({"u_name": F.col("u.name"), "v_name": F.col("v.name")}).join(a, "u_name").join(b, "v_name")
    both = pairs.select("u", "v", (F.size("u_set") + F.size("v_set")).alias("all"), F.size(F.array_intersect("u_set", "v_set")).alias("both"))
    return both.where(F.col("both") >= similarity * (F.col("all") - F.col("both"))).select("u", "v")


def similar_documents(df: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, name (of the text's set of shingles) and root of every
    row: equal roots for texts that links of at least ``similarity`` between sets
    connect. A root is the group's least vertex: id (``NO_ID`` for null) and name."""
    hashed = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    with small_batches(df.sparkSession):  # all steps that hand texts or sets to Python run in here
        thin = cut(hashed.select("doc_id", "text_hash", _sketch_column(F.col("text"), shingle).alias("s")).select("doc_id", "text_hash", "s.*"))
        sets = cut(thin.groupBy("name").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.count("*").alias("n")))
        found = cut(similar_links(sets.select("name", "id", "size", "fp"), similarity))
        true = _true_links(found.where("not sure").select("u", "v"), hashed, sets, shingle, similarity)
        grown = components(found.where("sure").select("u", "v").union(true))
        group = grown.select(F.col("u.name").alias("name"), F.col("root.name").alias("group"))
        grouped = sets.select("name", "id").join(group, "name", "left").select("name", "id", F.coalesce("group", "name").alias("group"))
        more = cut(left_out(hashed, grouped, shingle, similarity))
        if not more.isEmpty():
            grown = components(grown.select("u", F.col("root").alias("v")).union(_true_links(more, hashed, sets, shingle, similarity)))
    roots = grown.select(F.col("u.name").alias("name"), "root")
    named = sets.join(roots, "name", "left").select("name", F.coalesce("root", F.struct("id", "name")).alias("root"), "n")
    return _by_key(thin.drop("size", "fp"), cut(named), "name", thin.count()).select("doc_id", "text_hash", "name", "root")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
