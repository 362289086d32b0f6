"""Embedding near-dedup, centroid clustering and conversation repair: brute force and edges."""

import hashlib
import math
import random
import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroom.llm import centroids, turns, vectordup

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("name", T.StringType())])


# --- embedding near-dedup


def linked(rows, limit=0.9):
    """Number of links and least key of the component, row by row, in plain Python."""
    ok = lambda v: v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if ok(v) else None for _, v in rows]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(key, least.get(root[i], key))
    return sorted(((k, links[i], least.get(root[i]), k is not None and k == least.get(root[i])) for i, (k, _) in enumerate(rows)), key=str)


def family(rng, centre, n, noise):
    x = centre + noise * rng.standard_normal((n, len(centre))) / math.sqrt(len(centre))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(seed, size=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((150, size))
    parts = [base, family(rng, base[0] / np.linalg.norm(base[0]), 60, 0.1), family(rng, base[1] / np.linalg.norm(base[1]), 50, 0.34), family(rng, base[2] / np.linalg.norm(base[2]), 40, 0.5)]
    x = np.concatenate([*parts, base[3:4] * 7, base[3:4], np.repeat(base[4:5], 6, axis=0)])
    return [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(len(x)), x)]


@pytest.mark.parametrize("sizes, leaders", [({}, False), ({"task_rows": 40}, True), ({"crowd": 50, "chunk": 16}, True), ({"task_rows": 60, "crowd": 20, "chunk": 8}, False)])
def test_near_vectors_brute_force(spark, monkeypatch, sizes, leaders):
    """One bucket, several, crowded ones in chunks, with and without leaders; tables as
    many as to miss nothing here."""
    monkeypatch.setattr(vectordup, "RECALL", 0.999999)
    if leaders:
        monkeypatch.setattr(vectordup, "LEADER_LEAST", 10)
        monkeypatch.setattr(vectordup, "LEADER_BITS", 6)
    rows = planted(5)
    df = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).withColumns({c: F.lit(1) for c in ("code", "ball", "d", "t", "top", "n", "root", "v")})
    got = vectordup.near_vectors(df, **sizes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == linked(rows)


def test_leaders_are_found_and_save_comparisons(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "LEADER_LEAST", 20)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((2, 64))
    x = np.concatenate([family(rng, b / np.linalg.norm(b), 80, 0.1) for b in base])
    df = spark.createDataFrame([(i, [float(v) for v in r], None) for i, r in enumerate(x)], VECTORS)
    rows = df.select(F.col("vec_id").alias("key"), F.struct(F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")).alias("name"), F.col("embedding").alias("v"))
    known, found, _ = vectordup.link_counts(vectordup.distinct_vectors(rows).checkpoint(), 0.9)
    assert sorted(r.m for r in known.groupBy("ball").agg(F.count("*").alias("m")).collect()) == [80, 80]
    assert found.count() == 0  # no pair had to be compared
    got = {r.n_links for r in vectordup.near_vectors(df).collect()}
    assert got == {79}


@pytest.mark.parametrize("depth", [4, 10])
def test_recall_of_tables_at_the_limit(depth):
    """Pairs just at the limit share a table with the promised chance, and far more
    than nine in ten pass the confidence bound."""
    rng = np.random.default_rng(depth)
    a = vectordup.unit(rng.standard_normal((4000, 64)))
    b = vectordup.unit(rng.standard_normal((4000, 64)))
    b = vectordup.unit(b - (a * b).sum(1, keepdims=True) * a)
    c = 0.9 * a + math.sqrt(1 - 0.81) * b
    tables = vectordup.table_count(0.9, depth)
    bits = 64 * -(-tables // (64 // depth))
    one, two = (vectordup.encode(x, max(512, bits)) for x in (a, c))
    meets = np.zeros(len(a), bool)
    for t in range(tables):
        meets |= vectordup.key_array(one[0], t, depth) == vectordup.key_array(two[0], t, depth)
    assert meets.mean() > 0.985
    (ae, ao), (ce, co) = (vectordup.decode(*x, 64) for x in (one, two))
    estimate = ((ae * co).sum(1) + (ao * ce).sum(1)) / 2
    sd = vectordup.spread(np.concatenate((ae, ce)), np.concatenate((ao, co)), 64)
    assert abs(estimate.mean() - 0.9) < 0.01  # unbiased
    assert estimate.std() < sd * 1.2
    assert (estimate >= 0.9 - vectordup.SPREADS * sd).mean() > 0.998


def test_near_vectors_default_recall(spark):
    """Shipped parameters over many buckets: links lie at 0.9 and little above."""
    rng = np.random.default_rng(9)
    a = vectordup.unit(rng.standard_normal((1500, 64)))
    b = vectordup.unit(rng.standard_normal((1500, 64)))
    b = vectordup.unit(b - (a * b).sum(1, keepdims=True) * a)
    c = 0.902 * a + math.sqrt(1 - 0.902**2) * b
    x = np.concatenate((a, c))
    df = spark.createDataFrame([(i, [float(v) for v in r], None) for i, r in enumerate(x)], VECTORS)
    got = vectordup.near_vectors(df, task_rows=50)
    assert got.where("n_links > 0").count() >= 0.98 * 3000


def test_near_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 0.0]), (None, [1.0, 2.1]), (None, [-5.0, 1.0]), (None, None), (9, [1e300, 2e300]), (10, [1e-300, 2e-300]), (11, [3.0]), (12, [0.5]), (13, [-1.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], VECTORS)
    assert sorted((tuple(r) for r in vectordup.near_vectors(df).collect()), key=str) == linked(rows)
    assert vectordup.near_vectors(df.limit(0)).count() == 0


# --- centroid clustering


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * e) for e in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    c = [v for _, v in order[:k]]
    dist = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    for step in range(rounds + 1):
        own = [min((dist(v, m), j) for j, m in enumerate(c)) for _, v in kept]
        if step == rounds:
            return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, own)), key=str), c
        for j in range(len(c)):
            mine = [v for (_, v), (_, q) in zip(kept, own) if q == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]


@pytest.mark.parametrize("k, rounds, length, spread", [(5, 5, 64, 1.0), (12, 4, 8, 3.0), (40, 5, 64, 0.2), (3, 6, 4, 40_000.0)])
def test_clusters_brute_force(spark, k, rounds, length, spread):
    rng = np.random.default_rng(k)
    centre = rng.standard_normal((4, length)) * spread
    x = np.concatenate([centre[i] + rng.standard_normal((40, length)) * 0.3 for i in range(4)] + [np.repeat(centre[:1], 9, axis=0)])
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.25] * length), (3, [0.25] * length)]
    odd = [(900, None), (901, [1.0]), (902, [None] * length), (903, [float("nan")] * length), (904, [float("inf")] * length), (905, [1e30] * length)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], VECTORS).withColumns({c: F.lit(1) for c in ("key", "v", "cluster", "upper", "exact")})
    got, c = centroids.cluster(df.repartition(3), k, rounds, length=length)
    want, centres = plain_clusters(rows, k, rounds)
    assert sorted(((r.key, r.cluster, r.exact) for r in got.collect()), key=str) == want
    assert c.tolist() == centres
    done = centroids.with_inertia(got, c).collect()
    sums = {j: sum(d for _, q, d in want if q == j) for j in range(k)}
    for r in done:
        assert (r.cluster_inertia, r.inertia) == (sums[r.cluster], sum(sums.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)], VECTORS)
    got, c = centroids.cluster(df, 40, 2, length=2)
    assert sorted((r.key, r.cluster, r.exact) for r in got.collect()) == [(1, 0, 0), (2, 0, 0)] and len(c) == 2
    empty, none = centroids.cluster(df.limit(0), 40, 2, length=2)
    assert centroids.with_inertia(empty, none).count() == 0


def test_loosening_is_a_bound_and_below_the_drift():
    """No point of a cluster's sphere comes nearer by more than its bound, and clusters
    beside the moves loosen less than the whole drift."""
    rng = np.random.default_rng(1)
    old = rng.standard_normal((12, 5)) * 100
    new = old + rng.standard_normal((12, 5)) * 10
    radius = rng.uniform(0, 60, 12)
    bound, drift = centroids.gains(old, new, radius), np.linalg.norm(new - old, axis=1)
    for i in range(12):
        way = rng.standard_normal((3000, 5))
        points = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * rng.uniform(0, 1, (3000, 1)) ** 0.2
        for j in range(12):
            gain = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
            assert gain.max() <= bound[i, j] + 1e-9
    others = ~np.eye(12, dtype=bool)
    assert (bound <= drift * (1 + 1e-6)).all() and bound[others].mean() < 0.7 * np.tile(drift, (12, 1))[others].mean()


def test_bounds_spare_comparisons():
    rng = np.random.default_rng(2)
    c = rng.integers(-1000, 1000, (10, 16))
    x = np.concatenate([m + rng.integers(-60, 60, (200, 16)) for m in c])
    own, d, lower = centroids.assign(x, c)
    upper = np.sqrt(d.astype(float))
    new = np.stack([x[own == j].sum(0) // max(1, (own == j).sum()) for j in range(10)])
    radius = np.array([upper[own == j].max() for j in range(10)])
    loose, drift = centroids.loosening(c, new, radius), np.linalg.norm(new - c, axis=1)
    got, _, _, exact, scanned = centroids.tighten(x, new, own, upper + drift[own], lower - loose[own], last=True)
    assert scanned < len(x) / 10
    best, least, _ = centroids.assign(x, new)
    assert (got == best).all() and (exact == least).all()


# --- conversation repair


def plain_repair(rows):
    """Least cost, edits and lines of (role, text) rows by the whole table of prefixes."""
    seen, state = set(), {"0": (0, "", ())}
    follow = {"0": "su", "s": "u", "u": "a", "a": "u"}
    given = {"0": "user", "s": "user", "u": "assistant", "a": "user"}
    white = " \t\n\x0b\x0c\r"
    faults = []

    def inserts(state):
        out = dict(state)
        for _ in range(3):
            for g, (cost, edits, lines) in list(out.items()):
                role = given[g]
                new = (cost + 2, edits + "I", (*lines, role + ":"))
                if role[0] not in out or new < out[role[0]]:
                    out[role[0]] = new
        return out

    for role, text in rows:
        bare = text.strip(white)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        new = {}
        for g, (cost, edits, lines) in inserts(state).items():
            ways = [(g, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in follow[g]:
                    ways.append((role[:1], more, "K", (f"{role}:{text}",)))
                ways.append((given[g][0], 2 + more, "R", (f"{given[g]}:{text}",)))
            for to, c, letter, line in ways:
                best = (cost + c, edits + letter, lines + line)
                if to not in new or best < new[to]:
                    new[to] = best
        state = new
    cost, edits, lines = min(v for g, v in inserts(state).items() if g in "0a")
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
    return faults, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_search_brute_force():
    draw = random.Random(4)
    for _ in range(600):
        n = draw.randint(0, 9)
        rows = [(draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User"]), draw.choice(["a.", "b.", "c!", "d", "e", " ", "", "f?\n"])) for _ in range(n)]
        faults, _, cost, edits, _ = plain_repair(rows)
        got = turns.search([r[:1] for r, _ in rows], [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        assert got == (cost, edits), rows


def test_search_of_long_conversations():
    """Thousands of turns, a third of them faulty, and estimates that never exceed the cost."""
    draw = random.Random(6)
    rows = [(draw.choice(["user", "assistant"]) if draw.random() < 0.3 else ("user", "assistant")[i % 2], f"text {i}" + draw.choice([".", ".", ""])) for i in range(3000)]
    faults, _, cost, edits, _ = plain_repair(rows)
    initials, must_go, cut = [r[:1] for r, _ in rows], [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults]
    assert turns.search(initials, must_go, cut) == (cost, edits)
    assert 0.9 * cost < turns.estimates(initials, must_go, cut)[0] <= cost


def rows_after_damage(rows):
    out = {}
    word = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        fate = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        own += [] if fate == 0 else [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)) for c, own in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 12)):
            role = draw.choice(["system", None, "tool"]) if draw.random() < 0.1 else ("user", "assistant")[turn % 2]
            text = draw.choice([None, "", " \n", "Ünd so ", "kurz. \x0b\n", "Why?", f"Turn {turn}.", "lang " * 50 + "!"])
            rows.append((conv, turn * 2 if turn != 3 else None, role, text))
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("key", "kind", "cut", "h1", "fate", "copy")})
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair(turns.damage(df).repartition(5), dropped=F.col("dropped")).collect()}
    want = {}
    for conv, own in rows_after_damage(rows).items():
        faults, illegal, cost, edits, sha = plain_repair([r[1:] for r in own])
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        want[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, sha)
    assert got == want


def test_repair_edges(spark):
    schema = "conv_id string, turn long, role string, text string"
    nothing = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([("x", None, None, None), ("y", 1, "user", "Hi."), ("y", 1, "user", "Hi."), ("z", 1, "user", "a" * 100_000), ("w", 1, "user", "gone.")], schema)
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair(df, dropped=F.col("conv_id") == "w").collect()}
    answer = hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()
    assert got["x"] == (0, 1, 0, 0, 0, 3, "D", nothing)
    assert got["y"] == (0, 0, 1, 0, 1, 5, "KDI", answer)
    assert got["z"][:7] == (0, 0, 0, 1, 0, 3, "D") and got["z"][7] == nothing
    assert got["w"] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert turns.repair(df.limit(0)).count() == 0
