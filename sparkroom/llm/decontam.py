"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item, or a whole shorter
item. For windows of L words, ``k`` is half of L, rounded up; in every L - k + 1
consecutive k-grams the least hash (the rightmost, of equal ones) is kept. Any
shared span of L words therefore keeps the same k-gram on both sides. Documents
join the benchmark on kept hashes; each hit carries the words around it and is
extended to every window that holds the k-gram, which is then compared as a
string. So hashes select candidates and never decide.

Most kept hashes of a document meet none of the benchmark's. While the benchmark is
small enough to be broadcast, one bit for each of ``SIEVE_BITS`` remainders of its
hashes, a literal of fixed size, tells that before a row is made.

The benchmark's side of both joins is broadcast only if it has at most
``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes; beyond that Spark shuffles
the fingerprint rows. The row that stands for a document itself has join keys of
its own, which meet nothing, so that these rows spread over all tasks.

Defined results: a null text or item has no words; an item without words has no
window; a null item number leaves its windows in force but can't be listed;
items that repeat count once; rows that repeat are each judged for themselves;
an empty benchmark contaminates nothing; other columns can be carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom.llm.common import ascii_lower, let

WINDOW = 10
# Fixed value: the word pattern that the task states.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
SIEVE_BITS = 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _sieve(kept: DataFrame) -> Column:
    """Bits of the hashes' remainders, 64 in a number."""
    at = F.shiftright("hash", 32).bitwiseAND(F.lit(SIEVE_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words_ = [0] * (SIEVE_BITS // 64)
    for r in kept.groupBy(F.shiftright(at, 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).collect():
        words_[r["at"]] = r.bits
    return F.split(F.lit(",".join(map(str, words_))), ",").cast("array<bigint>")


def _passes(v: Column, sieve: Column) -> Column:
    word = F.get(sieve, F.shiftright(v, 38).bitwiseAND(F.lit(SIEVE_BITS // 64 - 1)).cast("int"))
    return F.call_function("shiftright", word, F.shiftright(v, 32).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _kept(ws: Column, hashes: Column, length: int, sieve: Column | None) -> Column:
    """Length, k-gram place (from 1), hash and surrounding words of what
    winnowing keeps for windows of ``length`` words, if ``sieve`` lets it pass."""
    k = (length + 1) // 2
    n = F.size(ws)

    def grams(h: Column) -> Column:
        # hash above, place below and counted down: the minimum is the rightmost of equal hashes
        low = lambda g, i: F.shiftleft(g.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.lit(0xFFFFFFFF) - i.cast("long"))
        return F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: low(F.xxhash64(F.slice(h, i, k)), i - 1))

    def least(packed: Column) -> Column:
        every = F.array_distinct(F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.array_min(F.slice(packed, i, length - k + 1))))
        return every if sieve is None else F.filter(every, lambda v: _passes(v, sieve))

    def one(v: Column) -> Column:
        place = (F.lit(0xFFFFFFFF) - v.bitwiseAND(F.lit(0xFFFFFFFF)) + 1).cast("int")
        first = F.greatest(F.lit(1), place + (k - length))
        around = F.slice(ws, first, F.least(n + 1, place + length) - first)
        return F.struct(F.lit(length).alias("len"), first.alias("first"), v.bitwiseAND(F.lit(0x7FFFFFFF00000000)).alias("hash"), around.alias("around"))

    none = F.array().cast("array<struct<len:int,first:int,hash:bigint,around:array<string>>>")
    return F.when(n >= length, F.transform(let(grams(hashes), least), one)).otherwise(none)


def _fingerprints(df: DataFrame, lengths: list[int], *keep: str, sieve: Column | None = None) -> DataFrame:
    """A row for every kept k-gram, and one of length 0 for each row itself."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    mark = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).alias("first"), F.col("__id").alias("hash"), F.lit(None).cast("array<string>").alias("around")))
    every = let(F.col("__w"), lambda w: let(hashes(w), lambda h: F.concat(mark, *[_kept(w, h, n, sieve) for n in lengths])))
    return df.select(*keep, F.explode(every).alias("f")).select(*keep, "f.*")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """len, win (its words, space-joined) and the items that hold it."""
    ws = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    wins = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return ws.select("item", n.alias("wlen"), F.explode(wins).alias("win")).groupBy("wlen", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", item: str = "item_id", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``carry`` columns of every document as ``row``, n_words, n_hit and
    ``items``, the sorted numbers of items with a window in the text."""
    wins = windows(benchmark, item, text, window)
    # one aggregate of at most `window` groups
    held = F.octet_length("win") + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) + 16)
    sizes = wins.groupBy("wlen").agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).collect()
    small = sum(r.n for r in sizes) <= broadcast_rows and sum(r.bytes or 0 for r in sizes) <= BROADCAST_BYTES
    side = F.broadcast if small else (lambda x: x)
    lengths = sorted(r.wlen for r in sizes)
    base = docs.select(F.monotonically_increasing_id().alias("__id"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), words(F.col(text)).alias("__w")).withColumn("n_words", F.size("__w").cast("long"))
    kept = _fingerprints(wins.select(F.lit(0).cast("long").alias("__id"), F.split("win", " ").alias("__w")), lengths).where("len > 0").select("len", "hash").distinct().withColumn("hit", F.lit(True))
    marks = _fingerprints(base, lengths, "__id", "row", "n_words", sieve=_sieve(kept) if small else None).withColumn("row", F.when(F.col("len") == 0, F.col("row")))
    near = marks.join(side(kept), ["len", "hash"], "left").where("len = 0 or hit")
    starts = F.when(F.col("len") > 0, F.sequence(F.lit(1), F.size("around") - F.col("len") + 1)).otherwise(F.array(F.lit(0)))
    tried = near.select("__id", "row", "n_words", "len", "first", "around", F.explode(starts).alias("s")).select(
        "__id", "row", "n_words", "len", (F.col("first") + F.col("s") - 1).alias("at"), F.when(F.col("len") > 0, F.array_join(F.slice("around", F.greatest("s", F.lit(1)), F.col("len")), " ")).otherwise(F.concat(F.lit("\0"), F.col("__id").cast("string"))).alias("win")
    )
    found = tried.join(side(wins), "win", "left").where("len = 0 or (items is not null and wlen = len)")
    spans = F.collect_set(F.when(F.col("len") > 0, F.struct("at", "len")))
    by_doc = found.groupBy("__id").agg(F.first("row", ignorenulls=True).alias("row"), F.max("n_words").alias("n_words"), spans.alias("spans"), F.collect_set("items").alias("sets"))
    # spans in order: each adds the words beyond the last word counted
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(
        F.greatest(a["to"], s["at"] + s["len"] - 1).alias("to"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - 1 - F.greatest(a["to"], s["at"] - 1))).alias("n")
    )
    return by_doc.select("row", "n_words", F.aggregate(F.sort_array("spans"), start, step, lambda a: a["n"]).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
