"""Repair of conversations' structure by iterative-deepening A*.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Turns may be
kept (no cost), given another role (2) or deleted (3; blank and repeated turns must
be), and turns without text inserted (2); a truncated turn that stays costs 1 more.

The search goes depth first through edits in the order of their letters (D, I, K, R)
and gives up where cost and estimate exceed a bound, which starts at the estimate of
the whole conversation and grows to the least cost that the failure has shown. A
table of failed states (turn, place in the pattern) holds what each is known to need,
so that nothing is searched twice in vain. The first accepted path is therefore the
cheapest, and of equals the one whose letters come first. The estimate adds up what
each turn needs by itself and 2 for each of as many disjoint neighbours as may not
follow each other, so that it is short of the cost by little.

On Spark, every turn gives two rows: one with what the search needs (role's initial,
faults, a hash of role and text) and one with the text. Sorted by conversation, kind
of row and turn, a conversation's short rows come first, then its texts, one after
the other: repaired texts go into a running hash as they come, and no task holds a
conversation's texts.

Defined results: a null key is a conversation like any other; null turns come first
and do not count for gaps; a null role or text is one space; a role that does not
begin with s, u or a (lower case), the empty one too, fits nowhere and is changed or
deleted; equal turns are ordered by role and a hash of the text; an empty table gives
no rows; a conversation without rows has zeros, an empty audit and the hash of
nothing; other columns are not read. A conversation's audit is one value of the
result; the search holds some hundred bytes for each of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The pattern's places: at the start, after s, after u, after a; and what may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that may be given or inserted at a place, and where it leads.
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTED = (START, ASSISTANT)
KNOWN, FOLLOWS = {"s", "u", "a"}, {"su", "ua", "au"}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def estimates(initials: list[str], must_go: list[bool], cut: list[bool]) -> list[int]:
    """What the turns from each place on cost at least."""
    least = [0] * (len(initials) + 1)
    alone, here, after, right = 0, 0, 0, ""  # wrong neighbours from the next kept turn on, and from the one behind it
    for i in range(len(initials) - 1, -1, -1):
        if must_go[i]:
            alone += DELETE
        else:
            own = initials[i]
            alone += TRUNCATED * cut[i] + (0 if own in KNOWN else RESPONSE)
            wrong = own in KNOWN and right in KNOWN and own + right not in FOLLOWS
            here, after, right = max(here, wrong + after), here, own
        least[i] = alone + 2 * here
    return least


def search(initials: list[str], must_go: list[bool], cut: list[bool]) -> tuple[int, str]:
    """The least cost and its edits, the first in ASCII order of equal ones."""
    n = len(initials)
    least = estimates(initials, must_go, cut)
    failed: dict[tuple[int, int], int] = {}
    needs = lambda at: failed.get(at, least[at[0]])

    def edits(i: int, place: int) -> list[tuple[str, int, tuple[int, int]]]:
        given = GIVEN[place][1]
        if i == n:
            return [("I", INSERT, (i, given))]
        out = [("D", DELETE, (i + 1, place)), ("I", INSERT, (i, given))]
        if not must_go[i]:
            if (place, initials[i]) in NEXT:
                out.append(("K", TRUNCATED * cut[i], (i + 1, NEXT[place, initials[i]])))
            out.append(("R", RESPONSE + TRUNCATED * cut[i], (i + 1, given)))
        return out

    while True:
        bound = needs((0, START))
        path: list[str] = []
        stack = [((0, START), bound, iter(edits(0, START)))]
        if n == 0:
            return 0, ""
        while stack:
            at, left, open_ = stack[-1]
            for letter, cost, to in open_:
                if needs(to) + cost <= left:
                    path.append(letter)
                    if to[0] == n and to[1] in ACCEPTED:
                        return bound - left + cost, "".join(path)
                    stack.append((to, left - cost, iter(edits(*to))))
                    break
            else:
                # all edits are known to need more than is left
                failed[at] = max(needs(at), min(cost + needs(to) for _, cost, to in edits(*at)))
                stack.pop()
                if path:
                    path.pop()


@dataclass
class Conversation:
    """The turns of one conversation in order, then their texts in the same order."""

    key: object
    initials: list[str] = field(default_factory=list)
    must_go: list[bool] = field(default_factory=list)
    cut: list[bool] = field(default_factory=list)
    turns: set[int] = field(default_factory=set)
    seen: set[tuple[int, int]] = field(default_factory=set)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    audit: str | None = None

    def add(self, turn: int | None, initial: str, blank: bool, cut: bool, name: tuple[int, int]) -> None:
        repeated = name in self.seen
        self.seen.add(name)
        fault = "blank" if blank else "duplicate" if repeated else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        if self.initials and self.initials[-1] + initial not in FOLLOWS:
            self.counts["illegal"] += 1
        self.initials.append(initial)
        self.must_go.append(blank or repeated)
        self.cut.append(fault == "truncated")
        if turn is not None:
            self.turns.add(turn)

    def settle(self) -> None:
        """Search, once all turns are known."""
        if self.audit is not None:
            return
        if self.turns:
            self.counts["gaps"] = max(self.turns) - min(self.turns) + 1 - len(self.turns)
        self.counts["cost"], self.audit = search(self.initials, self.must_go, self.cut)
        self.hash, self.lines, self.edit, self.place, self.row = hashlib.sha256(), 0, 0, START, 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.lines += 1

    def inserts(self) -> None:
        while self.edit < len(self.audit) and self.audit[self.edit] == "I":
            role, self.place = GIVEN[self.place]
            self.line(role, "")
            self.edit += 1

    def text(self, role: str, text: str) -> None:
        """The next turn's text, as the audit wants it."""
        self.settle()
        self.inserts()
        letter, initial = self.audit[self.edit], self.initials[self.row]
        self.edit, self.row = self.edit + 1, self.row + 1
        if letter == "K":
            self.place = NEXT[self.place, initial]
            self.line(role, text)
        elif letter == "R":
            role, self.place = GIVEN[self.place]
            self.line(role, text)

    def result(self) -> tuple:
        self.settle()
        self.inserts()
        return (self.key, *(self.counts[c] for c in COUNTS), self.audit, self.hash.hexdigest())


def _repaired(schema: pa.Schema):
    names = ("key", "kind", "turn", "initial", "blank", "cut", "h1", "h2", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        out: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            for key, kind, turn, initial, blank, cut, h1, h2, role, text in zip(*(batch.column(c).to_pylist() for c in names)):
                if now is None or now.key != key:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(key)
                if kind == 1:
                    now.add(turn, initial, blank, cut, (h1, h2))
                elif kind == 2:
                    now.text(role, text)
            if out:
                yield give()
                out.clear()
        if now is not None:
            out.append(now.result())
            yield give()

    return run


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """A row for each conversation: its key, counts of gaps and faults, the least cost,
    its edits and the hash of the repaired turns. Where ``dropped`` is true a row only
    names its conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    own_role, own_text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role, text))
    rows = df.select(
        F.col(key).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        own_role.alias("role"),
        own_text.alias("text"),
        F.substring(own_role, 1, 1).alias("initial"),
        (~F.rlike(own_text, F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"),
        (~F.rlike(own_text, F.lit(r"[.!?][\x20\x09-\x0D]*+\z"))).alias("cut"),
        F.xxhash64(own_role, own_text).alias("h1"),
        F.xxhash64(F.lit(1), own_role, own_text).alias("h2"),
        F.coalesce(F.lit(False) if dropped is None else dropped, F.lit(False)).alias("dropped"),
    )
    order = ["turn", "role", "h1", "h2"]
    kinds = F.explode(F.when(F.col("dropped"), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2))))
    short = F.col("kind") < 2
    two = rows.select("*", kinds.alias("kind")).withColumn("text", F.when(~short, F.col("text")))
    dealt = two.repartition("key").sortWithinPartitions(F.asc_nulls_first("key"), "kind", F.asc_nulls_first("turn"), *order[1:])
    out = StructType([StructField("conv_id", df.schema[key].dataType), *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    return dealt.select("key", "kind", "turn", "initial", "blank", "cut", "h1", "h2", "role", "text").mapInArrow(_repaired(to_arrow_schema(out)), out)


def damage(df: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text, damaged by the checksum of conversation
    and turn: one in twenty each dropped, emptied, robbed of its sentence ends,
    repeated, or set to the user's role. Dropped rows stay, marked ``dropped``."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.pmod(F.crc32(named), F.lit(20)).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(fate == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate == 0).alias("dropped"), times.alias("copy")).drop("copy")
