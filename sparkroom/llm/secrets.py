"""Secret scans: fixed patterns, and two character Markov models.

The patterns find assignments, access keys and long hexadecimal runs. The models
judge every other run of identifier characters: one holds the transitions inside
random strings, the other those inside ordinary identifiers. Both are counted from
labelled samples, half of each from the documents (what the patterns found, and
the other words of the same texts) and half from a table of its own: strings drawn
from the usual alphabets of keys, and identifiers put together from common words.
The table's ordinary strings are also rules of repeated marks, formulas, sequences,
paths, dates, serial and version numbers, equations and UUIDs. A run is judged by its
parts between marks, of which those of ``PART_LEAST`` characters or more add up: short
parts joined by marks say nothing. Runs of one class of characters (capitals, small
letters or digits) and runs in the shape of a UUID or a chemical formula are passed over. A run whose log-likelihood ratio reaches ``MIN_LLR``
is a span of kind "markov". A span of the patterns always stays; a markov span that
meets one is left out.

Positions come without Python: ``split`` gives the stretches between matches and
``regexp_extract_all`` the matches, and running sums over their lengths, in blocks,
give code points. All happens within a row; nothing is shuffled.

Defined results: a null or empty text has no spans; rows that repeat are each
scanned for themselves; an empty table gives no rows and, for training, a
uniform model; other columns can be carried along and their names don't matter.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom.llm.common import let

# The patterns and the least lengths that the task states.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:word|passwd|secret|token|key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 6

#: Runs of these characters, so many at least, are judged by the models.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
MIN_RUN = 16
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
#: Marks within runs, and characters between two of them from which a part counts.
MARKS = "+/_=-"
PART_LEAST = 8
#: Matches of a text whose places are summed up at once.
PLACES = 256
#: Nats by which the random model must be ahead.
MIN_LLR = 11.0
#: Training reads about so many documents, chosen by the hash of their number.
SAMPLE_DOCS = 5_000
#: Training words of the ordinary model have so many letters at least.
WORD = r"[A-Za-z0-9+/_=-]{4,}"
SMOOTHING = 0.5
# The labelled table: words of ordinary identifiers, in every usual way of joining.
WORDS = """
account action active address admin agent alert array attribute author available background balance base before begin between binary
block body border branch browser build button cache call category center change channel check child class clean clear client clock
code collection color command comment common compare complete compute condition connection constant container content context control
convert copy counter country current cursor data date debug decode default define delete depth description detail device difference
digest direct directory disable display distance document domain double download draw driver duration dynamic edge edit element enable
encode engine entity entry error event example exception execute expected export expression extension external factor failure feature
field filter final find flag float folder format forward frame free function gateway generate global graph group handle hash header
height helper history host identifier ignore image import input insert instance integer interface internal interval invalid item
iterator join keyboard label language last latest layer layout leading length level library limit line link listener load local lock
machine main manual mapping margin master match maximum measure member memory merge message method middle minimum missing mobile mode
model module monitor mouse move multiple network next node normal note null object offset online operation option order origin output
owner package page panel parameter parent parse partition password pattern payload pending percent permission phone picture pipeline
pixel plain platform player point policy pool position prefix previous price primary print private process product profile progress
project property protocol provider public query queue random range ratio reader ready record reference region register relation release
remote remove render repeat replace report repository require reset resource result return reverse right root rotate route rule runtime
sample scale schedule schema scope score screen script scroll search second section security segment select sender sequence serial
server service setting shape share shell signal simple single size skip slice slot snapshot socket source space split stack standard
start state static status step storage store strategy string structure style subject submit success suffix summary support switch
symbol sync system table target task template temporary terminal test text thread time title toggle tool total track transaction
transfer transform tree trigger type undefined unique unit unknown update upload user utility valid value variable vector version view
virtual visible visitor volume wait watch weight width window wizard word worker workspace wrapper write year zone
""".split()


def labelled_strings() -> tuple[list[str], list[str]]:
    """Ordinary and random strings of the table, drawn anew in the same way each time."""
    draw = random.Random(7)
    plain = []
    for i, first in enumerate(WORDS):
        for join in (lambda w: "_".join(w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "_".join(w).upper()):
            words = [first, *draw.sample(WORDS, draw.randint(1, 3))]
            plain.append(join(words) + (str(draw.randrange(10 ** draw.randint(1, 4))) if i % 4 == 0 else ""))
    plain += [t for kind in range(len(ORDINARY)) if kind not in SHAPED for t in _ordinary(draw, len(plain) // 26, kind)]
    sets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.hexdigits[:16])
    keys = ["".join(draw.choices(sets[i % len(sets)], k=draw.randint(16, 48))) for i in range(len(plain))]
    return plain, keys


#: Kinds of ordinary strings; the ones whose shape alone tells them teach nothing.
ORDINARY = ("rule", "marks", "formula", "bases", "acids", "path", "date", "serial", "equation", "uuid", "number", "letter", "version")
SHAPED = tuple(map(ORDINARY.index, ("formula", "acids", "serial", "uuid")))
# Common chemical symbols, and the shapes of formulas and of UUIDs.
ELEMENTS = "C H O N S P F K I B Na Cl Ca Mg Fe Br Si Al Zn Cu Li Mn Ag Pb".split()
FORMULA = r"(?:(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")\d{0,3})+"
UUID = r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
PLAIN = rf"^(?:[A-Z+/_=-]+|[a-z+/_=-]+|[0-9+/_=-]+|{UUID}|[+/_=-]*{FORMULA}(?:[+/_=-]+{FORMULA})*[+/_=-]*)$"


def _ordinary(draw: random.Random, n: int, kind: int) -> list[str]:
    """Strings of a kind (a place in ORDINARY) that are no identifiers and no secrets either."""
    some = lambda letters, k: "".join(draw.choices(letters, k=k))
    number = lambda k: some(string.digits, draw.randint(1, k))
    kinds = (
        lambda: draw.choice("-=_+/") * draw.randint(16, 40),
        lambda: draw.choice(("-=", "=-", "+-", "-_", "/-")) * draw.randint(8, 20),
        lambda: "".join(draw.choice(ELEMENTS) + (number(2) if draw.random() < 0.7 else "") for _ in range(draw.randint(8, 14))),
        lambda: some("ACGT", draw.randint(16, 60)),
        lambda: some("ACDEFGHIKLMNPQRSTVWY", draw.randint(16, 40)),
        lambda: "/" + "/".join(draw.choice((draw.choice(WORDS), number(4), draw.choice(string.ascii_lowercase) + number(2))) for _ in range(draw.randint(4, 7))),
        lambda: f"{draw.randint(1990, 2040)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}T{draw.randint(0, 23):02}{draw.randint(0, 59):02}{draw.randint(0, 59):02}Z",
        lambda: "-".join(some(string.ascii_uppercase + string.digits, draw.randint(3, 6)) for _ in range(4)),
        lambda: "".join(draw.choice(string.ascii_lowercase) + draw.choice("=+-") for _ in range(draw.randint(8, 16))),
        lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: some(string.digits, draw.randint(16, 30)),
        lambda: draw.choice(string.ascii_letters) * draw.randint(16, 30),
        lambda: "v" + "-".join(number(3) for _ in range(6)),
    )
    return [kinds[kind]() for _ in range(n)]


def _codes(text: Column) -> Column:
    """Places of the characters in ALPHABET, from 0."""
    place = {ord(c): i for i, c in enumerate(ALPHABET)}
    of = F.lit([place.get(i, -1) for i in range(128)])
    return F.transform(F.split(text, ""), lambda c: F.get(of, F.ascii(c)))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio of every pair of characters, row by row.

    Strings that the patterns find are random, other words are ordinary; the table
    of ``labelled_strings`` has half a say in both. Counting is one aggregate of a
    fixed number of groups."""
    n = len(ALPHABET)
    whole = F.coalesce(F.col(text), F.lit(""))
    total = df.count()
    chosen = df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(max(total, 1))) < sample_docs).select(whole.alias("t"))
    # the whole patterns are tried on the few texts that show a part of them
    shows = [F.rlike("t", F.lit(p)) for p in (ASSIGN_HINT, ACCESS, HEX)]
    none = F.array().cast("array<string>")
    found = [
        F.when(shows[0], F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda s: F.length(s) >= ASSIGN_LEAST)).otherwise(none),
        F.when(shows[1], F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0))).otherwise(none),
        F.when(shows[2], F.regexp_extract_all("t", F.lit(HEX), F.lit(0))).otherwise(none),
    ]
    bare = F.when(shows[0] | shows[1] | shows[2], F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")).otherwise(F.col("t"))
    samples = chosen.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), F.concat(*found).alias("s")), F.struct(F.lit(0).alias("random"), F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)).alias("s")))).alias("x")).select("x.random", F.explode("x.s").alias("s"))
    of = lambda c: F.transform(F.sequence(F.lit(2), F.size(c)), lambda i: F.element_at(c, i - 1) * n + F.element_at(c, i))
    # words repeat: each is taken apart once, with its count as weight
    words = samples.where(F.length("s") > 1).groupBy("random", "s").agg(F.count("*").alias("n"))
    pairs = words.select("random", "n", F.explode(let(_codes(F.col("s")), of)).alias("pair"))
    counts = [[0] * (n * n), [0] * (n * n)]
    for r in pairs.where(F.col("pair") >= 0).groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        if r.pair < n * n:
            counts[r.random][r.pair] = r.n

    def chances(c: list[int]) -> list[float]:
        out = []
        for i in range(n):
            row = c[i * n : (i + 1) * n]
            out += [(x + SMOOTHING) / (sum(row) + SMOOTHING * n) for x in row]
        return out

    models = []
    for own, table in zip(counts, labelled_strings()):
        other = [0] * (n * n)
        for text_ in table:
            at = [ALPHABET.index(c) for c in text_]
            for a, b in zip(at, at[1:]):
                other[a * n + b] += 1
        models.append([(x + y) / 2 for x, y in zip(chances(own), chances(other))])
    return [round(math.log(b / a), 6) for a, b in zip(*models)]


def llr(run: Column, weights: list[float]) -> Column:
    """Sum of the ratios of pairs of characters, over the run's parts between marks that
    are long enough."""
    n, w = len(ALPHABET), F.lit(weights)
    first_mark = n - len(MARKS)
    counted = lambda a: a["sum"] + F.when(a["size"] >= PART_LEAST, a["part"]).otherwise(F.lit(0.0))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("size"), F.lit(0.0).alias("part"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        mark = (c >= first_mark) | (c < 0)
        closed = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("size"), F.lit(0.0).alias("part"), counted(a).alias("sum"))
        more = a["part"] + F.when(a["last"] >= 0, F.get(w, a["last"] * n + c)).otherwise(F.lit(0.0))
        return F.when(mark, closed).otherwise(F.struct(c.alias("last"), (a["size"] + 1).alias("size"), more.alias("part"), a["sum"].alias("sum")))

    return F.aggregate(_codes(run), start, step, counted)


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(kind: int, pattern: str, keep) -> Column:
    """Spans of the matches that are kept, by running sums over the gaps and matches.

    Sums run in blocks, whose spans are then moved by what lies before them."""
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), F.lit(kind).alias("kind"), b.cast("int").alias("end")))

    def step(a: Column, z: Column) -> Column:
        begin = a["at"] + F.length(z["g"])
        end = begin + F.coalesce(F.length(z["m"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(z["m"].isNotNull() & keep(z["m"]), F.concat(a["out"], span(begin, end))).otherwise(a["out"]).alias("out"))

    def join(a: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + a["at"]).alias("end")))
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], moved).alias("out"))

    def spans(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / PLACES).cast("int"))
        return F.aggregate(F.transform(blocks, lambda b: F.aggregate(F.slice(z, b * PLACES + 1, F.lit(PLACES)), start, step)), start, join, lambda a: a["out"])

    matches = F.arrays_zip(F.split("__t", pattern, -1).alias("g"), F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(F.col(f"__has{kind}"), let(matches, spans)).otherwise(none)


def find_secrets(df: DataFrame, weights: list[float], text: str = "text", carry: tuple[str, ...] = ("doc_id",), min_llr: float = MIN_LLR) -> DataFrame:
    """The ``carry`` columns of every row as ``row``, and ``spans``: its sorted
    spans, each with start, kind (a place in KINDS) and end."""
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    for kind, pattern in enumerate((ASSIGN_HINT, ACCESS, HEX, RUN)):
        base = base.withColumn(f"__has{kind}", F.rlike("__t", F.lit(pattern)))
    yes = lambda m: F.lit(True)
    kinds = [
        _places(0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        _places(1, ACCESS, yes),
        _places(2, HEX, yes),
        _places(3, RUN, lambda m: ~F.rlike(m, F.lit(PLAIN)) & (llr(m, weights) >= min_llr)),
    ]
    meets = lambda s, base: F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    clear = lambda found: F.filter(found, lambda s: (s["kind"] < 3) | ~meets(s, F.filter(found, lambda b: b["kind"] < 3)))
    return base.select("row", F.when(F.col("__has0") | F.col("__has1") | F.col("__has2") | F.col("__has3"), let(F.sort_array(F.concat(*kinds)), clear)).otherwise(F.array().cast(SPAN)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mask``; spans that meet share one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
