"""Main text of web pages by nearest-URL page differencing.

A page becomes lines: the text of its blocks, white space folded and character
references decoded, each with the region it stands in. Pages are sorted by host,
path and content; each is paired with a neighbour on its host, the lines of both
are aligned by the longest common subsequence, and shared lines are deleted. Pages
whose lines outside of menus and the like are equal are copies and tell nothing,
so the neighbours of a run of copies are the last page before it and the first
after it that differ; the one whose path shares the longest start with the page's
own is taken.

Differencing alone neither finds an advert that one page alone shows nor keeps a
passage that two articles share. So the markup corrects it where it speaks: lines
inside an article element (or, on pages without one, a main element) are
restored; lines inside menus, headers, footers, forms, asides and the like, and
lines outside of the article on pages that have one, are dropped if no neighbour
shares them. On pages with neither element the alignment has the last word on
every line outside of menus and the like. ``extract`` counts what decided.

Pages are dealt into ranges of the sorted order by a sample of it, so a host with
a third of all pages is many ranges. Each range is handed the pages across its
borders that its first and last run need, as a row of its own that comes before its
pages: at most four pages of each range, as hashes of their lines, reach the driver. A
task holds a run of copies at a time, a range at most.

Defined results: null html is empty and gives an empty text; a null URL, or one
without "://", has an empty host and path; rows that repeat are each extracted;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroom.llm.urlfilter import host_of, path_of

ARTICLE, MAIN, OPEN, CHROME = range(4)

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|textarea|title|svg|iframe|object|select|button"
MAIN_TAGS = {"article": ARTICLE, "main": MAIN}
CHROME_TAGS = frozenset("head nav header footer aside form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
# Words of class, id and role that mark what is not the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "discussion disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup "
    "promo promotion reactions related replies reply respond responses share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget alert complementary contentinfo search".split()
)
NOT_ABOUT_ITSELF = frozenset("has no with without".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag without angle brackets in quotes, and what changes how it goes on.
_REST = re.compile(r"(?:\"[^\"<>]*\"|'[^'<>]*'|[^'\"<>])*+>")
_EVENT = re.compile(r"[\"'>]")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
_MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _chrome(tag: str, attrs: str) -> bool:
    if tag in CHROME_TAGS:
        return True
    if not attrs or tag in ("html", "body") or tag in MAIN_TAGS and "comment" not in attrs:
        return False
    if _HIDDEN.search(attrs):
        return True
    for m in _MARKS.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = re.split(r"[^a-z0-9]+", _HUMP.sub(r"\1-\2", name).lower())
            if words[0] not in NOT_ABOUT_ITSELF and CHROME_WORDS & {words[0], words[-1], "".join(words)}:
                return True
    return False


def _tag_end(page: str, at: int, known: dict[int, int], last: int) -> int:
    """Where the tag ends that goes on at ``at``, or -1: behind the first ">" outside of
    quotes. ``known`` holds the answer for each quote or bracket that was met before, so
    that a page of unbalanced quotes takes no longer than another; ``last`` is the place
    of its last ">"."""
    met = []
    end = -1
    while at <= last:
        m = _EVENT.search(page, at)
        if not m:
            break
        i = m.start()
        if i in known:
            end = known[i]
            break
        met.append(i)
        if m[0] == ">":
            end = i + 1
            break
        closing = page.find(m[0], i + 1)
        if closing < 0:
            break
        at = closing + 1
    for i in met:
        known[i] = end
    return end


def _tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of the tags of a page; raw
    elements, comments and the like have no name."""
    at, last = 0, page.rfind(">")
    known: dict[int, int] = {}
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = len(page) if j < 0 else j + 3
            yield i, at, False, "", ""
            continue
        at = i + 1
        if m := _NAME.match(page, i):
            rest = _REST.match(page, m.end()) if i < last else None
            end = rest.end() if rest else _tag_end(page, m.end(), known, last)
            if end < 0:
                continue
            tag, at = m[2].lower(), end
            if tag in _RAW_END and not m[1]:
                closed = _RAW_END[tag].search(page, end)
                at = closed.end() if closed else len(page)
                yield i, at, False, "", ""
            else:
                yield i, end, bool(m[1]), tag, page[m.end() : end - 1]
        elif page[at : at + 1] in ("!", "?", "/") and i < last:
            at = page.find(">", i) + 1
            yield i, at, False, "", ""


def lines(page: str | None) -> list[tuple[int, str]]:
    """Region and text of the blocks of a page, in order. Of several article elements
    that do not stand in each other, the one with the most text is the article (the first
    of equal ones); the others, as cards of further ones, are no part of it."""
    out: list[tuple[int, str]] = []
    article_of: list[int] = []
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    region, article = OPEN, 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((region, text))
                article_of.append(article)

    def close(depth: int) -> None:
        nonlocal region
        flush()
        del stack[depth:]
        region = stack[-1][1] if stack else OPEN

    at, page = 0, page or ""
    for start, end, closing, tag, attrs in _tokens(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if depth >= 0:
                close(depth)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        chrome = _chrome(tag, attrs)
        if tag in INLINE and not chrome:
            continue
        flush()
        if tag in VOID:
            continue
        over = SIBLINGS.get(tag, CLOSED_BY_BLOCK if tag not in INLINE else frozenset())
        while stack and stack[-1][0] in over | CLOSED_BY_BLOCK:
            close(len(stack) - 1)
        if chrome or region == CHROME:
            region = CHROME
        else:
            article += tag == "article" and region != ARTICLE
            region = min(region, MAIN_TAGS.get(tag, OPEN))
        stack.append((tag, region))
    held.append(page[at:])
    flush()
    sizes: dict[int, int] = {}
    for (r, text), n in zip(out, article_of):
        if r == ARTICLE:
            sizes[n] = sizes.get(n, 0) + len(text)
    if len(sizes) > 1:
        largest = max(sizes, key=lambda n: (sizes[n], -n))
        out = [(CHROME if r == ARTICLE and n != largest else r, text) for (r, text), n in zip(out, article_of)]
    return out


def shared(own: list, other: list) -> set[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    Equal starts and ends are part of one, and lines that the other side lacks of
    none. For the rest, rows of the table of lengths are bits of whole numbers: a
    zero is a place where the length grows."""
    least = min(len(own), len(other))
    head = next((i for i in range(least) if own[i] != other[i]), least)
    tail = next((i for i in range(least - head) if own[-1 - i] != other[-1 - i]), least - head)
    found = {*range(head), *range(len(own) - tail, len(own))}
    mine, theirs = set(own[head : len(own) - tail]), set(other[head : len(other) - tail])
    at = [i for i in range(head, len(own) - tail) if own[i] in theirs]
    rest = [x for x in other[head : len(other) - tail] if x in mine]
    full = (1 << len(at)) - 1
    places: dict = {}
    for j, i in enumerate(at):
        places[own[i]] = places.get(own[i], 0) | 1 << j
    rows = [full]
    for line in rest:
        v = rows[-1]
        u = v & places[line]
        rows.append((v + u | v - u) & full)
    i, j = len(rest), len(at)
    while i and j:
        if own[at[j - 1]] == rest[i - 1]:
            i, j = i - 1, j - 1
            found.add(at[j])
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return found


def main_text(own: list[tuple[int, str]], gone: set[int]) -> tuple[str, int, int, int]:
    """The kept lines, and how many were deleted as shared, restored though shared,
    and dropped though not shared. ``gone`` are the places of shared lines."""
    best = min((r for r, _ in own), default=OPEN)
    kept, n_shared, n_restored, n_dropped = [], 0, 0, 0
    for i, (region, text) in enumerate(own):
        article = region == best and region < OPEN
        if article or region == best == OPEN and i not in gone:
            kept.append(text)
            n_restored += i in gone
        elif i in gone:
            n_shared += 1
        else:
            n_dropped += 1
    return "\n".join(kept), n_shared, n_restored, n_dropped


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _line_hashes(own: list[tuple[int, str]]) -> tuple[list[int], int]:
    """A hash of each line, and one of those outside of menus and the like."""
    every = [_hash(t) for _, t in own]
    return every, _hash(" ".join(str(h) for h, (r, _) in zip(every, own) if r != CHROME))


#: Host, path, hash of the lines outside of menus, and hashes of all lines of a page.
_Page = tuple[str, str, int, list[int]]
DECIDED = "n_shared int, n_restored int, n_dropped int"
#: Pages of the sample for each range, bytes of a range on average, and ranges at
#: most: beyond that (160 GB) ranges grow and the driver's share does not.
SAMPLED, RANGE_BYTES, RANGES_MOST = 20, 1 << 23, 20_000


def _different(page: _Page, near: list[_Page | None]) -> _Page | None:
    """The first of ``near`` that is on the page's host and no copy."""
    return next((x for x in near if x and x[0] == page[0] and x[2] != page[2]), None)


def _placed(bounds: list[tuple]):
    """Rows with the number of their range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["part"] = [bisect_right(bounds, at) for at in zip(pdf["host"], pdf["path"], pdf["h"], pdf["s"])]
            yield pdf

    return run


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each range its first page, the first of the next run, its last page, the
    last of the run before, and whether it has several runs."""
    part = first = second = last = prior = None
    several = False

    def end() -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "ends": [json.dumps([first, _different(first, [second]), last, _different(last, [prior]), several])]})

    for pdf in batches:
        for p, host, path, body, every in zip(pdf["part"], pdf["host"], pdf["path"], pdf["body"].tolist(), pdf["every"]):
            page = (host, path, body, every.tolist())
            if p != part:
                if part is not None:
                    yield end()
                part, first, second, prior, several = p, page, None, None, False
            elif (host, body) != (last[0], last[2]):
                if not several:
                    second = page
                several, prior = True, last
            last = page
    if part is not None:
        yield end()


def _borders(ends: dict[int, list]) -> dict[int, tuple[list, list]]:
    """For each range, the nearest page before it and the nearest that differs from
    that one, and the same after it."""
    before, after = {}, {}
    for out, order, near, next_ in ((before, sorted(ends), 2, 3), (after, sorted(ends, reverse=True), 0, 1)):
        at: list = []
        for part in order:
            out[part] = at
            page = ends[part][near]
            at = [page, ends[part][next_] if ends[part][4] else _different(page, at)]
    return {part: (before[part], after[part]) for part in ends}


def _differenced():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: _Page | None = None
        before: _Page | None = None
        held: list[tuple] = []  # pages of the run: key, url, path, lines, their hashes
        part, borders = None, ([], [])

        def end(after: _Page | None) -> list[tuple]:
            out = []
            near = [x for x in (before, after) if x]
            for key, url, path, own, every in held:
                other = max(near, key=lambda p: len(commonprefix([p[1], path])), default=None)
                out.append((key, url, *main_text(own, shared(every, other[3]) if other else set())))
            held.clear()
            return out

        def done(some: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(some, columns=["key", "url", "text", "n_shared", "n_restored", "n_dropped"]).astype({"key": object})

        for pdf in batches:
            out = []
            for p, key, url, host, path, page, border in zip(pdf["part"], pdf["key"].astype(object).where(pdf["key"].notna(), None), pdf["url"], pdf["host"], pdf["path"], pdf["html"], pdf["border"]):
                if border is not None:  # comes before its range's pages
                    if last is not None:
                        out += end(_different(last, borders[1]))
                    last, part, borders = None, None, json.loads(border)
                    continue
                own = lines(page)
                every, body = _line_hashes(own)
                now = (host, path, body, every)
                if p != part:
                    part, before = p, _different(now, borders[0])
                elif (host, body) != (last[0], last[2]):
                    out += end(_different(last, [now]))
                    before = _different(now, [last])
                last = now
                held.append((key, url, path, own, every))
            if out:
                yield done(out)
        if last is not None:
            yield done(end(_different(last, borders[1])))

    return run


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", ranges: int | None = None) -> DataFrame:
    """``key``, url and text of every page, and the numbers of its lines that were
    deleted as shared, restored though shared, and dropped though not shared."""
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    # content and key part equal URLs, so that no range can grow by one URL's pages
    rows = rows.withColumns({"h": F.xxhash64("html"), "s": F.xxhash64(F.col("key").cast("string"))})
    order = ["host", "path", "h", "s"]
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        ranges = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // RANGE_BYTES), RANGES_MOST))
    n = max(1, rows.count())
    sample = sorted(map(tuple, rows.where(F.pmod(F.xxhash64(*order), F.lit(n)) < SAMPLED * ranges).select(*order).collect()))
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    named = f"key {kind}, url string, host string, path string, html string, h long, s long, part int"

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _placed(bounds)(batches):
            found = [_line_hashes(lines(page)) for page in pdf.pop("html")]
            pdf["every"] = [np.array(e, np.int64) for e, _ in found]
            pdf["body"] = np.array([b for _, b in found], np.int64)
            yield pdf

    thin = rows.select(*order, "html").mapInPandas(hashed, "host string, path string, h long, s long, part int, every array<long>, body long")
    sorted_ = lambda df: df.repartition(ranges, "part").sortWithinPartitions("part", *order)
    ends = {r.part: json.loads(r.ends) for r in sorted_(thin).select("part", "host", "path", "body", "every").mapInPandas(_ends, "part int, ends string").collect()}
    # each range gets the pages across its own borders as a row before its pages
    across = pages.sparkSession.createDataFrame([(p, json.dumps(b)) for p, b in _borders(ends).items()], "part int, border string")
    own = rows.mapInPandas(_placed(bounds), named).withColumn("border", F.lit(None).cast("string"))
    empty = across.select(*[F.col(c) if c in ("part", "border") else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns])
    placed = own.unionByName(empty).repartition(ranges, "part").sortWithinPartitions("part", F.asc_nulls_last("border"), *order)
    found = placed.select("part", "key", "url", "host", "path", "html", "border").mapInPandas(_differenced(), f"key {kind}, url string, text string, {DECIDED}")
    return found.withColumnRenamed("key", key)
