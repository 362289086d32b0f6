"""Sharding, URL filter, HTML, bit planes, top-k, and the pipeline: brute force and edges."""

import html
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkroom.llm import bitplane, htmldiff, queries, sharding, topk, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- sharding


@pytest.mark.parametrize("rows, repeated", [(1000, 0), (900, 500), (3, 0), (0, 0)])
def test_shards_are_even_and_gapless(spark, monkeypatch, rows, repeated):
    monkeypatch.setattr(sharding, "HOT_LEAST", 50)  # so that the repeated key is split
    data = [(i, f"text é {i % 7}") for i in range(rows)] + [(None, None)] * min(1, rows) + [(5, "same")] * repeated
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard(df, 8).collect()
    assert len(got) == len(data)
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in data)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_shards_are_a_plain_walk_of_the_ring(spark, sf):
    """Shard, slot and home of every row by walking the ring row by row."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()]
    signed = lambda h: h - 2**64 if h >> 63 else h
    hashed = sorted((h % sharding.CELLS, h, d, t) for d, t in rows for h in [signed(xxhash.xxh64_intdigest(str(d).encode(), 42))])
    ring = sharding.ring(8)
    room = [len(rows) // 8 + (s < len(rows) % 8) for s in range(8)]
    place, late = {}, []
    for cell, _, d, _ in hashed:
        at = next((i for i, (c, _) in enumerate(ring) if c >= cell), 0)
        if room[ring[at][1]]:
            room[ring[at][1]] -= 1
            place[d] = (ring[at][1], ring[at][1])
        else:
            late.append((d, at))
    for d, at in late:
        home = ring[at][1]
        while not room[ring[at][1]]:
            at = (at + 1) % len(ring)
        room[ring[at][1]] -= 1
        place[d] = (ring[at][1], home)
    slots, want = Counter(), {}
    for _, _, d, t in hashed:
        shard, home = place[d]
        want[d] = (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", shard, slots[shard], None, home)
        slots[shard] += 1
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard, r.home_shard) for r in queries.op3_sharding(spark, sf.replace("sf0.001", "sf0.01")).collect()}
    assert got == want


def test_growth_moves_few(spark):
    rng = random.Random(1)
    counts = dict(Counter(rng.randrange(sharding.CELLS) for _ in range(50_000)))

    def homes(n, slack):
        out = {}
        for cell, lo, hi, shard, _, _ in sharding.segments(counts, n, slack):
            out |= {(cell, r): shard for r in range(lo, hi)}
        return out

    for slack, most in ((0.25, 0.2), (0.0, 0.35)):
        a, b = homes(8, slack), homes(9, slack)
        assert sum(a[k] != b[k] for k in a) / len(a) < most
        assert max(Counter(b.values()).values()) <= (1 + slack) * 50_000 / 9 + 1


# --- URL filter


def test_urls(spark):
    cases = {
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/19#f": ("example.org", "/en/19", "example.org/en/1", "block"),
        "x://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "http://com/fr/x": ("com", "/fr/x", "com/fr/", "allow"),
        "http://example.org": ("example.org", "", None, None),
        "http://a.net/x://y": ("a.net", "/x://y", None, None),
        "http://É.ORG:80/es/": ("É.org:80", "/es/", None, None),
        "nothing": ("", "", None, None),
        "://": ("", "", None, None),
        "http://q.org?a=/b": ("q.org", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3]
        assert r.verdict == want[3] if want[3] else r.verdict in ("allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_url_model_learns(spark):
    rng = random.Random(2)
    rows = [(f"http://{'shop' if k else 'news'}{rng.randrange(999)}.net/{'buy' if k else 'read'}/{rng.randrange(9999)}", "block" if k else "allow") for k in (0, 1) for _ in range(300)]
    rng.shuffle(rows)
    w = urlfilter.fit(spark.createDataFrame(rows[:400], "url string, label string"))
    test = spark.createDataFrame(rows[400:], "url string, label string")
    s = test.select("label", urlfilter.block_score(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")), w).alias("s")).collect()
    assert sum((r.s > 0) == (r.label == "block") for r in s) / len(s) > 0.97
    # the score is the model's: features of length 1 times weights
    one = test.select(urlfilter.features(F.lit("aaaa"), F.lit("/x")).alias("f"), urlfilter.block_score(F.lit("aaaa"), F.lit("/x"), w).alias("s")).first()
    n = Counter(one.f)
    assert one.s == pytest.approx(sum(c * w[i] for i, c in n.items()) / sum(c * c for c in n.values()) ** 0.5 + w[-1])
    constant = urlfilter.fit(test.where("label = 'block'"))
    assert constant[-1] > 0 and not any(constant[:-1])


def test_url_verdicts_are_a_plain_regression(spark, sf):
    """The query's verdicts by a regression written out in numpy; how well it tells the
    hosts of the table and those of families that are left out of the labelled table."""
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/pages.parquet").select("page_id", "url").collect()}

    def parts(url):
        m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
        return (m[1].translate(LOWER), m[2]) if m else ("", "")

    def vector(url):
        out = np.zeros(urlfilter.BUCKETS)
        for side, text in zip(("h.", "p."), parts(url)):
            for n in (3, 4):
                t = f"{side}^{text}$"
                for i in range(2, max(len(t) - n + 1, 3)):
                    h = xxhash.xxh64_intdigest(f"{side}{n}{t[i : i + n]}".encode(), 42)
                    out[(h - 2**64 if h >> 63 else h) % urlfilter.BUCKETS] += 1
        return out / np.linalg.norm(out)

    def fitted(table):
        x = np.array([[*vector(u), 1.0] for u, _ in table])
        y = np.array([label == "block" for _, label in table], float)
        w = np.zeros(x.shape[1])
        for _ in range(urlfilter.STEPS):
            w -= urlfilter.RATE * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + urlfilter.DECAY * w)
        return w

    table = urlfilter.labelled_urls()
    assert len(table) <= urlfilter.SAMPLE_URLS
    w = fitted(table)
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[0] + r[1]))
    spam = re.compile("adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm")
    right = Counter()
    for r in queries.op4_url_filter(spark, sf.replace("sf0.001", "sf0.1")).collect():
        host, path = parts(urls[r.page_id])
        rule = next((q for q in rules if (host == q[0] or host.endswith("." + q[0])) and path.startswith(q[1])), None)
        score = vector(urls[r.page_id]) @ w[:-1] + w[-1]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        assert r.verdict == (rule[2] if rule else "block" if score > urlfilter.MARGIN else "allow") or abs(score - urlfilter.MARGIN) < 1e-5
        if not rule:
            right[bool(spam.search(host)), r.verdict] += 1
    print(right)
    assert right[True, "block"] / (right[True, "block"] + right[True, "allow"]) > 0.6
    assert right[False, "block"] / (right[False, "block"] + right[False, "allow"]) < 0.1
    held = Counter()
    for family in ("slimming", "school"):
        rest = urlfilter.labelled_urls(family)
        own = fitted(rest)
        for url, label in set(table) - set(rest):
            held[label, vector(url) @ own[:-1] + own[-1] > urlfilter.MARGIN] += 1
    print(held)
    assert held["block", True] / (held["block", True] + held["block", False]) > 0.4
    assert held["allow", True] / (held["allow", True] + held["allow", False]) < 0.06
    # hosts that were written for this test, of fields that no list has
    unseen = "windmill-club tailor-shop amateur-radio antique-clocks brass-band candle-makers dog-training fishing-guide folk-tales harp-lessons maple-syrup pottery-studio quilt-patterns rare-stamps vintage-radio yoga-centre"
    blocked = [h for h in unseen.split() if vector(f"https://{h}.net/en/12.html") @ w[:-1] + w[-1] > urlfilter.MARGIN]
    assert len(blocked) <= 2, blocked


# --- HTML


def test_unbalanced_markup_takes_linear_time():
    """A megabyte of quotes, brackets and raw elements that never end."""
    import time

    for bad in ("<a b='\"", "<a b='", "<script ", "<!", '<a "', "<a b='x' c=\"", "<div>\"'", '<a b=">">'):
        start = time.time()
        htmldiff.lines(bad * (1_000_000 // len(bad)))
        assert time.time() - start < 5, bad
    assert htmldiff.lines("<a title='x > \"y' rel=\"<b>\">q</a> 1 < 2 <p class=\"menu>z\">w") == [(htmldiff.OPEN, "q 1 < 2"), (htmldiff.OPEN, "w")]


def test_one_article_of_several():
    """The article with most text is the main one; cards of others are dropped, and what
    stands in the article is a part of it."""
    page = "<article><h2>card</h2></article><main><article><p>the main text</p><article>quoted</article></article></main><article>teaser of more</article>"
    text, *_ = htmldiff.main_text(htmldiff.lines(page), set())
    assert text == "the main text\nquoted"


def test_articles_of_the_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op7_html(spark, sf).collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", m[1])]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_blocks_and_regions():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li><a>x</a></ul></nav><div class="cookie-notice">c</div><main><h1>Head &amp; <em>more</em></h1><p>One<br>two &#8364;&nbsp;3<p>Next <!-- gone <p>x</p> --> <script>var a="</p>"</script>end
    <table><tr><td>a<td>b<tr><th>c</table><form><p>f</p></form><aside>s</aside><div class="ad-box"><div>deep</div>ad</div><ul><li>i<li>j</ul><section id="comments"><article class="comment">no</article></section></main>
    <footer>&copy;</footer> tail"""
    assert htmldiff.main_text(htmldiff.lines(page), set())[0] == "Head & more\nOne two € 3\nNext end\na\nb\nc\ni\nj"
    assert htmldiff.lines(None) == [] and htmldiff.lines("") == []
    assert htmldiff.lines("<p>a<p>b</div>c") == [(htmldiff.OPEN, "a"), (htmldiff.OPEN, "b"), (htmldiff.OPEN, "c")]
    nested = '<main><p>lead<article><p>a<div class="sideBar">s</div><div id="readerComments">c</div><p class="with-ads">b</article><p>more</main>'
    assert htmldiff.main_text(htmldiff.lines(nested), set())[0] == "a\nb"


def test_alignment_is_longest():
    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        places = sorted(htmldiff.shared(a, b))
        assert len(places) == length(a, b)
        it = iter(b)
        assert all(a[p] in it for p in places)


def test_differencing_of_neighbours(spark):
    page = lambda own: f"<div>Welcome</div><div>Top</div><p>{own} one</p><p>{own} two</p><div>Imprint</div>"
    rows = [(i, f"http://h.net/a/{i:03}", page(f"story {i}")) for i in range(30)] + [(100, "http://other.net/x", page("alone")), (101, None, None), (102, "http://copy.net/1", page("same")), (103, "http://copy.net/1", page("same"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r.page_id: r.text for r in htmldiff.extract(df.coalesce(1)).collect()}
    assert all(got[i] == f"story {i} one\nstory {i} two" for i in range(30))
    assert got[100].startswith("Welcome") and got[101] == "" and got[102] == got[103] != ""
    assert htmldiff.extract(df.limit(0)).count() == 0


def test_differencing_beyond_copies_and_ranges(spark):
    page = lambda own: f"<div>Welcome</div><p>{own}</p><div>Imprint</div>"
    owns = [f"story {i}" if i % 9 < 3 else f"copy {i // 9}" for i in range(60)]
    rows = [(i, f"http://h.net/a/{i:03}", page(own)) for i, own in enumerate(owns)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for ranges in (1, 4, 40, 70):
        got = htmldiff.extract(df, ranges=ranges).collect()
        assert {r.page_id: r.text for r in got} == dict(enumerate(owns))
        assert all((r.n_shared, r.n_restored, r.n_dropped) == (2, 0, 0) for r in got)


def test_alignment_decides_lines_of_the_table(spark, sf):
    """Whatever the ranges, rows are the same, and the alignment deletes lines."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    one, many = (sorted(map(tuple, htmldiff.extract(pages, ranges=n).collect()), key=str) for n in (1, 40))
    assert one == many
    neighbours = {}
    parsed = {r.page_id: (r.url, htmldiff.lines(r.html)) for r in pages.collect()}
    for i, (url, own) in parsed.items():
        neighbours.setdefault(url.split("/")[2].lower(), []).append(i)
    shown = lambda i: {t for _, t in parsed[i][1]}
    for i, _, text, n_shared, n_restored, n_dropped in one:
        host = parsed[i][0].split("/")[2].lower()
        others = set().union(*(shown(j) for j in neighbours[host] if j != i))
        common = [t for _, t in parsed[i][1] if t in others]
        assert n_shared + n_restored <= len(common)
        assert n_shared + n_dropped + len(text.split("\n")) * bool(text) == len(parsed[i][1])
    assert sum(r[3] for r in one) > 0


def test_hidden_chrome_is_dropped_where_nothing_is_shared(spark):
    rows = [(1, "http://a.net/x", "<nav>only here</nav><p>own one</p>"), (2, "http://a.net/y", "<nav>other</nav><p>own two</p><p>own one</p>"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_shared, r.n_dropped) for r in htmldiff.extract(df).collect()}
    # the shared passage goes from both: no markup says that it is the article
    assert got == {1: ("", 1, 1), 2: ("own two", 1, 1), None: ("", 0, 0)}


# --- bit planes


def test_chunks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([2], np.uint32), rng.integers(0, 50_257, 70_001).astype(np.uint32), np.array([2**32 - 1, 0], np.uint32)):
        assert np.array_equal(bitplane.unpack(bitplane.pack(ids)), ids)
    with pytest.raises(ValueError):
        bitplane.unpack(b"xxxx" + bytes(9))


def reference_ids(texts, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_words_are_the_library_s():
    texts = ["", "a", " a", "a ", "a  b", "x\ny z\n", "it's 'quoted' don't", "123 4½ ٣ é́", "tab\there", "a\u00a0b c", "<|endoftext|> x", "x<|endoftext|>", "😀 ok\u2028z", "a \n b", "**&& ## ,x", "word " * 3000, "e" * 20000]
    e = bitplane.WordEncoder(BPE, memory=10)
    for _ in range(2):
        assert [x.tolist() + [2] for x in e.encode(pa.array(texts))] == reference_ids(texts)


def test_dataset_in_order(spark, tmp_path):
    texts = [None, "", "short", "long text here " * 500] + [f"number {i} of many" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("h", F.lit("clash"))
    path = str(tmp_path / "ids")
    bitplane.write(df, path, BPE, block=300, parts=3)
    got = {r.doc_id: r for r in bitplane.read(spark, path).collect()}
    at = 0
    for i, ids in enumerate(reference_ids(texts)):
        assert got[i].start == at and got[i].ids == np.array(ids, "<u4").tobytes()
        at += len(ids)
    chunks = spark.read.parquet(path)
    assert chunks.where("n_ids > 300").count() == 0


def test_ids_query(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op8_bitplane(spark, sf).collect()}
    at = 0
    for (i, _), ids in zip(docs, reference_ids([t for _, t in docs])):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_tokenizer_without_marks(spark):
    """A tokenizer that opens no word with a mark: texts go to the library whole."""
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib, e = Tokenizer.from_file(path), bitplane.WordEncoder(path)
    texts = ["Some words, here", "", "a b  c"]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_dataset_edges(spark):
    twice = spark.createDataFrame([(7, "same"), (7, "same"), (None, "x")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id) for r in bitplane.encoded(twice, BPE).collect())
    assert [d for _, d in got] == [None, 7, 7] and len({s for s, _ in got}) == 3
    assert bitplane.encoded(twice.limit(0), BPE).count() == 0


# --- top-k


def brute_top_k(rows, queries_, k):
    out = {}
    for qi, q in queries_:
        scores = sorted(((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != qi))
        out[qi] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("block, size, top", [(4096, 40, 30), (64, 6, 9), (300, 3, 2**20)])
def test_top_k_brute_force(spark, block, size, top):
    rng = np.random.default_rng(size)
    base = rng.integers(-top, top, (1500, size))
    base[100:140] = base[99]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [(2000, None), (2001, [1.0]), (2002, [None] * size), (2003, [float("nan")] * size), (2004, [float("inf")] * size), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, vector array<double>").withColumn("id", F.lit("clash"))
    asked = [r for r in rows if r[0] % 50 == 0 or r[0] in (99, 120)]
    found = topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id in (99, 120)"), 7, block=block).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == brute_top_k(rows, asked, 7)


def test_lists_are_read_in_part():
    """Components that are read, of all: few where few matter, fewer than all elsewhere;
    what comes out is the brute-force result."""
    rng = np.random.default_rng(7)
    shapes = {"skewed": np.rint(np.exp(rng.normal(0, 2.5, (3000, 24)))), "even": rng.integers(-30, 30, (3000, 64)).astype(float), "lengths": np.rint(rng.integers(-30, 30, (3000, 64)) * np.exp(rng.normal(0, 1, (3000, 1))))}
    share = {}
    for name, x in shapes.items():
        ids, q, read = np.arange(len(x)), x[::100], Counter()
        got = topk.task_top_k(ids, x, ids[::100], q, 5, block=1000, read=read)
        want = brute_top_k(list(zip(ids.tolist(), x)), list(zip(ids[::100].tolist(), q)), 5)
        assert {i: list(zip(g.vec_id, g.score)) for i, g in got.groupby("query_id")} == want
        assert read["all"] == (3000 - 1) * len(q) * x.shape[1]
        share[name] = read["read"] / read["all"]
    assert share["skewed"] < 0.45 and share["lengths"] < 0.4 and share["even"] < 0.7


def test_short_candidates_are_not_sent(spark, monkeypatch):
    """Queries know from the longest candidates what length it takes; shorter ones stay."""
    monkeypatch.setattr(topk, "TASK_QUERIES", 5)
    rng = np.random.default_rng(8)
    x = np.rint(rng.integers(-30, 30, (600, 8)) * np.exp(rng.normal(0, 1.5, (600, 1))))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    sent = []
    union = type(df).union
    monkeypatch.setattr(type(df), "union", lambda a, b: (sent.append(a.count()), union(a, b))[1])
    found = topk.top_k(df, df.where("vec_id % 30 = 0"), 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top_k(rows, rows[::30], 5)
    assert sent[0] < 0.75 * 600 * 4


def test_queries_that_repeat_a_key(spark):
    """The least vector of a key is asked, whatever the order of rows; vectors of another
    length meet their own."""
    rows = [(1, [5.0, 0.0]), (1, [0.0, 5.0]), (2, [1.0, 9.0]), (3, [9.0, 1.0]), (4, [1.0]), (5, [7.0]), (6, [])]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "vec_id long, vector array<double>")
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id in (1, 4)"), 1).collect())
        assert got == [(1, 1, 2, 45), (4, 1, 5, 7)]


def test_top_k_edges(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    few = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0])], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(few, few, 5).collect())
    assert got == [(1, 1, 2, 1), (2, 1, 1, 1), (2, 2, 1, 1)]
    assert topk.top_k(few.limit(0), few.limit(0), 5).count() == 0


def test_top_k_query_leaves_odd_vectors_out(spark, tmp_path):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    rows = [(0, [0.51, -0.26]), (1, [1.0, 1.0]), (20, [float("nan"), 0.0]), (40, None), (60, [None, 1.0]), (3, [float("-inf"), 1.0]), (80, [-0.01, 2.0])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in queries.op9_top_k(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 1, 32 * 64 - 17 * 64), (0, 2, 80, -32 - 17 * 128), (80, 1, 1, -64 + 128 * 64), (80, 2, 0, -32 - 17 * 128)]


def test_sql_of_queries(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(names)
        assert order == sorted(df.columns)
        theirs = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=str) == theirs


# --- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as pipe
    from sparkroom.llm import langid, secrets, simhash

    assert [n for n, _ in pipe.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit("clash")).withColumn("spans", F.lit(1))
    steps = [f for _, f in pipe.STAGES]
    classify = langid.Classifier(langid.train(queries.learning_rows(docs)))
    one = steps[0](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect() if classify(r.text)[2]}
    assert one.columns == docs.columns
    again = docs.union(docs.where("doc_id < 5"))
    two = steps[1](spark, again, sf)
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    first = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and first[i] != first[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                low, high = sorted((first[i], first[j]))
                first = {k: low if v == high else v for k, v in first.items()}
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(first.values()))
    assert two.columns == docs.columns
    three = steps[2](spark, docs, sf)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    dirty = {r.doc_id for r in docs.collect() if any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    assert dirty
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in docs.collect()} - dirty and three.columns == docs.columns
    marked = docs.withColumn("text", F.when(F.col("doc_id") == 0, F.lit("x password=abcdef99 y")).when(F.col("doc_id") == 1, F.lit(None)).otherwise(F.col("text")))
    four = {r.doc_id: r for r in steps[3](spark, marked, sf).collect()}
    assert len(four) == docs.count() and four[0].text == "x [SECRET] y" and four[0].n_chars == 12 and four[1].text is None
    from test_text_ops import base_spans, plain_spans

    weights = secrets.train(marked)
    for r in marked.collect():
        text = r.text or ""
        base = base_spans(text)
        out, at = "", 0
        for begin, _, end in sorted(base + [s for s in plain_spans(text, weights) if not any(b[0] < s[2] and s[0] < b[2] for b in base)]):
            if begin >= at:
                out += text[at:begin] + "[SECRET]"
            at = max(at, end)
        assert (four[r.doc_id].text or "") == out + text[at:]
    five = {r.doc_id: r for r in steps[4](spark, marked, sf).collect()}
    assert all(r.round_trip for r in five.values()) and five[1].n_ids == 0
    empty = docs.limit(0)
    for f in steps:
        assert f(spark, empty, sf).count() == 0
    names = ["__hash", "__language", "language", "ids", "decoded", "name", "root", "h", "__doc", "__id", "__t", "n_hit"]
    clash = again.where("doc_id < 40").withColumns({n: F.lit(n) for n in names})
    for f in steps[:-1]:
        left = f(spark, clash, sf)
        assert left.columns == clash.columns and all(r[n] == n for r in left.collect() for n in names)
    assert steps[-1](spark, clash, sf).columns == ["doc_id", "ids", "n_ids", "round_trip"]
    assert secrets.KINDS[-1] == "markov"


def test_pipeline_run(spark, sf):
    import corpus_pipeline as pipe

    got = pipe.run(spark, sf)
    assert 0 < got.count() <= 200 and got.columns == ["doc_id", "ids", "n_ids", "round_trip"]
