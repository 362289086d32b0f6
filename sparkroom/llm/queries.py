"""Queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroom.llm import bitplane, centroids, decontam, htmldiff, langid, secrets, sentencepiece, sharding, simhash, topk, turns, urlfilter, vectordup
from sparkroom.llm.common import table


def learning_rows(docs: DataFrame) -> DataFrame:
    """Labelled documents that language models may be learned from."""
    return docs.where(~held_out() & F.col("lang").isNotNull())


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(learning_rows(docs))
    found = langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.accepted")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
hit AS (
  SELECT rid, i, n, item
  FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)) AS x
  JOIN bw USING (n, win)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "embeddings").where(topk.whole(F.col("embedding")))  # floor() takes NaN for 0
    vectors = whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 20
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "row.doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmldiff.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_restored", "n_dropped")


def op8_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = bitplane.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_vectors(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fits
  FROM embeddings),
v AS (SELECT rid, vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM r WHERE fits),
e AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.x) = len(b.x)
  WHERE list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT rid AS a, rid AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a AS rid, min(vec_id) AS component_id FROM reach JOIN r ON reach.b = r.rid GROUP BY a),
links AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM r JOIN root USING (rid) LEFT JOIN links USING (rid)
"""


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = centroids.cluster(table(spark, sf_dir, "embeddings"))
    named = centroids.with_inertia(rows, centres)
    return named.select(F.col("key").alias("vec_id"), "cluster", F.col("exact").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql() -> str:
    """Rounds of plain comparison, one after the other."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'cluster': cluster}}) AS best
  FROM (SELECT rid, vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{b})
  GROUP BY rid)"""
    means = """c{r} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, o.c) AS c
  FROM c{b} o LEFT JOIN (
    SELECT cluster, list(e ORDER BY j) AS c
    FROM (SELECT cluster, j, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS e
          FROM (SELECT best.cluster AS cluster, CAST(unnest(x) AS BIGINT) AS e, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY cluster, j)
    GROUP BY cluster) m USING (cluster))"""
    rounds = ",\n".join(part.format(r=r, b=r - 1) for r in range(1, 6) for part in (nearest, means))
    return (
        """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id, x) - 1 AS INTEGER) AS cluster, x AS c
  FROM v QUALIFY cluster < 40),
"""
        + rounds
        + ",\n"
        + nearest.format(r=6, b=5)
        + """
SELECT vec_id, best.cluster AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.c, ',')) AS centroid_sha256
FROM a6 JOIN c5 ON a6.best.cluster = c5.cluster
"""
    )


OP12_SQL = _op12_sql()


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")), dropped=F.col("dropped"))


# the least cost and edits of each place in the pattern, turn by turn
OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(
           flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                  lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
           CAST(4294967295 AS BIGINT)) AS crc
  FROM conversations),
fated AS (SELECT *, xor(crc, 4294967295) % 20 AS fate FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 0 THEN 0 WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated),
placed AS (
  SELECT conv_id, turn, role, text, substring(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN open_end THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY conv_id),
given(f, t, role) AS (VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
inserted AS (
  SELECT f, t, 2 AS cost, 'I' AS edits, [role || ':'] AS lines FROM given
  UNION ALL SELECT a.f, b.t, 4, 'II', [a.role || ':', b.role || ':'] FROM given a JOIN given b ON a.t = b.f
  UNION ALL SELECT unnest(['0', 's', 'u', 'a']), unnest(['0', 's', 'u', 'a']), 0, '', CAST([] AS VARCHAR[])),
follow(f, t) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
steps AS (
  SELECT conv_id, i, f, unnest([
    {'t': f, 'cost': 3, 'edit': 'D', 'lines': CAST([] AS VARCHAR[])},
    {'t': CASE WHEN fault NOT IN ('blank', 'duplicate') AND (f, initial) IN (SELECT (f, t) FROM follow) THEN initial END, 'cost': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'edit': 'K', 'lines': [role || ':' || text]},
    {'t': CASE WHEN fault NOT IN ('blank', 'duplicate') THEN CASE WHEN f = 'u' THEN 'a' ELSE 'u' END END, 'cost': CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'edit': 'R',
     'lines': [CASE WHEN f = 'u' THEN 'assistant:' ELSE 'user:' END || text]}]) AS s
  FROM faults, (SELECT unnest(['0', 's', 'u', 'a']) AS f)),
state AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS g, {'cost': CAST(0 AS BIGINT), 'edits': '', 'lines': CAST([] AS VARCHAR[])} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, g, best FROM (
    SELECT state.conv_id, steps.i, steps.s.t AS g,
           min({'cost': CAST(state.best.cost + inserted.cost + steps.s.cost AS BIGINT), 'edits': state.best.edits || inserted.edits || steps.s.edit, 'lines': list_concat(list_concat(state.best.lines, inserted.lines), steps.s.lines)}) AS best
    FROM state JOIN inserted ON state.g = inserted.f
    JOIN steps ON steps.conv_id IS NOT DISTINCT FROM state.conv_id AND steps.i = state.i + 1 AND steps.f = inserted.t
    WHERE steps.s.t IS NOT NULL
    GROUP BY state.conv_id, steps.i, steps.s.t)),
ended AS (
  SELECT s.conv_id, min({'cost': s.best.cost + x.cost, 'edits': s.best.edits || x.edits, 'lines': list_concat(s.best.lines, x.lines)}) AS best
  FROM state s JOIN counts k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.n = s.i JOIN inserted x ON x.f = s.g
  WHERE x.t IN ('0', 'a') GROUP BY s.conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.edits, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM every LEFT JOIN counts ON every.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN ended ON every.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


QUERIES = {
    "op1_language": op1_language,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_bitplane": op8_bitplane,
    "op9_top_k": op9_top_k,
    "op10_secrets": op10_secrets,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_clustering": op12_clustering,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL = {"op5_decontamination": OP5_SQL, "op9_top_k": OP9_SQL, "op11_embedding_dedup": OP11_SQL, "op12_clustering": OP12_SQL, "op13_conversations": OP13_SQL}
