"""Queries of metadata operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkroom.functions import points
from sparkroom.operators import fits, tags, times
from sparkroom.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict = {}

TAGS = """t AS (SELECT o_orderkey AS image_id, CAST(o_orderkey % 3 AS INTEGER) AS ifd, unnest(['Status', 'Priority', 'Owner']) AS name, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS value FROM orders)"""
NEW = "n AS (SELECT image_id, ifd, CASE WHEN name = 'Owner' THEN 'Artist' ELSE name END AS name, value || '!' AS value FROM t WHERE name <> 'Priority')"
PART = """p AS (SELECT p_partkey AS image_id, CAST(p_partkey % 4 AS INTEGER) AS ifd, [['ifd0'], ['raw'], ['exif'], ['ifd0', 'raw']][CAST(p_partkey % 4 + 1 AS INTEGER)] AS kinds,
  unnest(['Make', 'Model', 'ImageWidth', 'ExposureTime', 'ColorMatrix1', 'Orientation', 'BlackLevel', 'x-type']) AS name,
  unnest(['ASCII', 'ASCII', 'LONG', 'RATIONAL', 'SRATIONAL', 'DOUBLE', 'SHORT', 'ASCII']) AS dtype,
  unnest([strlen(p_brand) + 1, strlen(p_name) + 1, 1, 1, p_size % 10, 1, 1, strlen(p_type) + 1]) AS count FROM part)"""
#: The registry and the groups of types that stand for each other, as SQL tables.
REGISTRY = "reg(name, types, need, place) AS (VALUES " + ", ".join(f"('{n}', string_split('{types}', ' '), {count}, '{place}')" for n, _, types, count, place in tags.REGISTRY) + ")"
KINDS = "kind(dtype, fraction) AS (SELECT unnest(string_split('BYTE SHORT LONG SBYTE UNDEFINED SSHORT SLONG IFD LONG8 SLONG8 IFD8 ASCII', ' ')), false UNION ALL SELECT unnest(string_split('RATIONAL SRATIONAL FLOAT DOUBLE', ' ')), true)"


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _new(spark, sf):
    """A second tag set over all orders: one tag renamed, one changed, one absent."""
    t = views.order_tags(spark, sf).where("name <> 'Priority'")
    return t.select("image_id", "ifd", F.when(F.col("name") == "Owner", "Artist").otherwise(F.col("name")).alias("name"), F.concat("value", F.lit("!")).alias("value"))


@add("tag_upsert", f"WITH {TAGS}, {NEW} SELECT coalesce(n.image_id, t.image_id) AS image_id, coalesce(n.ifd, t.ifd) AS ifd, coalesce(n.name, t.name) AS name, CASE WHEN n.image_id IS NOT NULL THEN n.value ELSE t.value END AS value FROM t FULL JOIN n USING (image_id, ifd, name)")
def tag_upsert(spark, sf):
    return tags.upsert(views.order_tags(spark, sf), _new(spark, sf))


@add("tag_latest", "SELECT l_orderkey AS image_id, l_linenumber AS ifd, max(CAST(l_shipdate AS VARCHAR)) AS value FROM lineitem GROUP BY ALL")
def tag_latest(spark, sf):
    t = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ifd"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("value"))
    return tags.latest(t, F.col("value"), ("image_id", "ifd"))


@add("tag_strip", f"WITH {TAGS} SELECT image_id, ifd, name, value FROM t WHERE name NOT IN ('Owner', 'Nothing')")
def tag_strip(spark, sf):
    names = spark.createDataFrame([("Owner",), ("Nothing",)], "name string")
    return tags.strip(views.order_tags(spark, sf), names).select("image_id", "ifd", "name", "value")


@add("tag_merge", f"WITH {TAGS}, {NEW} SELECT image_id, ifd, name, value FROM n UNION ALL SELECT image_id, ifd, name, value FROM t WHERE (image_id, ifd, name) NOT IN (SELECT (image_id, ifd, name) FROM n)")
def tag_merge(spark, sf):
    return tags.merge(views.order_tags(spark, sf), _new(spark, sf))


@add("tag_diff", f"WITH {TAGS}, {NEW} SELECT *, 'missing' AS side FROM (SELECT image_id, ifd, name FROM t EXCEPT ALL SELECT image_id, ifd, name FROM n) UNION ALL SELECT *, 'extra' FROM (SELECT image_id, ifd, name FROM n EXCEPT ALL SELECT image_id, ifd, name FROM t)")
def tag_diff(spark, sf):
    return tags.difference(views.order_tags(spark, sf), _new(spark, sf))


@add("tag_compare", f"WITH {TAGS}, {NEW} SELECT image_id, ifd, name, t.value AS a, n.value AS b FROM t JOIN n USING (image_id, ifd, name) WHERE t.value IS DISTINCT FROM n.value AND name NOT IN ('Priority')")
def tag_compare(spark, sf):
    return tags.compare(views.order_tags(spark, sf), _new(spark, sf), ("Priority",))


@add("tag_filter", f"WITH {TAGS} SELECT image_id, ifd, name, value FROM t WHERE regexp_matches(name, '^(St|Pr|O)') AND NOT regexp_matches(name, 'ner$') AND ifd = 1")
def tag_filter(spark, sf):
    return tags.filter_tags(views.order_tags(spark, sf), "^(St|Pr|O)", "ner$", 1)


@add("tag_summary", f"WITH {TAGS} SELECT ifd, count(*) AS n_tags, count(DISTINCT name) AS n_names FROM t GROUP BY ifd")
def tag_summary(spark, sf):
    return tags.summary(views.order_tags(spark, sf))


@add("tag_matrix", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS m00, round(CAST(embedding[5] AS DOUBLE), 6) AS m11, round(CAST(embedding[8] AS DOUBLE), 6) AS m21 FROM embeddings")
def tag_matrix(spark, sf):
    m = views.table(spark, sf, "embeddings").select("vec_id", tags.matrix(F.slice("embedding", 1, 9)).alias("m"))
    cell = lambda i, j: F.round(F.col("m")[i][j].cast("double"), 6).alias(f"m{i}{j}")
    return m.select("vec_id", cell(0, 0), cell(1, 1), cell(2, 1))


@add("tag_lookup", "WITH a AS (SELECT p_partkey, ['Make', 'make', 'MODEL', 'ImageWidth', 'nothing'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS asked FROM part) SELECT p_partkey, asked, CASE lower(asked) WHEN 'make' THEN 'Make' WHEN 'model' THEN 'Model' WHEN 'imagewidth' THEN 'ImageWidth' END AS name, CASE WHEN asked IN ('Make', 'ImageWidth') THEN 'exact' WHEN asked = 'nothing' THEN 'unknown' ELSE 'folded' END AS how FROM a")
def tag_lookup(spark, sf):
    names = F.lit(["Make", "make", "MODEL", "ImageWidth", "nothing"])
    asked = views.table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("asked"))
    return tags.lookup(asked, tags.registry(spark))


@add("tag_encode", "WITH a AS (SELECT p_partkey, ['ASCII', 'LONG', 'RATIONAL'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS dtype, p_retailprice AS v, p_brand AS s FROM part) SELECT p_partkey, dtype, CASE dtype WHEN 'LONG' THEN CAST(floor(v) AS BIGINT) WHEN 'RATIONAL' THEN CAST(floor(v * 1e6 + 0.5e0) AS BIGINT) END AS num, CAST(CASE dtype WHEN 'LONG' THEN 1 WHEN 'RATIONAL' THEN 1000000 END AS BIGINT) AS den, CASE WHEN dtype = 'ASCII' THEN s END AS text, CAST(CASE WHEN dtype = 'ASCII' THEN strlen(s) + 1 ELSE 1 END AS INTEGER) AS count FROM a")
def tag_encode(spark, sf):
    p = views.table(spark, sf, "part").withColumn("dtype", F.get(F.lit(["ASCII", "LONG", "RATIONAL"]), (F.col("p_partkey") % 3).cast("int")))
    return p.select("p_partkey", "dtype", tags.encode(F.col("dtype"), F.col("p_retailprice"), F.col("p_brand")).alias("e")).select("p_partkey", "dtype", "e.*")


@add("tag_validate", f"""WITH {PART}, {REGISTRY}, {KINDS},
t AS (SELECT r.name, bool_or(k.fraction) AS has_fraction, bool_or(NOT k.fraction) AS has_whole FROM (SELECT name, unnest(types) AS dtype FROM reg) r JOIN kind k USING (dtype) GROUP BY r.name),
i AS (SELECT image_id, ifd, p.name, CASE WHEN reg.name IS NULL THEN 'unknown tag' WHEN NOT (CASE WHEN k.fraction THEN has_fraction ELSE has_whole END) THEN 'wrong type' WHEN need > 0 AND p.count <> need THEN 'wrong count' WHEN place <> 'any' AND NOT list_contains(kinds, place) THEN 'belongs in ' || place END AS issue
  FROM p LEFT JOIN reg USING (name) LEFT JOIN t USING (name) JOIN kind k ON k.dtype = p.dtype)
SELECT * FROM i WHERE issue IS NOT NULL""")
def tag_validate(spark, sf):
    return tags.validate(views.part_tags(spark, sf), tags.registry(spark))


@add("xmp_points", "SELECT event_id, CAST(CAST(floor(least(greatest(value / 5e2, 0e0), 1e0) * 255 + 0.5e0) AS INTEGER) AS VARCHAR) || ', ' || CAST(CAST(floor(least(greatest(value / 1e3, 0e0), 1e0) * 255 + 0.5e0) AS INTEGER) AS VARCHAR) AS point FROM events")
def xmp_points(spark, sf):
    at = lambda d: points.clamp(F.col("value") / d)
    p = F.array(F.struct(at(500.0).alias("x"), at(1000.0).alias("y")))
    return views.table(spark, sf, "events").select("event_id", F.array_join(tags.curve_points_to_xmp(p), ";").alias("point"))


@add("xmp_roundtrip", "SELECT p_partkey, p_name AS title, p_type || ' <&\"> ' || p_brand AS note FROM part")
def xmp_roundtrip(spark, sf):
    p = views.table(spark, sf, "part")
    values = F.create_map(F.lit("dc:title"), F.col("p_name"), F.lit("dc:note"), F.concat("p_type", F.lit(' <&"> '), "p_brand"))
    back = p.select("p_partkey", tags.xmp_values(tags.xmp_packet(values)).alias("m"))
    return back.select("p_partkey", F.col("m")["dc:title"].alias("title"), F.col("m")["dc:note"].alias("note"))


@add("exif_flatten", "SELECT event_id AS image_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def exif_flatten(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_id").alias("image_id"), F.from_json("props", "map<string,string>").alias("exif"))
    return tags.flatten_exif(e.withColumn("exif", F.map_concat("exif", F.create_map(F.lit("ExifVersion"), F.lit("0231")))))


SHIFTS = ["+1:30", "-2 04:00:00", "00:00:05", "1 00:00", "bad", "-0:01", "178:00", "1:2", "5", "", " 3 4 ", "1:2:3:4", "-7", "+:5"]
#: The rule as SQL: an optional sign, days before a blank, then one to three numbers.
_PARSED = f"""a AS (SELECT o_orderkey, o_orderdate, [{", ".join(f"'{t}'" for t in SHIFTS)}][CAST(o_orderkey % {len(SHIFTS)} + 1 AS INTEGER)] AS text FROM orders),
b AS (SELECT *, trim(text) AS t, CASE WHEN trim(text) LIKE '-%' THEN -1 ELSE 1 END AS sgn, CASE WHEN left(trim(text), 1) IN ('+', '-') THEN substr(trim(text), 2) ELSE trim(text) END AS body FROM a),
c AS (SELECT *, CASE WHEN contains(body, ' ') THEN split_part(body, ' ', 1) ELSE '0' END AS d, string_split(CASE WHEN contains(body, ' ') THEN trim(substr(body, strpos(body, ' ') + 1)) ELSE body END, ':') AS hms FROM b),
p AS (SELECT o_orderkey, o_orderdate, text, CASE WHEN t = '' THEN 0 WHEN len(hms) > 3 OR NOT regexp_full_match(d, '[0-9]+') OR len(list_filter(hms, lambda x: NOT regexp_full_match(x, '[0-9]+'))) > 0 THEN NULL
  ELSE sgn * (TRY_CAST(d AS BIGINT) * 86400 + TRY_CAST(hms[1] AS BIGINT) * 3600 + coalesce(TRY_CAST(hms[2] AS BIGINT), 0) * 60 + coalesce(TRY_CAST(hms[3] AS BIGINT), 0)) END AS seconds FROM c)"""


def _shift_texts(spark, sf):
    return views.table(spark, sf, "orders").withColumn("text", F.get(F.lit(SHIFTS), (F.col("o_orderkey") % len(SHIFTS)).cast("int")))


@add("time_shift_parse", f"WITH {_PARSED} SELECT o_orderkey, text, CAST(seconds AS BIGINT) AS seconds FROM p")
def time_shift_parse(spark, sf):
    return _shift_texts(spark, sf).select("o_orderkey", "text", times.shift_seconds(F.col("text")).alias("seconds"))


@add("time_shift", f"WITH {_PARSED} SELECT o_orderkey, o_orderdate + to_seconds(coalesce(seconds, 0)) AS shifted FROM p")
def time_shift(spark, sf):
    return _shift_texts(spark, sf).select("o_orderkey", times.shift(F.col("o_orderdate"), F.coalesce(times.shift_seconds(F.col("text")), F.lit(0))).alias("shifted"))


ZONES = ["+00:00", "+05:30", "-08:00", "x"]


@add("time_zone", "SELECT o_orderkey, o_orderdate, ['+00:00', '+05:30', '-08:00', 'x'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS zone, CAST([0, 330, -480, NULL][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS INTEGER) AS minutes FROM orders")
def time_zone(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.get(F.lit(ZONES), (F.col("o_orderkey") % 4).cast("int")).alias("zone"))
    return o.withColumn("minutes", times.zone_minutes(F.col("zone")))


@add("fits_datetime", "WITH d AS (SELECT event_id, date_trunc('second', ts) AS s, event_id % 4 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN s WHEN 1 THEN s + to_milliseconds(250) WHEN 2 THEN CAST(CAST(s AS DATE) AS TIMESTAMP) END AS taken FROM d")
def fits_datetime(spark, sf):
    ts = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 4
    text = F.when(k == 0, ts("yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.concat(ts("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".25"))).when(k == 2, ts("yyyy-MM-dd")).otherwise(ts("dd/MM/yyyy"))
    return views.table(spark, sf, "events").select("event_id", times.fits_datetime(text).alias("taken"))


@add("meta_ops", "SELECT o_orderkey, o_orderdate + to_seconds(5400 - 60) AS taken, '-08:00' AS zone FROM orders")
def meta_ops(spark, sf):
    ops = [{"type": "shift-time", "value": "1:30"}, {"type": "shift-timezone", "timezone": "+05:30"}, {"type": "shift-time", "offset": "-0:01"}, {"type": "shift-time", "value": "soon"}, {"type": "shift-timezone", "value": " -08:00 "}, {"type": "shift-timezone", "value": " "}]
    taken, zone = times.apply_ops(F.col("o_orderdate"), F.lit("+00:00"), ops)
    return views.table(spark, sf, "orders").select("o_orderkey", taken.alias("taken"), zone.alias("zone"))


_OPS = [{"type": "strip", "name": " Priority "}, {"type": "set", "name": "Owner", "value": "me"}, {"type": "set", "name": "Artist", "value": "you"}, {"type": "strip", "name": " "}, {"type": "set", "name": "Owner", "value": "us"}]


@add("tag_ops", f"WITH {TAGS}, k AS (SELECT DISTINCT image_id, ifd FROM t) SELECT image_id, ifd, name, value FROM t WHERE name NOT IN ('Priority', 'Owner') UNION ALL SELECT image_id, ifd, 'Owner', 'us' FROM k UNION ALL SELECT image_id, ifd, 'Artist', 'you' FROM k")
def tag_ops(spark, sf):
    """A list of operations on every tag set: strips first, then sets, the last wins."""
    return tags.apply_ops(views.order_tags(spark, sf), _OPS)


def _knots(v: str, knots) -> str:
    cases = " ".join(f"WHEN {v} < {x1} THEN {y0}::DOUBLE + ({v} - {x0}) * ({y1 - y0:.17g}::DOUBLE / {x1 - x0})" for (x0, y0), (x1, y1) in zip(knots, knots[1:]))
    return f"CASE WHEN {v} < {knots[0][0]} THEN {knots[0][1]}::DOUBLE {cases} ELSE {knots[-1][1]}::DOUBLE END"


@add("interp_gain", f"WITH g AS (SELECT p_partkey, CAST(p_partkey % 230 AS DOUBLE) + 0.37e0 AS gain FROM part) SELECT p_partkey, CAST(floor(100 * 2.55e0 / {_knots('gain', fits.GAIN_TABLE)}) AS BIGINT) AS iso FROM g")
def interp_gain(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", fits.iso_of_gain((F.col("p_partkey") % 230).cast("double") + 0.37).alias("iso"))


@add("interp_wb", f"WITH g AS (SELECT p_partkey, CAST(p_partkey % 120 AS DOUBLE) AS wb FROM part) SELECT p_partkey, round({_knots('wb', fits.BLUE_TABLE)} / 1.34e0, 6) AS ratio FROM g")
def interp_wb(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", F.round(fits.balance_ratio((F.col("p_partkey") % 120).cast("double")), 6).alias("ratio"))


@add("camera_tags", f"WITH g AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ' ZWO ASI676MC' ELSE 'other' END AS instrument, CAST(s_suppkey % 220 AS DOUBLE) + 0.4e0 AS gain, CAST(s_suppkey % 90 AS DOUBLE) AS wb FROM supplier) SELECT s_suppkey, instrument, CAST(CASE WHEN s_suppkey % 2 = 0 THEN floor(100 * 2.55e0 / {_knots('gain', fits.GAIN_TABLE)}) ELSE floor(gain) END AS BIGINT) AS iso, CASE WHEN s_suppkey % 2 = 0 THEN round(wb / 80e0, 6) END AS red, CASE WHEN s_suppkey % 2 = 0 THEN round({_knots('wb', fits.BLUE_TABLE)} / 1.34e0, 6) END AS blue FROM g")
def camera_tags(spark, sf):
    key = F.col("s_suppkey")
    s = views.table(spark, sf, "supplier").select("s_suppkey", F.when(key % 2 == 0, " ZWO ASI676MC").otherwise("other").alias("instrument"), ((key % 220).cast("double") + 0.4).alias("gain"), (key % 90).cast("double").alias("wb"))
    balance = fits.analog_balance(F.col("instrument"), F.col("wb"), F.col("wb"))
    return s.select("s_suppkey", "instrument", fits.camera_iso(F.col("instrument"), F.col("gain")).alias("iso"), F.round(balance[0], 6).alias("red"), F.round(balance[2], 6).alias("blue"))


def _headers(spark, sf):
    """One header for each part, with keywords that some lack, leave blank or set to 0;
    dealt by part, so that work is spread before rows are many and large."""
    p = views.table(spark, sf, "part").repartition("p_partkey")
    key = F.col("p_partkey")
    pick = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    two = lambda n: F.lpad((F.col("p_partkey") % n).cast("string"), 2, "0")
    entries = F.array(
        pick(key % 3 > 0, "OBJECT", F.when(key % 3 == 1, F.col("p_name")).otherwise(F.lit("  "))),
        pick(key % 2 == 0, "TELESCOP", F.concat(F.col("p_brand"), F.lit(" "))),
        pick(key % 5 < 3, "OBSERVER", F.when(key % 5 == 0, F.lit("")).otherwise(F.col("p_brand"))),
        pick(key % 7 > 0, "CREATOR", F.col("p_type")),
        pick(key % 4 > 0, "SCALE", F.when(key % 4 == 1, F.lit(0)).otherwise(F.col("p_size"))),
        pick(key % 2 == 1, "CDELT2", F.lit("0.0025")),
        pick(key % 3 > 0, "CROTA1", (key % 3 - 1) * 10),
        pick(key % 4 == 2, "CROTA2", F.lit(-7)),
        pick(key % 5 == 4, "ROTATANG", F.lit(0)),
        pick(key % 6 > 0, "RA", F.concat(two(24), F.lit(" "), two(60), F.lit(" 30"))),
        pick(key % 6 > 1, "DEC", F.concat(F.when(key % 2 == 0, F.lit("-")).otherwise(F.lit("+")), two(95), F.lit(":30:00"))),
        pick(F.lit(True), "NAXIS1", F.col("p_size") * 2),
        pick(key % 3 < 2, "NAXIS2", F.col("p_size")),
        pick(key % 2 == 0, "EXPTIME", F.col("p_size") / 4.0),
        pick(key % 4 < 3, "INSTRUME", F.when(key % 4 < 2, F.lit("ZWO ASI676MC")).otherwise(F.lit("other"))),
        pick(key % 3 < 2, "GAIN", (key % 220).cast("double") + 0.4),
        pick(key % 5 > 0, "WB_RED", key % 90),
        pick(key % 5 > 1, "WB_BLUE", key % 120),
        pick(key % 2 == 1, "BAYERPAT", F.lit("rggb")),
        pick(key % 4 == 3, "PEDESTAL", key % 60),
        pick(key % 3 == 0, "CWHITE", F.lit(4095)),
        pick(key % 3 == 1, "DATE-OBS", F.concat(F.lit("2024-02-28T23:59:"), two(60))),
    )
    return p.select("p_partkey", "p_size", F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("header"))


#: The same headers in SQL, a column for each keyword.
_HEADERS = """h AS (SELECT p_partkey AS k, p_size,
  CASE k % 3 WHEN 1 THEN p_name WHEN 2 THEN '  ' END AS object, CASE WHEN k % 2 = 0 THEN p_brand || ' ' END AS telescop,
  CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 < 3 THEN p_brand END AS observer, CASE WHEN k % 7 > 0 THEN p_type END AS creator,
  CASE WHEN k % 4 = 1 THEN 0e0 WHEN k % 4 > 0 THEN CAST(p_size AS DOUBLE) END AS scale, CASE WHEN k % 2 = 1 THEN 0.0025e0 END AS cdelt2,
  CASE WHEN k % 3 > 0 THEN (k % 3 - 1) * 10e0 END AS crota1, CASE WHEN k % 4 = 2 THEN -7e0 END AS crota2, CASE WHEN k % 5 = 4 THEN 0e0 END AS rotatang,
  CASE WHEN k % 6 > 0 THEN k % 24 + k % 60 / 60e0 + 30 / 3600e0 END AS ra, CASE WHEN k % 6 > 1 THEN (CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) * (k % 95 + 30 / 60e0) END AS dec,
  p_size * 2 AS naxis1, CASE WHEN k % 3 < 2 THEN p_size END AS naxis2, CASE WHEN k % 2 = 0 THEN p_size / 4e0 END AS exptime,
  CASE WHEN k % 4 < 2 THEN 'ZWO ASI676MC' WHEN k % 4 = 2 THEN 'other' END AS instrume, CASE WHEN k % 3 < 2 THEN k % 220 + 0.4e0 END AS gain,
  CASE WHEN k % 5 > 0 THEN CAST(k % 90 AS DOUBLE) END AS wb_red, CASE WHEN k % 5 > 1 THEN CAST(k % 120 AS DOUBLE) END AS wb_blue,
  CASE WHEN k % 2 = 1 THEN 'rggb' END AS bayerpat, CASE WHEN k % 4 = 3 THEN k % 60 END AS pedestal, CASE WHEN k % 3 = 0 THEN 4095 END AS cwhite,
  CASE WHEN k % 3 = 1 THEN TIMESTAMP '2024-02-28 23:59:00' + to_seconds(k % 60) END AS taken
  FROM (SELECT *, p_partkey AS k FROM part))"""


@add("avm_map", f"""WITH {_HEADERS}, n AS (SELECT *, ra IS NOT NULL AND abs(dec) <= 90 AS placed, coalesce(nullif(scale, 0), nullif(cdelt2, 0)) AS s FROM h)
SELECT k AS p_partkey, nullif(trim(object), '') AS subject, trim(telescop) AS facility, instrume AS instrument, coalesce(nullif(observer, ''), creator) AS creator,
  round(CASE WHEN placed THEN ra * 15 END, 6) AS ra, round(CASE WHEN placed THEN dec END, 6) AS dec, CASE WHEN placed THEN 'ICRS' END AS frame,
  round(CASE WHEN s < 0.01e0 THEN s ELSE s / 3600 END, 9) AS scale, coalesce(nullif(crota1, 0), nullif(crota2, 0), rotatang) AS rotation,
  CASE WHEN naxis2 IS NOT NULL AND p_size > 0 THEN naxis1 / 2e0 END AS px, CASE WHEN naxis2 IS NOT NULL AND p_size > 0 THEN naxis2 / 2e0 END AS py, exptime AS seconds,
  CASE WHEN k % 3 = 1 THEN strftime(taken, '%Y-%m-%dT%H:%M:%S') END AS start, 'Observation' AS kind, '1.1' AS version FROM n""")
def avm_map(spark, sf):
    m = _headers(spark, sf).select("p_partkey", fits.avm(F.col("header")).alias("m"))
    get = lambda k, i=0: F.get(F.try_element_at("m", F.lit(k)), F.lit(i))
    number = lambda k, i=0: get(k, i).cast("double")
    texts = {"subject": "Subject.Name", "facility": "Facility", "instrument": "Instrument", "creator": "Creator", "frame": "Spatial.CoordinateFrame", "start": "TemporalStartTime", "kind": "Type", "version": "MetadataVersion"}
    numbers = {"ra": ("Spatial.ReferenceValue", 0), "dec": ("Spatial.ReferenceValue", 1), "px": ("Spatial.ReferencePixel", 0), "py": ("Spatial.ReferencePixel", 1), "rotation": ("Spatial.Rotation", 0), "seconds": ("TemporalIntegrationTime", 0)}
    digits = {"ra": 6, "dec": 6}
    return m.select("p_partkey", *[get(k).alias(n) for n, k in texts.items()], F.round(number("Spatial.Scale", 1), 9).alias("scale"), *[(F.round(number(*at), digits[n]) if n in digits else number(*at)).alias(n) for n, at in numbers.items()])


@add("avm_scale", "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size / 1e4 ELSE p_size / 1e1 END AS v FROM part) SELECT p_partkey, round(-CASE WHEN v < 0.01e0 THEN v ELSE v / 3600 END, 9) AS low, round(CASE WHEN v < 0.01e0 THEN v ELSE v / 3600 END, 9) AS high FROM s")
def avm_scale(spark, sf):
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 1e4).otherwise(F.col("p_size") / 1e1)
    s = views.table(spark, sf, "part").select("p_partkey", fits.spatial_scale(v).alias("s"))
    return s.select("p_partkey", F.round(F.col("s")[0], 9).alias("low"), F.round(F.col("s")[1], 9).alias("high"))


@add("fits_tags", f"""WITH {_HEADERS}, s AS (SELECT *, nullif(p_size % 5, 0) AS black, CASE WHEN k % 2 = 0 THEN log2(0.06e0 * 4095 / (p_size + 1)) END AS exposure, instrume = 'ZWO ASI676MC' AS tabled FROM h),
b AS (SELECT *, CASE WHEN tabled AND wb_red IS NOT NULL AND wb_blue IS NOT NULL THEN {{knots}} / 1.34e0 END AS blue FROM s)
SELECT k AS p_partkey, CASE WHEN bayerpat IS NOT NULL THEN 'RGGB' END AS pattern, instrume AS model,
  CAST(CASE WHEN tabled THEN floor(100 * 2.55e0 / {{gains}}) ELSE floor(gain) END AS BIGINT) AS iso, round(CASE WHEN blue IS NOT NULL THEN wb_red / 80 END, 6) AS red, round(blue, 6) AS blue,
  exptime AS seconds, strftime(taken + to_seconds(3600), '%Y:%m:%d %H:%M:%S') AS taken, CAST(coalesce(pedestal, black) AS BIGINT) AS black, CAST(cwhite AS BIGINT) AS white, round(exposure, 6) AS exposure, '+02:00' AS zone FROM b""")
def fits_tags(spark, sf):
    """Tags that headers and statistics of their frames give, one hour later."""
    frames = _headers(spark, sf).withColumns({"black": F.nullif(F.col("p_size") % 5, F.lit(0)), "exposure": F.when(F.col("p_partkey") % 2 == 0, F.log2(F.lit(0.06 * 4095) / (F.col("p_size") + 1)))})
    t = fits.dng_tags(frames, seconds=F.lit(3600), zone="+02:00", keys=("p_partkey",))
    of = lambda name, i=0: F.max(F.when(F.col("name") == name, F.get("value", F.lit(i))))
    wide = t.groupBy("p_partkey").agg(
        of("CFAPattern").alias("pattern"), of("UniqueCameraModel").alias("model"), of("ISOSpeedRatings").cast("long").alias("iso"), F.round(of("AnalogBalance").cast("double"), 6).alias("red"), F.round(of("AnalogBalance", 2).cast("double"), 6).alias("blue"),
        of("ExposureTime").cast("double").alias("seconds"), of("DateTimeOriginal").alias("taken"), of("BlackLevel").cast("long").alias("black"), of("WhiteLevel").cast("long").alias("white"), F.round(of("BaselineExposure").cast("double"), 6).alias("exposure"), of("OffsetTime").alias("zone"),
    )
    return wide


ORACLE_SQL["fits_tags"] = ORACLE_SQL["fits_tags"].format(knots=_knots("wb_blue", fits.BLUE_TABLE), gains=_knots("gain", fits.GAIN_TABLE))


@add("header_dump", "WITH h AS (SELECT unnest(['TELESCOP', 'CREATOR', 'CDELT2', 'BAYERPAT']) AS name, unnest([CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' ' END, CASE WHEN p_partkey % 7 > 0 THEN p_type END, CASE WHEN p_partkey % 2 = 1 THEN '0.0025' END, CASE WHEN p_partkey % 2 = 1 THEN 'rggb' END]) AS value FROM part) SELECT name, count(*) AS n, min(value) AS low, max(value) AS high FROM h WHERE value IS NOT NULL GROUP BY name")
def header_dump(spark, sf):
    h = _headers(spark, sf).select(F.explode("header").alias("name", "value")).where(F.col("name").isin("TELESCOP", "CREATOR", "CDELT2", "BAYERPAT"))
    return h.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@add("fits_gate", "WITH g AS (SELECT p_partkey, [8, 16, 32, -32, -64, 64][CAST(p_size % 6 + 1 AS INTEGER)] AS bitpix, [0, 2, 3, 2, 1, 2, 2][CAST(p_partkey % 7 + 1 AS INTEGER)] AS naxis, [0e0, 32768e0, 2147483648e0][CAST(p_partkey % 3 + 1 AS INTEGER)] AS bzero FROM part) SELECT p_partkey, bitpix, CASE WHEN naxis = 0 THEN 'skipped: no data' WHEN NOT (bitpix < 0 OR bitpix = 8 AND bzero = 0 OR bitpix = 16 AND bzero = pow(2, 15) OR bitpix = 32 AND bzero = pow(2, 31)) THEN 'error: pixel type' WHEN naxis <> 2 THEN 'skipped: not two axes' ELSE 'ok' END AS status FROM g")
def fits_gate(spark, sf):
    pick = lambda values, at: F.get(F.lit(values), at.cast("int"))
    key = F.col("p_partkey")
    g = views.table(spark, sf, "part").select("p_partkey", pick([8, 16, 32, -32, -64, 64], F.col("p_size") % 6).alias("bitpix"), pick([0, 2, 3, 2, 1, 2, 2], key % 7).alias("naxis"), pick([0.0, 32768.0, 2147483648.0], key % 3).alias("bzero"))
    return g.select("p_partkey", "bitpix", fits.gate(F.col("bitpix"), F.col("naxis"), F.col("bzero")).alias("status"))


@add("compression_gate", "WITH g AS (SELECT p_partkey, ['uint8', 'uint16', 'uint32', 'float32', 'float16'][CAST(p_size % 5 + 1 AS INTEGER)] AS dtype FROM part) SELECT p_partkey, dtype, CASE WHEN dtype IN ('uint8', 'uint16') THEN 'jxl' ELSE 'none' END AS codec FROM g")
def compression_gate(spark, sf):
    g = views.table(spark, sf, "part").select("p_partkey", F.get(F.lit(["uint8", "uint16", "uint32", "float32", "float16"]), (F.col("p_size") % 5).cast("int")).alias("dtype"))
    return g.select("p_partkey", "dtype", fits.compression(F.col("dtype"), F.lit("jxl")).alias("codec"))
