"""Queries of file jobs: mixtures of files, FITS to DNG, opcodes, copies, XMP packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom import sql_render
from sparkroom.queries_statistics import _FRAMES, _frames
from sparkroom.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _ids(spark, sf) -> DataFrame:
    return _frames(spark, sf).select("image_id").distinct()


def _cell(code: int, dtype: int, *values: Column | float, text: Column | None = None, place: str = "ifd") -> Column:
    numbers = F.array(*[v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in values])
    return F.struct(F.lit(place).alias("place"), F.lit(code).alias("code"), F.lit(dtype).alias("dtype"), (F.lit(None).cast("array<double>") if text is not None else numbers).alias("value"), (text if text is not None else F.lit(None)).cast("string").alias("text"))


def _tags(ids: DataFrame, *cells: Column) -> DataFrame:
    """Tag rows of each image; cells that are null give none."""
    some = F.filter(F.array(*cells), lambda c: c.isNotNull())
    return ids.select("image_id", F.lit(0).alias("page"), F.explode(some).alias("t")).select("image_id", "page", "t.*")


#: Patterns as the codes of their colours, by the number of an image.
PATTERNS = ("RGGB", "GRBG", "GBRG", "BGGR")


def _mixed(spark, sf) -> DataFrame:
    """Mosaic files in two folders with equal names, each with black levels, pattern,
    exposure, orientation and crop of its own; of ten, one is cut short and one compressed."""
    from sparkroom.plans import convert
    from sparkroom.sources import tiff

    k = F.col("image_id")
    pattern = F.get(F.lit(list(PATTERNS)), (k % 4).cast("int"))
    letters = F.transform(F.split(pattern, ""), lambda c: F.when(c == "R", 0.0).when(c == "G", 1.0).otherwise(2.0))
    struct = lambda code, dtype, value: F.struct(F.lit("ifd").alias("place"), F.lit(code).alias("code"), F.lit(dtype).alias("dtype"), value.alias("value"), F.lit(None).cast("string").alias("text"))
    tags = _tags(
        _ids(spark, sf),
        struct(convert.CFA_PATTERN, 1, F.slice(letters, 1, 4)),
        _cell(convert.BLACK_DIM, 3, 2, 2),
        _cell(convert.BLACK, 3, k % 64, k % 64 + 3, k % 64 + 5, k % 64 + 1),
        _cell(convert.WHITE, 4, F.lit(900) + k % 100),
        _cell(convert.EXPOSURE, 10, k % 5 / 2.0 - 1.0),
        _cell(convert.ORIENTATION, 3, k % 8 + 1),
        F.when(k % 3 == 0, _cell(convert.CROP_AT, 4, 7, 1)),
        F.when(k % 3 == 0, _cell(convert.CROP_SIZE, 4, 60, 8)),
        F.when(k % 10 == 8, _cell(tiff.COMPRESSION, 3, 7)),
    )
    made = tiff.encode_pages([tiff.PageRows(_frames(spark, sf), tags={tiff.PHOTOMETRIC: (3, (tiff.CFA,))})], tags=tags)
    folder = F.when(k % 2 == 0, "a").otherwise("b")
    path = F.concat(F.lit("/in/"), folder, F.lit("/"), F.expr("image_id div 2").cast("string"), F.lit(".dng"))
    return made.select(path.alias("path"), F.when(k % 10 == 7, F.substring("content", 1, F.octet_length("content") - 500)).otherwise(F.col("content")).alias("content"))


_TURN = "CASE image_id % 8 + 1 WHEN 1 THEN {0} WHEN 2 THEN {1} WHEN 3 THEN {2} WHEN 4 THEN {3} WHEN 5 THEN {4} WHEN 6 THEN {5} WHEN 7 THEN {6} ELSE {7} END"


@add("mixed_files", f"""WITH {_FRAMES},
lin AS (SELECT image_id, y, x, ['RGGB', 'GRBG', 'GBRG', 'BGGR'][CAST(image_id % 4 + 1 AS INTEGER)] AS pattern, least(greatest((v - b) / (900e0 + image_id % 100 - b), 0e0), 1e0) AS v
  FROM (SELECT *, image_id % 64 + CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 0 ELSE 3 END ELSE CASE WHEN x % 2 = 0 THEN 5 ELSE 1 END END AS b FROM f) WHERE image_id % 10 NOT IN (7, 8)),
{sql_render.mosaic("lin", "image_id", "pattern")},
box AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 7 ELSE 0 END AS bx, CASE WHEN image_id % 3 = 0 THEN 1 ELSE 0 END AS bt, CASE WHEN image_id % 3 = 0 THEN 60 ELSE 100 END AS bw, CASE WHEN image_id % 3 = 0 THEN 8 ELSE h END AS bh FROM (SELECT image_id, max(y) + 1 AS h FROM f GROUP BY image_id)),
{sql_render.look("rgb", "image_id, y, x", "(image_id % 5 / 2e0 - 1)")},
placed AS (SELECT image_id, r, g, b, y - bt AS y, x - bx AS x, bw - 1 AS w, bh - 1 AS h FROM shown JOIN box USING (image_id) WHERE y >= bt AND y < bt + bh AND x >= bx AND x < bx + bw),
turned AS (SELECT image_id, r, g, b, {_TURN.format('y', 'y', 'h - y', 'h - y', 'x', 'x', 'w - x', 'w - x')} AS y, {_TURN.format('x', 'w - x', 'w - x', 'x', 'y', 'h - y', 'h - y', 'y')} AS x FROM placed),
sums AS (SELECT image_id, count(*) * 3 AS n, CAST(sum(floor(r * 255 + 0.5e0) + floor(g * 255 + 0.5e0) + floor(b * 255 + 0.5e0)) AS BIGINT) AS total, CAST(sum(floor(r * 255 + 0.5e0) * (y * 100 + x + 1)) AS BIGINT) AS weighted FROM turned GROUP BY image_id)
SELECT CASE WHEN image_id % 2 = 0 THEN 'a' ELSE 'b' END || '/' || (image_id // 2) || '.tif' AS name, CASE WHEN image_id % 10 IN (7, 8) THEN 'errored' ELSE 'written' END AS status,
  CASE image_id % 10 WHEN 7 THEN 'block 0 of the pixels ends early' WHEN 8 THEN 'compressed pages need a codec that is not here' END AS error, n, total, weighted
FROM (SELECT DISTINCT image_id FROM f) LEFT JOIN sums USING (image_id)""")
def mixed_files(spark, sf):
    """Such files rendered in one plan into a folder of 8-bit files: each file's status and
    error, and what its output holds."""
    from sparkroom.plans import convert
    from sparkroom.sources import files, tiff

    folder, status = files.scratch_path(spark, "mixed"), files.scratch_path(spark, "mixed-status")
    convert.convert(_mixed(spark, sf), folder, root="/in").write.parquet(status)
    name = F.regexp_extract("path", r"([ab]/\d+)\.[a-z]+$", 1)
    back = tiff.pixels_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"))
    red = F.when(F.col("c") == 0, F.col("v") * (F.col("y") * 100 + F.col("x") + 1))
    sums = back.groupBy(name.alias("stem")).agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum(red).cast("long").alias("weighted"))
    done = spark.read.parquet(status).select(name.alias("stem"), "status", "error").join(sums, "stem", "left")
    return done.select(F.concat("stem", F.lit(".tif")).alias("name"), "status", "error", "n", "total", "weighted")


def _fits_files(spark, sf) -> DataFrame:
    """The frames as FITS files whose headers differ; of ten, one is no FITS file, one has
    a third axis."""
    k = F.col("image_id")
    pick = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    entries = F.array(
        pick(k % 2 == 0, "BAYERPAT", F.lit("grbg")),
        pick(F.lit(True), "INSTRUME", F.when(k % 3 < 2, F.lit("ZWO ASI676MC")).otherwise(F.lit("other"))),
        pick(F.lit(True), "GAIN", k % 220 + 0.5),
        pick(k % 4 == 1, "PEDESTAL", k % 50),
        pick(F.lit(True), "CWHITE", F.lit(1023)),
        pick(k % 5 < 4, "EXPTIME", (k % 8 + 1) / 8.0),
        pick(F.lit(True), "DATE-OBS", F.concat(F.lit("2024-02-28T23:59:"), F.lpad((k % 60).cast("string"), 2, "0"))),
        pick(F.lit(True), "OBJECT", F.concat(F.lit("M"), k.cast("string"))),
        pick(k % 10 == 3, "NAXIS", F.lit("3")),
    )
    path = F.concat(F.lit("/sky/"), k.cast("string"), F.lit(".fits"))
    heads = _ids(spark, sf).select("image_id", path.alias("path"), F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("header"))
    from sparkroom.sources import fits

    made = fits.encode_frames(_frames(spark, sf), heads)
    broken = F.regexp_extract("path", r"(\d+)\.fits$", 1).cast("long") % 10 == 6
    return made.select("path", F.when(broken, F.substring("content", 1, F.lit(300))).otherwise(F.col("content")).alias("content"))


@add("fits_to_dng", f"""WITH {_FRAMES}, cdf AS (SELECT image_id, bin, sum(n) OVER (PARTITION BY image_id ORDER BY bin) / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS cdf FROM (SELECT image_id, least(v, 1022) AS bin, count(*) AS n FROM f GROUP BY ALL)),
e AS (SELECT image_id, min(bin) FILTER (WHERE cdf >= 0.01e0) AS p1, min(bin) FILTER (WHERE cdf >= 0.5e0) AS median, 1 - coalesce(max(cdf) FILTER (WHERE bin * 1023e0 / 1023 < 0.975e0 * 1023), 0) > 0.25e0 AS clipped FROM cdf GROUP BY image_id),
s AS (SELECT image_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 100 + x + 1)) AS BIGINT) AS weighted FROM f GROUP BY image_id),
k AS (SELECT *, image_id % 10 IN (3, 6) AS bad, image_id % 220 + 0.5e0 AS gain FROM s JOIN e USING (image_id))
SELECT image_id, CASE image_id % 10 WHEN 6 THEN 'errored' WHEN 3 THEN 'skipped' ELSE 'written' END AS status,
  CASE WHEN NOT bad THEN n END AS n, CASE WHEN NOT bad THEN total END AS total, CASE WHEN NOT bad THEN weighted END AS weighted,
  CASE WHEN NOT bad THEN CASE WHEN image_id % 2 = 0 THEN 32803 ELSE 34892 END END AS kind, CASE WHEN NOT bad AND image_id % 2 = 0 THEN '1,0,2,1' END AS pattern,
  CASE WHEN NOT bad THEN CASE WHEN image_id % 3 < 2 THEN 'ZWO ASI676MC' ELSE 'other' END END AS model,
  CASE WHEN NOT bad THEN CAST(CASE WHEN image_id % 3 < 2 THEN floor(100 * 2.55e0 / CASE WHEN gain < 50 THEN 2.55e0 + (gain - 0) * ((1.5e0 - 2.55e0) / 50) WHEN gain < 100 THEN 1.5e0 + (gain - 50) * ((0.85e0 - 1.5e0) / 50) WHEN gain < 150 THEN 0.85e0 + (gain - 100) * ((0.5e0 - 0.85e0) / 50) WHEN gain < 200 THEN 0.5e0 + (gain - 150) * ((0.3e0 - 0.5e0) / 50) ELSE 0.3e0 END) ELSE floor(gain) END AS BIGINT) END AS iso,
  CASE WHEN NOT bad THEN CAST(CASE WHEN image_id % 4 = 1 THEN image_id % 50 ELSE nullif(p1, 0) END AS BIGINT) END AS black, CASE WHEN NOT bad THEN CAST(1023 AS BIGINT) END AS white,
  CASE WHEN NOT bad AND image_id % 5 < 4 THEN (image_id % 8 + 1) / 8e0 END AS seconds,
  CASE WHEN NOT bad THEN strftime(TIMESTAMP '2024-02-28 23:59:00' + to_seconds(image_id % 60 + 60), '%Y:%m:%d %H:%M:%S') END AS taken, CASE WHEN NOT bad THEN '+02:00' END AS zone,
  CASE WHEN NOT bad THEN round(CASE WHEN NOT clipped AND median > 0 THEN log2(0.06e0 * 1023 / median) END, 5) END AS exposure, CASE WHEN NOT bad THEN 'M' || image_id END AS subject
FROM k""")
def fits_to_dng(spark, sf):
    """FITS files in, DNG files out, each with its own tags, EXIF directory and XMP packet,
    which are then read; a minute is added to the time of capture."""
    from sparkroom.operators import tags as registry
    from sparkroom.plans import frames
    from sparkroom.sources import files, tiff

    folder, status = files.scratch_path(spark, "dng"), files.scratch_path(spark, "dng-status")
    frames.convert_frames(_fits_files(spark, sf), folder, seconds=F.lit(60), zone="+02:00").write.parquet(status)
    back = spark.read.format("binaryFile").load(folder).select("path", "content")
    key = F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("image_id")
    sums = tiff.pixels_of(back).groupBy(key).agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("y") * 100 + F.col("x") + 1)).cast("long").alias("weighted"))
    exif = {"ISOSpeedRatings", "ExposureTime", "DateTimeOriginal", "OffsetTime"}
    code = {n: (c, "exif" if n in exif else "ifd") for n, c, *_ in registry.REGISTRY}
    at = lambda name, c: F.max(F.when((F.col("code") == code[name][0]) & (F.col("place") == code[name][1]), c))
    one = lambda name: at(name, F.get("value", F.lit(0)))
    packet = at("XMP", F.decode("raw", "UTF-8"))
    letters = at("CFAPattern", F.array_join(F.transform("value", lambda v: v.cast("int")).cast("array<string>"), ","))
    told = tiff.tags_of(back).groupBy(key).agg(
        one("PhotometricInterpretation").cast("int").alias("kind"), letters.alias("pattern"), at("UniqueCameraModel", F.col("text")).alias("model"), one("ISOSpeedRatings").cast("long").alias("iso"), one("BlackLevel").cast("long").alias("black"), one("WhiteLevel").cast("long").alias("white"),
        one("ExposureTime").alias("seconds"), at("DateTimeOriginal", F.col("text")).alias("taken"), at("OffsetTime", F.col("text")).alias("zone"), F.round(one("BaselineExposure"), 5).alias("exposure"), F.get(F.try_element_at(registry.xmp_lists(packet), F.lit("avm:Subject.Name")), F.lit(0)).alias("subject"),
    )
    return spark.read.parquet(status).select(key, "status").join(sums, "image_id", "left").join(told, "image_id", "left")


@add("opcode_files", f"""WITH {_FRAMES}, lin AS (SELECT image_id, y, x, least(greatest(v / 1023e0, 0e0), 1e0) AS v, image_id % 4 AS q, (SELECT max(y) + 1 FROM f g WHERE g.image_id = f.image_id) AS h FROM f),
a AS (SELECT *, CASE WHEN q = 1 AND y >= 2 AND x >= 10 AND x < 90 AND (y - 2) % 2 = 0 AND (x - 10) % 3 = 0 THEN least(greatest(0.02e0 + v * (0.9e0 + image_id % 7 / 100e0), 0e0), 1e0)
   WHEN q = 2 THEN least(greatest(v * (1 + (0.1e0 + -0.05e0 * r2) * r2), 0e0), 1e0)
   WHEN q = 3 THEN least(greatest(v * ((1.0e0 * (1 - fx) + 1.5e0 * fx) * (1 - fy) + (0.5e0 * (1 - fx) + 2.0e0 * fx) * fy), 0e0), 1e0) ELSE v END AS o
 FROM (SELECT *, ((x - 49.5e0) * (x - 49.5e0) + (y - (h - 1) * 0.5e0) * (y - (h - 1) * 0.5e0)) / greatest(49.5e0 * 49.5e0 + (h - 1) * 0.5e0 * (h - 1) * 0.5e0, 1e-12) AS r2, least(greatest((y + 0.5e0) / h, 0e0), 1e0) AS fy, least(greatest((x + 0.5e0) / 100, 0e0), 1e0) AS fx FROM lin))
SELECT image_id, count(*) AS n, round(avg(o), 6) AS mean, round(sum(o * (y * 100 + x + 1)), 3) AS weighted FROM a GROUP BY image_id""")
def opcode_files(spark, sf):
    """Mosaics whose second opcode list differs by file: none, a polynomial over an area,
    radial gains, or a grid of gains; values after the opcodes."""
    from sparkroom.plans import convert
    from sparkroom.sources import opcode_lists, tiff

    ops = {
        1: lambda c: [{"id": opcode_lists.POLYNOMIAL, "area": [2, 10, 100_000, 90, 0, 1, 2, 3], "k": [0.02, 0.9 + c / 100]}],
        2: lambda c: [{"id": opcode_lists.VIGNETTE, "k": [0.1, -0.05, 0, 0, 0], "centre": [0.5, 0.5]}],
        3: lambda c: [{"id": opcode_lists.GAIN, "area": [0, 0, 100_000, 100_000, 0, 1, 1, 1], "grid": [2, 2, 1], "step": [1.0, 1.0], "start": [0.0, 0.0], "k": [1.0, 1.5, 0.5, 2.0]}],
    }
    k = F.col("image_id")
    blobs = F.map_from_entries(F.array(*[F.struct(F.lit(q * 7 + c).alias("key"), F.lit([float(b) for b in opcode_lists.build(ops[q](c))]).alias("value")) for q in ops for c in range(7)]))
    cell = F.struct(F.lit("ifd").alias("place"), F.lit(convert.OPCODES2).alias("code"), F.lit(7).alias("dtype"), F.try_element_at(blobs, (k % 4 * 7 + k % 7).cast("int")).alias("value"), F.lit(None).cast("string").alias("text"))
    tags = _tags(_ids(spark, sf), F.when(k % 4 > 0, cell))
    shared = {tiff.PHOTOMETRIC: (3, (tiff.CFA,)), convert.CFA_PATTERN: (1, (0, 1, 1, 2)), convert.WHITE: (3, (1023,))}
    made = tiff.encode_pages([tiff.PageRows(_frames(spark, sf), tags=shared)], tags=tags)
    px, _ = convert.mosaics(made.select(k.cast("string").alias("path"), "content"), "linearized-plus-ops")
    weight = F.col("v") * (F.col("y") * 100 + F.col("x") + 1)
    return px.groupBy(F.col("path").cast("long").alias("image_id")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.sum(weight), 3).alias("weighted"))


_LENS_AT = "least(greatest({c} + d{a} * (k + k2 * r2) + rad * ({t0} * (2 * ux * uy) * 1e0 + {t1} * (r2 + 2 * u{a} * u{a})), 0e0), {s} - 1)"


@add("lens_files", f"""WITH {_FRAMES}, h AS (SELECT image_id, max(y) + 1 AS h FROM f GROUP BY image_id), v AS (SELECT image_id, y, x, h, v / 1023e0 AS v FROM f JOIN h USING (image_id)),
c AS (SELECT *, unnest([0, 1, 2]) AS c FROM v),
p AS (SELECT *, 49.5e0 AS cx, (h - 1) * 0.5e0 AS cy, sqrt(49.5e0 * 49.5e0 + (h - 1) * 0.5e0 * (h - 1) * 0.5e0) AS rad, x - 49.5e0 AS dx, y - (h - 1) * 0.5e0 AS dy, 0.97e0 + CASE WHEN image_id % 4 = 2 THEN c / 100e0 ELSE 0e0 END AS k, 0.02e0 AS k2, 0.002e0 AS t0, 0.001e0 AS t1 FROM c WHERE image_id % 4 IN (1, 2)),
q AS (SELECT *, dx / rad AS ux, dy / rad AS uy, (dx * dx + dy * dy) / (rad * rad) AS r2 FROM p),
s AS (SELECT *, {_LENS_AT.format(c="cy", a="y", t0="t1", t1="t0", s="h")} AS sy, {_LENS_AT.format(c="cx", a="x", t0="t0", t1="t1", s="100")} AS sx FROM q),
i AS (SELECT *, CAST(greatest(least(floor(sy), h - 2), 0) AS BIGINT) AS iy, CAST(greatest(least(floor(sx), 98), 0) AS BIGINT) AS ix FROM s),
w AS (SELECT i.image_id, i.y, i.x, i.c, i.h, i.r2, sum(n.v * greatest(1 - abs(sy - iy - ey), 0) * greatest(1 - abs(sx - ix - ex), 0)) AS v FROM i, (SELECT unnest([0, 1]) AS ey), (SELECT unnest([0, 1]) AS ex), v n WHERE n.image_id = i.image_id AND n.y = least(iy + ey, i.h - 1) AND n.x = ix + ex GROUP BY ALL),
o AS (SELECT image_id, y, x, c, CASE WHEN image_id % 4 = 2 THEN least(v * (1 + 0.1e0 * r2), 1e0) ELSE v END AS v FROM w UNION ALL
  SELECT image_id, y, x, c, CASE WHEN image_id % 4 = 3 THEN least(0.05e0 + v * 0.9e0, 1e0) ELSE v END FROM c WHERE image_id % 4 IN (0, 3))
SELECT image_id, c, count(*) AS n, round(avg(v), 6) AS mean, round(sum(v * (y * 100 + x + 1)), 3) AS weighted FROM o GROUP BY image_id, c""")
def lens_files(spark, sf):
    """Linear files whose third opcode list differs: none, a lens warp, a warp with a set of
    coefficients for each channel and gains after it, or a polynomial."""
    from sparkroom.plans import convert
    from sparkroom.sources import opcode_lists, tiff

    own = lambda c: [0.97 + c / 100, 0.02, 0, 0, 0.002, 0.001]
    lists = [
        [{"id": opcode_lists.WARP, "grid": [1], "k": own(0), "centre": [0.5, 0.5]}],
        [{"id": opcode_lists.WARP, "grid": [3], "k": [v for c in range(3) for v in own(c)], "centre": [0.5, 0.5]}, {"id": opcode_lists.VIGNETTE, "k": [0.1, 0, 0, 0, 0], "centre": [0.5, 0.5]}],
        [{"id": opcode_lists.POLYNOMIAL, "area": [0, 0, 100_000, 100, 0, 3, 1, 1], "k": [0.05, 0.9]}],
    ]
    k = F.col("image_id")
    blobs = F.create_map(*[x for i, ops in enumerate(lists) for x in (F.lit(i + 1), F.lit([float(b) for b in opcode_lists.build(ops)]))])
    cell = F.struct(F.lit("ifd").alias("place"), F.lit(convert.OPCODES3).alias("code"), F.lit(7).alias("dtype"), F.try_element_at(blobs, (k % 4).cast("int")).alias("value"), F.lit(None).cast("string").alias("text"))
    tags = _tags(_ids(spark, sf), F.when(k % 4 > 0, cell))
    made = tiff.encode_pages([tiff.PageRows(_frames(spark, sf), tags={tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,)), convert.WHITE: (3, (1023,))})], tags=tags)
    px, _ = convert.camera_images(made.select(k.cast("string").alias("path"), "content"))
    cells = px.select(F.col("path").cast("long").alias("image_id"), "y", "x", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))
    weight = F.col("v") * (F.col("y") * 100 + F.col("x") + 1)
    return cells.groupBy("image_id", "c").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.sum(weight), 3).alias("weighted"))


@add("tiff_source", f"""WITH {_FRAMES} SELECT image_id, CAST(0 AS INTEGER) AS ifd, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 100 + x + 1)) AS BIGINT) AS weighted FROM f GROUP BY image_id""")
def tiff_source(spark, sf):
    """The frames as files, written by the data source in two phases and read by it in
    ranges of a few kilobytes."""
    from sparkroom.sources import files, tiff
    from sparkroom.sources import tiff_source as source

    source.register(spark)
    folder = files.scratch_path(spark, "tiff")
    made = tiff.encode_pages([tiff.PageRows(_frames(spark, sf), tags={tiff.PHOTOMETRIC: (3, (tiff.GRAY,))})])
    made.select(F.concat(F.col("image_id") % 3, F.lit("/"), F.col("image_id"), F.lit(".tif")).alias("name"), "content").write.format("tiff").mode("append").save(folder)
    back = spark.read.format("tiff").option("splitBytes", 1 << 14).load(folder)
    key = F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("image_id")
    return back.groupBy(key, "ifd").agg(F.count("a").alias("n"), F.sum("a").cast("long").alias("total"), F.sum(F.col("a") * (F.col("y") * 100 + F.col("x") + 1)).cast("long").alias("weighted"))


@add("arriving_files", f"""WITH {_FRAMES}, k AS (SELECT image_id, max(y) + 1 AS h FROM f GROUP BY image_id)
SELECT CASE WHEN image_id % 2 = 0 THEN 'a' ELSE 'b' END || '/' || (image_id // 2) || '.dng.tif' AS name, CASE WHEN image_id % 10 IN (7, 8) THEN 'errored' ELSE 'written' END AS status, CAST(image_id % 2 AS INTEGER) AS batch, CAST(1 AS BIGINT) AS times,
  CASE WHEN image_id % 10 NOT IN (7, 8) THEN CASE WHEN image_id % 3 = 0 THEN 60 * 8 ELSE 100 * h END END * 3 AS n FROM k""")
def arriving_files(spark, sf):
    """The files of ``mixed_files`` arrive folder by folder; the job runs after each and once
    more: the manifest's rows of each file, which run did it (in how many batches soever),
    and the samples of its output."""
    from sparkroom.plans import convert
    from sparkroom.sources import files, tiff
    from sparkroom.streaming import jobs

    source, folder, manifest, state = (files.scratch_path(spark, f"arriving-{w}") for w in ("in", "out", "manifest", "state"))
    made, ends = _mixed(spark, sf), []
    for part in ("a", "b", None):
        if part:
            some = made.where(F.col("path").startswith(f"/in/{part}/"))
            convert.write_files(some, source, some.select("path", F.substring("path", 5, 1000).alias("name"))).write.format("noop").mode("overwrite").save()
        jobs.convert_arriving(spark, source, folder, manifest, state).awaitTermination()
        ends.append(jobs.last_batch(spark, manifest))
    name = F.regexp_extract("path", r"([ab]/\d+\.dng)", 1).alias("stem")
    kept = jobs.manifest_of(spark, manifest).groupBy(name).agg(F.max("status").alias("status"), F.max(jobs.arrival(ends)).alias("batch"), F.count("*").alias("times"))
    back = tiff.pixels_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")).groupBy(name).agg(F.count("*").alias("n"))
    return kept.join(back, "stem", "left").select(F.concat("stem", F.lit(".tif")).alias("name"), "status", "batch", "times", "n")


@add("copy_tags", f"""WITH {_FRAMES}, k AS (SELECT DISTINCT image_id FROM f), t AS (
  SELECT image_id, unnest([271, 272, 50728, 50730, 33434, 34855, 1]) AS code, unnest(['ifd', 'ifd', 'ifd', 'ifd', 'exif', 'exif', 'gps']) AS place,
    unnest(['maker', 'Copy ' || image_id, NULL, NULL, NULL, NULL, 'N']) AS text, unnest([NULL, NULL, 0.5e0 + image_id % 4 / 8e0, image_id % 5 / 4e0, (image_id % 6 + 1) / 64e0, image_id % 220, NULL]) AS first FROM k)
SELECT image_id, code, place, text, first FROM t WHERE NOT (code = 50730 AND image_id % 2 = 1)""")
def copy_tags(spark, sf):
    """Linear files copied with tags of the page, EXIF and GPS directories kept; one tag is
    dropped, one is laid over by an extra one."""
    from sparkroom.plans import convert
    from sparkroom.sources import tiff

    k = F.col("image_id")
    tags = _tags(
        _ids(spark, sf),
        _cell(271, 2, text=F.lit("maker")), _cell(272, 2, text=F.concat(F.lit("Body "), k.cast("string"))), _cell(305, 2, text=F.lit("dropped")), _cell(convert.NEUTRAL, 5, F.lit(0.5) + k % 4 / 8.0, 1, 0.75), _cell(convert.WHITE, 4, 1023),
        F.when(k % 2 == 0, _cell(convert.EXPOSURE, 10, k % 5 / 4.0)), _cell(33434, 5, (k % 6 + 1) / 64.0, place="exif"), _cell(34855, 3, k % 220, place="exif"), _cell(1, 2, text=F.lit("N"), place="gps"),
    )
    made = tiff.encode_pages([tiff.PageRows(_frames(spark, sf), tags={tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,))})], tags=tags)
    own = made.select(F.concat(F.lit("/in/"), k.cast("string"), F.lit(".dng")).alias("path"), "content")
    extra = own.select(F.col("path").alias("image_id"), F.lit(0).alias("page"), F.lit("ifd").alias("place"), F.lit(272).alias("code"), F.lit(2).alias("dtype"), F.lit(None).cast("array<double>").alias("value"), F.concat(F.lit("Copy "), F.regexp_extract("path", r"(\d+)\.dng$", 1)).alias("text"))
    copied = convert.copy_pages(own, preview=False, drop=(305,), extra=extra)
    t = tiff.tags_of(copied).where((F.col("place") != "ifd") | ~F.col("code").isin(*tiff.STRUCTURE))
    return t.select(F.regexp_extract("path", r"(\d+)\.dng$", 1).cast("long").alias("image_id"), "code", "place", "text", F.get("value", F.lit(0)).alias("first"))


@add("xmp_lists", """WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_size FROM part), t AS (
  SELECT k, unnest(['dc:title', 'dc:subject', 'dc:subject', 'crs:ToneCurve', 'crs:ToneCurve', 'crs:ToneCurve', 'xmp:Rating']) AS key, unnest([0, 0, 1, 0, 1, 2, 0]) AS i,
    unnest([p_name || ' & <more> "x"', p_brand, '', '0, 0', (p_size % 128) || ', ' || (p_size % 64 + 90), '255, 255', CAST(p_size % 6 AS VARCHAR)]) AS value FROM p)
SELECT k AS p_partkey, key, CAST(i AS INTEGER) AS i, value FROM t""")
def xmp_lists(spark, sf):
    """Dictionaries with single texts and lists, written as packets and read again; another
    writer's Bag, Alt and plain elements are added to the packets before."""
    from sparkroom.operators import tags as registry

    p = views.table(spark, sf, "part")
    size = F.col("p_size")
    values = F.create_map(
        F.lit("crs:ToneCurve"), F.array(F.lit("0, 0"), F.concat_ws(", ", size % 128, size % 64 + 90), F.lit("255, 255")),
        F.lit("dc:title"), F.array(F.concat(F.col("p_name"), F.lit(' & <more> "x"'))),
    )
    bag = F.concat(F.lit("<dc:subject><rdf:Bag><rdf:li>"), F.col("p_brand"), F.lit('</rdf:li>\n<rdf:li xml:lang="x"></rdf:li></rdf:Bag></dc:subject><xmp:Rating>\n '), (size % 6).cast("string"), F.lit("</xmp:Rating></rdf:Description>"))
    packet = F.replace(registry.xmp_document(values), F.lit("</rdf:Description>"), bag)
    read = p.select("p_partkey", F.explode(registry.xmp_lists(packet)).alias("key", "values"))
    return read.select("p_partkey", "key", F.posexplode("values").alias("i", "value"))


@add("avm_wcs", """WITH h AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_partkey % 360 + 0.5e0 AS ra, p_partkey % 170 - 84.5e0 AS dec, p_size * 1e0 AS px, p_size + 3e0 AS py, (p_size % 9 + 1) / 3600e0 AS s, radians(p_partkey % 90 + 0.0e0) AS t FROM part),
c AS (SELECT k, kind, ra, dec, px, py, -s * cos(t) AS a, CASE WHEN kind < 2 THEN s * sin(t) ELSE -s * sin(t) END AS b, CASE WHEN kind = 0 THEN s * sin(t) WHEN kind = 1 THEN s * sin(t) ELSE -s * sin(t) END AS c, s * cos(t) AS d FROM h),
q AS (SELECT *, radians(a * (10 - px) + b * (20 - py)) AS xi, radians(c * (10 - px) + d * (20 - py)) AS eta, cos(radians(dec)) AS cd, sin(radians(dec)) AS sd FROM c)
SELECT k AS p_partkey, CASE WHEN kind < 3 THEN ra END AS ra, CASE WHEN kind < 3 THEN dec END AS dec, round(CASE WHEN kind < 3 THEN -sqrt(a * a + c * c) END, 9) AS across, round(CASE WHEN kind < 3 THEN sqrt(b * b + d * d) END, 9) AS up,
  round(CASE WHEN kind < 3 THEN degrees(atan2(b, d)) END, 6) + 0e0 AS rotation,
  round(CASE WHEN kind < 3 THEN (ra + degrees(atan2(xi, cd - eta * sd)) + 360) % 360 END, 7) AS sky_ra, round(CASE WHEN kind < 3 THEN degrees(atan2(sd + eta * cd, sqrt(xi * xi + (cd - eta * sd) * (cd - eta * sd)))) END, 7) AS sky_dec FROM q""")
def avm_wcs(spark, sf):
    """Headers with world coordinates by a CD matrix, by PC and CDELT, and by CDELT and
    CROTA2 (and some with axes of another kind): fields of AVM, and a pixel's place."""
    from sparkroom.operators import fits as rules

    p = views.table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = key % 4
    s, t = (size % 9 + 1) / 3600.0, F.radians((key % 90).cast("double"))
    cos, sin = F.cos(t), F.sin(t)
    pick = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    cd, pc, old = kind == 0, kind == 1, kind == 2
    entries = F.array(
        pick(F.lit(True), "CTYPE1", F.when(kind == 3, F.lit("GLON-TAN")).otherwise(F.lit("RA---TAN"))), pick(F.lit(True), "CTYPE2", F.when(kind == 3, F.lit("GLAT-TAN")).otherwise(F.lit("DEC--TAN"))),
        pick(F.lit(True), "CRVAL1", key % 360 + 0.5), pick(F.lit(True), "CRVAL2", key % 170 - 84.5), pick(F.lit(True), "CRPIX1", size * 1.0), pick(F.lit(True), "CRPIX2", size + 3.0),
        pick(cd, "CD1_1", -s * cos), pick(cd, "CD1_2", s * sin), pick(cd, "CD2_1", s * sin), pick(cd, "CD2_2", s * cos),
        pick(pc, "PC1_1", cos), pick(pc, "PC1_2", -sin), pick(pc, "PC2_1", sin), pick(pc, "PC2_2", cos), pick(pc | old, "CDELT1", -s), pick(pc | old, "CDELT2", s), pick(old, "CROTA2", key % 90),
    )
    h = p.select("p_partkey", F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("header"))
    made = h.select("p_partkey", rules.avm(F.col("header")).alias("m"), rules.wcs(F.col("header")).alias("w")).withColumn("sky", F.when(F.col("w").isNotNull(), rules.sky_of_pixel(F.col("w"), F.lit(10.0), F.lit(20.0))))
    number = lambda k, i: F.get(F.try_element_at("m", F.lit(k)), F.lit(i)).cast("double")
    return made.select("p_partkey", number("Spatial.ReferenceValue", 0).alias("ra"), number("Spatial.ReferenceValue", 1).alias("dec"), F.round(F.when(F.col("w").isNotNull(), number("Spatial.Scale", 0)), 9).alias("across"), F.round(F.when(F.col("w").isNotNull(), number("Spatial.Scale", 1)), 9).alias("up"), (F.round(number("Spatial.Rotation", 0), 6) + 0.0).alias("rotation"), F.round("sky.ra", 7).alias("sky_ra"), F.round("sky.dec", 7).alias("sky_dec"))


@add("cct_both_ways", "SELECT p_partkey, 2000e0 + p_partkey % 13001 AS kelvin, CAST(p_size % 161 - 80 AS DOUBLE) AS tint, true AS near FROM part")
def cct_both_ways(spark, sf):
    """Temperature and tint of each row to a point and back, to 0.2 K and 0.002, on columns."""
    from sparkroom.functions import colour_columns

    k = views.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 13001 + 2000.0).alias("kelvin"), (F.col("p_size") % 161 - 80).cast("double").alias("tint"))
    there = k.withColumn("uv", colour_columns.uv_of_temperature("kelvin", "tint")).select("*", "uv.u", "uv.v")
    back = there.withColumn("t", colour_columns.temperature_of_uv("u", "v"))
    near = (F.abs(F.col("t.kelvin") - F.col("kelvin")) <= 0.2) & (F.abs(F.col("t.tint") - F.col("tint")) <= 0.002)
    return back.select("p_partkey", "kelvin", "tint", near.alias("near"))


_M = [f"(CAST(embedding[{i + 1}] AS DOUBLE) + {2 if i % 4 == 0 else 0})" for i in range(9)]
_COFACTOR = lambda i, j: "(m[{0}] * m[{1}] - m[{2}] * m[{3}])".format(*[3 * (r % 3) + c % 3 + 1 for r, c in ((i + 1, j + 1), (i + 2, j + 2), (i + 1, j + 2), (i + 2, j + 1))])


@add("matrix_columns", f"""WITH t AS (SELECT vec_id, [{', '.join(_M)}] AS m FROM embeddings), d AS (SELECT *, m[1] * {_COFACTOR(0, 0)} + m[2] * {_COFACTOR(0, 1)} + m[3] * {_COFACTOR(0, 2)} AS det FROM t),
i AS (SELECT vec_id, m, [{', '.join(_COFACTOR(j, i) for i in range(3) for j in range(3))}] AS a, det FROM d)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, round(a[k] / det, 6) AS inverse, round((m[(k - 1) // 3 * 3 + 1] * m[(k - 1) % 3 + 1] + m[(k - 1) // 3 * 3 + 2] * m[(k - 1) % 3 + 4] + m[(k - 1) // 3 * 3 + 3] * m[(k - 1) % 3 + 7]), 6) AS square, (k - 1) % 4 = 0 AS one FROM i, (SELECT unnest(range(1, 10)) AS k)""")
def matrix_columns(spark, sf):
    """Inverse and square of a matrix of each row, and whether inverse times matrix is 1."""
    from sparkroom.functions import colour_columns

    m = F.array(*[F.get("embedding", F.lit(i)).cast("double") + (2.0 if i % 4 == 0 else 0.0) for i in range(9)])
    t = views.table(spark, sf, "embeddings").select("vec_id", m.alias("m")).withColumn("i", colour_columns.inverse("m"))
    made = t.withColumns({"s": colour_columns.product("m", "m"), "e": colour_columns.product("i", "m")})
    cells = made.select("vec_id", F.posexplode(F.arrays_zip("i", "s", "e")).alias("k", "c"))
    return cells.select("vec_id", "k", F.round("c.i", 6).alias("inverse"), F.round("c.s", 6).alias("square"), (F.abs(F.col("c.e") - 1.0) < 1e-9).alias("one"))


@add("header_dump_files", f"""WITH {_FRAMES}, k AS (SELECT image_id AS k, max(y) + 1 AS h FROM f WHERE image_id % 10 NOT IN (3, 6) GROUP BY image_id),
c AS (SELECT unnest(['SIMPLE', 'BITPIX', 'NAXIS', 'NAXIS1', 'NAXIS2', 'BZERO', 'BAYERPAT', 'INSTRUME', 'GAIN', 'PEDESTAL', 'CWHITE', 'EXPTIME', 'DATE-OBS', 'OBJECT']) AS name,
  unnest(['T', NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'grbg' END, CASE WHEN k % 3 < 2 THEN 'ZWO ASI676MC' ELSE 'other' END, NULL, NULL, NULL, NULL, '2024-02-28T23:59:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0'), 'M' || k]) AS t,
  unnest([NULL, 16e0, 2e0, 100e0, h, 32768e0, NULL, NULL, k % 220 + 0.5e0, CASE WHEN k % 4 = 1 THEN k % 50 END, 1023e0, CASE WHEN k % 5 < 4 THEN (k % 8 + 1) / 8e0 END, NULL, NULL]) AS v FROM k)
SELECT CAST(0 AS INTEGER) AS hdu, name, count(*) AS n, coalesce(min(t), CAST(min(v) AS VARCHAR)) AS low, coalesce(max(t), CAST(max(v) AS VARCHAR)) AS high FROM c WHERE t IS NOT NULL OR v IS NOT NULL GROUP BY name""")
def header_dump_files(spark, sf):
    """Every keyword of every unit of the FITS files that can be read."""
    from sparkroom.operators import fits as rules
    from sparkroom.sources import fits

    return rules.dump(fits.headers_of(_fits_files(spark, sf)))
