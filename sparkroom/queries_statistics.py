"""Queries of statistics and batch accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkroom import sql_render
from sparkroom.operators import batch, statistics
from sparkroom.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict = {}

WHITE = 100_000.0
BINS = statistics.bins_for(WHITE)
HIST = "s AS (SELECT l_suppkey AS image_id, floor(l_extendedprice) AS v FROM lineitem), hist AS (SELECT image_id, CAST(least(floor(v / 1e5 * 10000), 9999) AS INTEGER) AS bin, count(*) AS n FROM s WHERE v >= 0 AND v <= 1e5 GROUP BY ALL)"
CDF = f"{HIST}, cdf AS (SELECT *, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS BIGINT) AS cum, sum(n) OVER (PARTITION BY image_id ORDER BY bin) / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS cdf FROM hist)"
EXPOSURE = f"{CDF}, e AS (SELECT image_id, CAST(floor(min(bin) FILTER (WHERE cdf >= 0.01e0) * 10e0) AS BIGINT) AS p1, CAST(floor(min(bin) FILTER (WHERE cdf >= 0.5e0) * 10e0) AS BIGINT) AS median, 1 - coalesce(max(cdf) FILTER (WHERE bin < 9750), 0) > 0.25e0 AS clipped FROM cdf GROUP BY image_id)"


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _hist(spark, sf):
    return statistics.histogram(views.sensors(spark, sf), WHITE)


@add("histogram", f"WITH {HIST} SELECT * FROM hist")
def histogram(spark, sf):
    return _hist(spark, sf)


@add("hist_cdf", f"WITH {CDF} SELECT image_id, bin, n, cum, round(cdf, 6) AS cdf FROM cdf")
def hist_cdf(spark, sf):
    return statistics.cdf(_hist(spark, sf)).withColumn("cdf", F.round("cdf", 6))


@add("hist_percentile", f"WITH {CDF} SELECT image_id, p, CAST(floor(min(bin) FILTER (WHERE cdf >= p) * 10e0) AS BIGINT) AS value FROM cdf, (SELECT unnest([0.01e0, 0.5e0, 0.99e0]) AS p) GROUP BY ALL")
def hist_percentile(spark, sf):
    return statistics.percentiles(statistics.cdf(_hist(spark, sf)), (0.01, 0.5, 0.99), WHITE, BINS)


@add("clipped", f"WITH {EXPOSURE} SELECT image_id, clipped FROM e")
def clipped(spark, sf):
    return statistics.clipped(statistics.cdf(_hist(spark, sf)), WHITE, BINS)


@add("auto_exposure", f"WITH {EXPOSURE} SELECT image_id, nullif(p1, 0) AS black, median, clipped, round(CASE WHEN NOT clipped AND median > 0 THEN log2(0.06e0 * 1e5 / median) END, 6) AS exposure FROM e")
def auto_exposure(spark, sf):
    return statistics.auto_exposure(_hist(spark, sf), WHITE, BINS).withColumn("exposure", F.round("exposure", 6))


#: The same with whole byte values, where the clipping level lies between two bins.
BYTES = "s AS (SELECT l_suppkey AS image_id, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS v FROM lineitem), hist AS (SELECT image_id, least(v, 254) AS bin, count(*) AS n FROM s GROUP BY ALL), cdf AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin) / CAST(sum(n) OVER (PARTITION BY image_id) AS DOUBLE) AS cdf FROM hist)"


def _bytes(spark, sf):
    return views.sensors(spark, sf).withColumn("v", F.col("v") % 256)


@add("clipped_bytes", f"WITH {BYTES}, edges AS (SELECT min(i) AS edge FROM (SELECT unnest(range(0, 256)) AS i) WHERE i * 255e0 / 255 >= 0.975e0 * 255) SELECT image_id, 1 - coalesce(max(cdf) FILTER (WHERE bin < edge), 0) > 0.02e0 AS bright FROM cdf, edges GROUP BY image_id")
def clipped_bytes(spark, sf):
    """Whether over a fiftieth of an image is at the clipping level of 255."""
    c = statistics.cdf(statistics.histogram(_bytes(spark, sf), 255.0))
    return c.groupBy("image_id").agg(statistics.brighter(255.0, 255, 0.02).alias("bright"))


@add("auto_black", f"WITH {BYTES}, e AS (SELECT image_id, CAST(min(bin) FILTER (WHERE cdf >= 0.01e0) AS BIGINT) AS p1, CAST(min(bin) FILTER (WHERE cdf >= 0.5e0) AS BIGINT) AS median FROM cdf GROUP BY image_id) SELECT image_id, CASE WHEN image_id % 3 = 0 THEN image_id % 50 WHEN p1 > 0 THEN p1 END AS black, median, round(CASE WHEN median > 0 THEN log2(0.06e0 * 255 / median) END, 6) AS exposure FROM e")
def auto_black(spark, sf):
    """Black levels where every third image's header brings a pedestal."""
    h = statistics.histogram(_bytes(spark, sf), 255.0).withColumn("pedestal", F.when(F.col("image_id") % 3 == 0, F.col("image_id") % 50))
    return statistics.auto_exposure(h, 255.0, 255, "pedestal").select("image_id", "black", "median", F.round("exposure", 6).alias("exposure"))


@add("diff_stats", "WITH p AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS v, k % 3 AS c FROM embeddings, (SELECT unnest(range(0, 64)) AS k)), d AS (SELECT CAST(c AS INTEGER) AS c, abs(v - round(v, 2)) * 100 AS d FROM p) SELECT c, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS top FROM d GROUP BY GROUPING SETS ((c), ())")
def diff_stats(spark, sf):
    p = views.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    a = p.select(F.col("vec_id").alias("image_id"), "k", (F.col("k") % 3).cast("int").alias("c"), F.col("e").cast("double").alias("v"))
    b = a.withColumn("v", F.round("v", 2))
    found = statistics.diff_stats(a, b, ("image_id", "k", "c"))
    return found.select("c", F.round("mean", 6).alias("mean"), F.round("p99", 6).alias("p99"), F.round("max", 6).alias("top"))


@add("min_max", "SELECT l_suppkey AS image_id, min(floor(l_extendedprice)) AS min_v, max(floor(l_extendedprice)) AS max_v FROM lineitem GROUP BY ALL")
def min_max(spark, sf):
    return statistics.min_max(views.sensors(spark, sf))


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'written' WHEN 'O' THEN 'skipped' ELSE 'errored' END"


def _results(spark, sf):
    s = F.col("o_orderstatus")
    return views.table(spark, sf, "orders").select(F.when(s == "F", "written").when(s == "O", "skipped").otherwise("errored").alias("status"))


@add("status_counts", f"SELECT {STATUS} AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf):
    return batch.status_counts(_results(spark, sf))


@add("job_summary", f"WITH s AS (SELECT {STATUS} AS status FROM orders) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'written') AS written, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'errored') AS errored FROM s")
def job_summary(spark, sf):
    return batch.summarize(_results(spark, sf))


@add("skip_existing", "SELECT o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def skip_existing(spark, sf):
    files = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"))
    there = views.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("name"))
    return batch.select_inputs(files, there)


@add("frame_sequence", "SELECT url, CAST(row_number() OVER (ORDER BY url, page_id) AS BIGINT) AS frame_no FROM pages")
def frame_sequence(spark, sf):
    """Frames in order of path. The order is made by ranges, and each range adds
    the size of those before it, so no task sees the whole sequence."""
    from sparkroom.operators.sequence import number_rows

    return number_rows(views.table(spark, sf, "pages").select("url", "page_id"), ["url", "page_id"], "frame_no", 1).select("url", "frame_no")


@add("size_ratio", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS ratio FROM lineitem GROUP BY ALL")
def size_ratio(spark, sf):
    items = views.table(spark, sf, "lineitem").withColumn("stored", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return statistics.size_ratio(items, "stored", "l_extendedprice", "l_returnflag").withColumn("ratio", F.round("ratio", 6))


def _frames(spark, sf):
    """events as one image for every ten rows of a hundred."""
    e = views.table(spark, sf, "events")
    row = F.expr("event_id div 100")
    v = F.floor(F.least(F.greatest(F.col("value") / 500.0, F.lit(0.0)), F.lit(1.0)) * 1023 + 0.5)
    return e.select(F.expr("event_id div 1000").alias("image_id"), (row % 10).alias("y"), (F.col("event_id") % 100).alias("x"), v.alias("v"))


_FRAMES = "f AS (SELECT event_id // 1000 AS image_id, event_id // 100 % 10 AS y, event_id % 100 AS x, CAST(floor(least(greatest(value / 5e2, 0e0), 1e0) * 1023 + 0.5e0) AS BIGINT) AS v FROM events)"


@add("tiff_roundtrip", f"WITH {_FRAMES} SELECT image_id, bits, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 100 + x + 1)) AS BIGINT) AS weighted FROM f, (SELECT unnest([10, 16]) AS bits) GROUP BY ALL")
def tiff_roundtrip(spark, sf):
    """Frames written as containers of 10 and 16 bits and read again."""
    from sparkroom.sources import tiff

    parts = []
    for bits in (10, 16):
        files = tiff.encode_images(_frames(spark, sf), bits if bits != 16 else None)
        got = tiff.pixels_of(files.select(F.col("image_id").cast("string").alias("path"), "content"))
        parts.append(got.groupBy(F.col("path").cast("long").alias("image_id"), F.lit(bits).alias("bits")).agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("y") * 100 + F.col("x") + 1)).cast("long").alias("weighted")))
    return parts[0].union(parts[1])


@add("tiff_tags", f"WITH {_FRAMES} SELECT image_id, max(CASE WHEN code = 256 THEN CAST(100 AS DOUBLE) END) AS width, max(CASE WHEN code = 257 THEN CAST(h AS DOUBLE) END) AS height, CAST(11 AS BIGINT) AS n_tags FROM (SELECT image_id, max(y) + 1 AS h FROM f GROUP BY image_id), (SELECT unnest([256, 257]) AS code) GROUP BY image_id")
def tiff_tags(spark, sf):
    """Tags of the frames' containers."""
    from sparkroom.sources import tiff

    t = tiff.tags_of(tiff.encode_images(_frames(spark, sf)).select(F.col("image_id").cast("string").alias("path"), "content"))
    of = lambda code: F.max(F.when(F.col("code") == code, F.element_at("value", 1)))
    return t.groupBy(F.col("path").cast("long").alias("image_id")).agg(of(256).alias("width"), of(257).alias("height"), F.count("*").alias("n_tags"))


@add("fits_roundtrip", f"WITH {_FRAMES} SELECT image_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM f GROUP BY image_id")
def fits_roundtrip(spark, sf):
    """Frames written as FITS files and read again."""
    from sparkroom.sources import fits

    px = _frames(spark, sf)
    heads = px.select("image_id").distinct().select("image_id", F.col("image_id").cast("string").alias("path"), F.create_map(F.lit("OBJECT"), F.lit("frame")).alias("header"))
    back = fits.pixels_of(fits.encode_frames(px, heads))
    return back.groupBy(F.col("path").cast("long").alias("image_id")).agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"))


_SHOWN = f"""{_FRAMES}, l AS (SELECT image_id, y, x, v / 1023e0 AS v FROM f),
nb AS (SELECT c.image_id, c.y, c.x, c.v, c.y % 2 * 2 + c.x % 2 AS p,
  avg(n.v) FILTER (WHERE abs(n.y - c.y) + abs(n.x - c.x) = 1) AS plus, avg(n.v) FILTER (WHERE n.y = c.y AND n.x <> c.x) AS hor,
  avg(n.v) FILTER (WHERE n.x = c.x AND n.y <> c.y) AS ver, avg(n.v) FILTER (WHERE n.y <> c.y AND n.x <> c.x) AS diag
  FROM l c JOIN (SELECT image_id, y + dy AS ky, x + dx AS kx, y, x, v FROM l, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) n ON n.image_id = c.image_id AND n.ky = c.y AND n.kx = c.x
  GROUP BY ALL),
rgb AS (SELECT image_id, y, x, CASE p WHEN 0 THEN v WHEN 1 THEN hor WHEN 2 THEN ver ELSE diag END AS r, CASE WHEN p IN (1, 2) THEN v ELSE plus END AS g, CASE p WHEN 3 THEN v WHEN 2 THEN hor WHEN 1 THEN ver ELSE diag END AS b FROM nb),
{sql_render.look("rgb", "image_id, y, x", "0e0")},
flat AS (SELECT image_id, c, v FROM (UNPIVOT (SELECT image_id, r, g, b FROM shown) ON r, g, b INTO NAME c VALUE v))"""


def _mosaic_files(spark, sf):
    """The frames as files of mosaics, encoded once, as a folder of files would be: a job
    reads its contents several times."""
    from sparkroom.plans import convert
    from sparkroom.sources import files, tiff

    tags = {tiff.PHOTOMETRIC: (3, (tiff.CFA,)), convert.CFA_PATTERN: (1, (0, 1, 1, 2)), convert.WHITE: (3, (1023,))}
    made = tiff.encode_pages([tiff.PageRows(_frames(spark, sf), tags=tags)])
    folder = files.scratch_path(spark, "mosaics")
    made.select(F.concat(F.lit("/frames/"), F.col("image_id").cast("string"), F.lit(".dng")).alias("path"), "content").write.parquet(folder)
    return spark.read.parquet(folder)


_ID_OF = r"(\d+)\.[a-z]+$"


def _id():
    return F.regexp_extract("path", _ID_OF, 1).cast("long").alias("image_id")


@add("render_files", f"WITH {_SHOWN} SELECT image_id, c, count(*) AS n, round(avg(v), 6) AS mean FROM flat GROUP BY image_id, c")
def render_files(spark, sf):
    """Mosaic files opened and rendered by their tags."""
    from sparkroom.plans import convert

    px, _ = convert.render_files(_mosaic_files(spark, sf))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in "rgb"]))
    return px.select(_id(), cells.alias("p")).groupBy("image_id", "p.c").agg(F.count("*").alias("n"), F.round(F.avg("p.v"), 6).alias("mean"))


@add("convert_files", f"WITH {_SHOWN} SELECT image_id, 'written' AS status, count(*) AS n, CAST(sum(floor(v * 255 + 0.5e0)) AS BIGINT) AS total FROM flat GROUP BY image_id")
def convert_files(spark, sf):
    """Mosaic files rendered into a folder of 8-bit files, which are then read."""
    from sparkroom.plans import convert
    from sparkroom.sources import files, tiff

    folder, status = files.scratch_path(spark, "converted"), files.scratch_path(spark, "converted-status")
    convert.convert(_mosaic_files(spark, sf), folder).write.parquet(status)
    back = tiff.pixels_of(spark.read.format("binaryFile").load(folder).select("path", "content"))
    sums = back.groupBy(_id()).agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"))
    return spark.read.parquet(status).select(_id(), "status").join(sums, "image_id")


@add("copy_pages", f"WITH {_FRAMES}, l AS (SELECT image_id, ((max(v) FILTER (WHERE y % 2 = 0 AND x % 2 = 0) / 65535e0 + max(v) FILTER (WHERE y % 2 = 0 AND x % 2 = 1) / 65535e0) + (max(v) FILTER (WHERE y % 2 = 1 AND x % 2 = 0) / 65535e0 + max(v) FILTER (WHERE y % 2 = 1 AND x % 2 = 1) / 65535e0)) / 4 AS v FROM f GROUP BY image_id, y // 2, x // 2) SELECT image_id, CAST(0 AS INTEGER) AS page, count(*) * 3 AS n, CAST(sum(v) * 3 AS BIGINT) AS total FROM f GROUP BY image_id UNION ALL SELECT image_id, 1, count(*) * 3, CAST(sum(floor(v * 65535 + 0.5e0)) * 3 AS BIGINT) FROM l GROUP BY image_id")
def copy_pages(spark, sf):
    """Linear files copied with a halved page."""
    from sparkroom.plans import convert
    from sparkroom.sources import tiff

    linear = tiff.encode_pages([tiff.PageRows(_frames(spark, sf), tags={tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,))})])
    own = linear.select(F.concat(F.lit("/frames/"), F.col("image_id").cast("string"), F.lit(".dng")).alias("path"), "content")
    made = convert.copy_pages(own, levels=1, preview=False, least=2, source=4).withColumn("ifd", F.explode(F.array(F.lit(0), F.lit(1))))
    parts = [tiff.pixels_of(made.where(F.col("ifd") == i)).groupBy(_id()).agg(F.lit(i).alias("page"), F.count("*").alias("n"), F.sum("v").cast("long").alias("total")) for i in (0, 1)]
    return parts[0].union(parts[1])


@add("hourly_levels", "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def hourly_levels(spark, sf):
    """The streaming operator's windows over the whole table."""
    from sparkroom.streaming import frames

    return frames.windowed_levels(views.table(spark, sf, "events")).withColumn("mean", F.round("mean", 6))
