"""Queries of point operators, geometry and stencils."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroom import sql_render
from sparkroom.functions import points
from sparkroom.operators import geometry, opcodes, stencil
from sparkroom.operators.raster import Raster
from sparkroom.plans.render import FLAGSHIP, flagship
from sparkroom.queries_colour import RGB_SQL
from sparkroom.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The mosaic view as SQL.
CFA = "cfa AS (SELECT event_id // 100 AS y, event_id % 100 AS x, least(greatest(value / 5e2, 0e0), 1e0) + 0e0 AS v FROM events), dim AS (SELECT max(event_id) // 100 + 1 AS h, 100 AS w FROM events)"


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def out(r: Raster, digits: int = 6) -> DataFrame:
    """Pixels, rounded; means of means get the digits that they have."""
    return r.df.select("y", "x", *[F.round(F.col(c) + 0.0, digits).alias(c) for c in r.channels])


add("flagship_render", f"""
WITH {CFA},
lin AS (SELECT y, x, least(greatest((v - b) / (1e0 - b), 0e0), 1e0) AS v FROM (SELECT *, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 0.01e0 ELSE 0.02e0 END ELSE CASE WHEN x % 2 = 0 THEN 0.03e0 ELSE 0.015e0 END END AS b FROM cfa)),
nb AS (SELECT c.y, c.x, c.v, c.y % 2 * 2 + c.x % 2 AS p,
  avg(n.v) FILTER (WHERE abs(n.y - c.y) + abs(n.x - c.x) = 1) AS plus,
  avg(n.v) FILTER (WHERE n.y = c.y AND n.x <> c.x) AS hor, avg(n.v) FILTER (WHERE n.x = c.x AND n.y <> c.y) AS ver,
  avg(n.v) FILTER (WHERE n.y <> c.y AND n.x <> c.x) AS diag
  FROM lin c JOIN (SELECT y + dy AS ky, x + dx AS kx, y, x, v FROM lin, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) n ON n.ky = c.y AND n.kx = c.x
  GROUP BY ALL),
rgb AS (SELECT y, x, CASE p WHEN 0 THEN v WHEN 1 THEN hor WHEN 2 THEN ver ELSE diag END AS r, CASE WHEN p IN (1, 2) THEN v ELSE plus END AS g, CASE p WHEN 3 THEN v WHEN 2 THEN hor WHEN 1 THEN ver ELSE diag END AS b FROM nb),
{sql_render.look("rgb", "y, x", "-0.25e0", FLAGSHIP.camera_to_prophoto)},
q AS (SELECT c, CAST(floor(v * 255 + 0.5e0) AS BIGINT) AS u FROM (UNPIVOT (SELECT r, g, b FROM shown) ON r, g, b INTO NAME c VALUE v))
SELECT c, count(*) AS n, round(avg(u), 6) AS mean, CAST(max(u) AS INTEGER) AS top FROM q GROUP BY c""")(flagship)


@add("sub_mul", f"WITH {CFA} SELECT y, x, round((v - 0.25e0) * 2e0 + 0e0, 6) AS v FROM cfa")
def sub_mul(spark, sf):
    return out((views.cfa(spark, sf) - 0.25) * 2.0)


@add("cast_dtype", f"WITH {CFA} SELECT y, x, CAST(floor(v * 255e0 + 0.5e0) AS INTEGER) AS u8, CAST(floor(v * 255e0 + 0.5e0) AS INTEGER) AS u16, CAST(floor(v * 255e0 + 0.5e0) AS DOUBLE) AS f32 FROM cfa")
def cast_dtype(spark, sf):
    u8 = points.quantize(F.col("v"), 255)
    return views.cfa(spark, sf).df.select("y", "x", u8.alias("u8"), u8.cast("int").alias("u16"), u8.cast("float").cast("double").alias("f32"))


BLACK = ((0.01, 0.02), (0.03, 0.015))
BLACK_SQL = "CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 0.01e0 ELSE 0.02e0 END ELSE CASE WHEN x % 2 = 0 THEN 0.03e0 ELSE 0.015e0 END END"


@add("black_white", f"WITH {CFA}, b AS (SELECT *, {BLACK_SQL} + x % 10 * 0.0001e0 + CASE WHEN y < 50 THEN y % 7 * 0.0002e0 ELSE 0e0 END AS black FROM cfa) SELECT y, x, round(least(greatest((v - black) / (0.95e0 - black), 0e0), 1e0) + 0e0, 6) AS v FROM b")
def black_white(spark, sf):
    r = views.cfa(spark, sf)
    return out(opcodes.linearize(r, BLACK, 0.95, [x % 10 * 0.0001 for x in range(100)], [y % 7 * 0.0002 for y in range(50)]))


@add("lin_table", f"WITH {CFA}, a AS (SELECT y, x, CAST(floor(v * 1023e0 + 0.5e0) AS INTEGER) AS adc FROM cfa) SELECT y, x, adc, round(least(adc, 999) * least(adc, 999) / 1046529e0, 6) AS v FROM a")
def lin_table(spark, sf):
    table = [i * i / 1046529 for i in range(1000)]
    adc = points.quantize(F.col("v"), 1023)
    return views.cfa(spark, sf).df.select("y", "x", adc.alias("adc"), F.round(points.table_lookup(adc, table), 6).alias("v"))


@add("lut1d", f"WITH {CFA}, t AS (SELECT *, [0e0, 0.1e0, 0.35e0, 0.7e0, 1e0] AS l, CAST(least(floor(v * 4e0), 3) AS INTEGER) AS i FROM cfa) SELECT y, x, round(l[i + 1] + (l[i + 2] - l[i + 1]) * (v * 4e0 - i), 6) AS v FROM t")
def lut1d(spark, sf):
    return out(views.cfa(spark, sf).map(lambda v: points.lut(v, [0, 0.1, 0.35, 0.7, 1])))


POINTS = ((0, 0), (0.25, 0.1), (0.5, 0.5), (0.75, 0.9), (1, 1))


@add("curve_points", f"WITH {CFA} SELECT y, x, round(CASE WHEN v < 0.25e0 THEN v * 0.4e0 WHEN v < 0.5e0 THEN 0.1e0 + (v - 0.25e0) * 1.6e0 WHEN v < 0.75e0 THEN 0.5e0 + (v - 0.5e0) * 1.6e0 WHEN v < 1 THEN 0.9e0 + (v - 0.75e0) * 0.4e0 ELSE 1e0 END, 6) AS v FROM cfa")
def curve_points(spark, sf):
    return out(views.cfa(spark, sf).map(lambda v: points.curve(v, POINTS)))


@add("map_polynomial", f"WITH {CFA} SELECT y, x, round(CASE WHEN y >= 2 AND y < 8 AND x >= 10 AND x < 90 AND (y - 2) % 2 = 0 AND (x - 10) % 3 = 0 THEN least(greatest(0.05e0 + v * (0.8e0 + v * 0.3e0), 0e0), 1e0) ELSE v END, 6) AS v FROM cfa")
def map_polynomial(spark, sf):
    return out(opcodes.map_polynomial(views.cfa(spark, sf), [0.05, 0.8, 0.3], (2, 10, 8, 90), 2, 3))


@add("vignette", f"WITH {CFA}, r AS (SELECT y, x, v, ((x - 49.5e0) * (x - 49.5e0) + (y - (h - 1) * 0.5e0) * (y - (h - 1) * 0.5e0)) / (49.5e0 * 49.5e0 + (h - 1) * 0.5e0 * (h - 1) * 0.5e0) AS q FROM cfa, dim) SELECT y, x, round(least(greatest(v * (1 + 0.2e0 * q + 0.1e0 * q * q + 0.05e0 * q * q * q + 0.02e0 * q * q * q * q + 0.01e0 * q * q * q * q * q), 0e0), 1e0), 6) AS v FROM r")
def vignette(spark, sf):
    return out(opcodes.fix_vignette(views.cfa(spark, sf), (0.2, 0.1, 0.05, 0.02, 0.01)))


@add("exposure_ramp", f"WITH {CFA}, p AS (SELECT y, x, v, 0.5e0 AS w, 0.005e0 AS b FROM cfa) SELECT y, x, round(least(greatest(CASE WHEN v <= 0 THEN 0 WHEN v < 2 * b THEN v * v / (4 * b) / (w - b) ELSE (v - b) / (w - b) END, 0e0), 1e0), 6) AS v FROM p")
def exposure_ramp(spark, sf):
    return out(views.cfa(spark, sf).map(lambda v: points.exposure_ramp(v, 1.0)))


@add("srgb_gamma", f"WITH {CFA}, g AS (SELECT y, x, v, CASE WHEN v <= 0.0031308e0 THEN v * 12.92e0 ELSE pow(v, 1 / 2.4e0) * 1.055e0 - 0.055e0 END AS s FROM cfa) SELECT y, x, round(s, 6) AS v, round(CASE WHEN s <= 0.04045e0 THEN s / 12.92e0 ELSE pow((s + 0.055e0) / 1.055e0, 2.4e0) END, 6) AS back FROM g")
def srgb_gamma(spark, sf):
    r = views.cfa(spark, sf).map(points.srgb_gamma)
    return out(Raster(r.df.withColumn("back", points.srgb_linear(F.col("v"))), r.height, r.width, ("v", "back")))


@add("quantize", f"WITH {CFA}, q AS (SELECT y, x, CAST(floor(v * 65535e0 + 0.5e0) AS INTEGER) AS u16, CAST(floor(v * 255e0 + 0.5e0) AS INTEGER) AS u8 FROM cfa) SELECT y, x, u16, u8, u8 * 257 AS wide, CAST(floor(u16 * 1023e0 / 65535e0) AS INTEGER) AS u10 FROM q")
def quantize(spark, sf):
    q = views.cfa(spark, sf).df.select("y", "x", points.quantize(F.col("v"), 65535).alias("u16"), points.quantize(F.col("v"), 255).alias("u8"))
    return q.select("*", points.rescale_bits(F.col("u8"), 8, 16).alias("wide"), points.rescale_bits(F.col("u16"), 16, 10).alias("u10"))


@add("mono_render", f"WITH {CFA}, e AS (SELECT y, x, least(greatest(CASE WHEN v < 2 * b THEN v * v / (4 * b) / (w - b) ELSE (v - b) / (w - b) END, 0e0), 1e0) AS v FROM (SELECT *, pow(2, -0.5e0) AS w, 0.005e0 AS b FROM cfa)), t AS (SELECT y, x, CASE WHEN v < 0.25e0 THEN v * 0.4e0 WHEN v < 0.5e0 THEN 0.1e0 + (v - 0.25e0) * 1.6e0 WHEN v < 0.75e0 THEN 0.5e0 + (v - 0.5e0) * 1.6e0 WHEN v < 1 THEN 0.9e0 + (v - 0.75e0) * 0.4e0 ELSE 1e0 END AS v FROM e) SELECT y, x, round(CASE WHEN v <= 0.0031308e0 THEN v * 12.92e0 ELSE pow(v, 1 / 2.4e0) * 1.055e0 - 0.055e0 END, 6) AS v FROM t")
def mono_render(spark, sf):
    r = views.cfa(spark, sf).map(lambda v: points.exposure_ramp(v, 0.5))
    return out(r.map(lambda v: points.curve(v, POINTS)).map(points.srgb_gamma))


#: Boxes are shares of the image, so that they grow with it.
_BOX = "box AS (SELECT h // 5 AS top, h // 2 AS bh FROM dim)"


@add("crop", f"WITH {CFA}, {_BOX} SELECT y - top AS y, x - 10 AS x, round(v, 6) AS v FROM cfa, box WHERE y >= top AND y < top + bh AND x >= 10 AND x < 60")
def crop(spark, sf):
    r = views.cfa(spark, sf)
    return out(geometry.crop(r, 10, r.height // 5, 50, r.height // 2))


@add("crop_chain", f"WITH {CFA}, {_BOX} SELECT y - top - 1 AS y, x - 5 AS x, CAST(top + 1 AS INTEGER) AS y0, CAST(5 AS INTEGER) AS x0, round(v - 0.3e0 + 0e0, 6) AS v FROM cfa, box WHERE y >= top + 1 AND y < top + bh - 1 AND x >= 5 AND x < 85")
def crop_chain(spark, sf):
    r = views.cfa(spark, sf)
    top, h = r.height // 5, r.height // 2
    r = geometry.crop(geometry.crop(r, 2, top, 90, h) - 0.1, 3, 1, 80, h - 2) - 0.2
    return r.df.select("y", "x", F.lit(r.y0).alias("y0"), F.lit(r.x0).alias("x0"), F.round(F.col("v") + 0.0, 6).alias("v"))


ORIENT_SQL = {1: "y AS y, x AS x", 2: "y AS y, 99 - x AS x", 3: "h - 1 - y AS y, 99 - x AS x", 4: "h - 1 - y AS y, x AS x", 5: "x AS y, y AS x", 6: "x AS y, h - 1 - y AS x", 7: "99 - x AS y, h - 1 - y AS x", 8: "99 - x AS y, y AS x"}
for _code, _sql in ORIENT_SQL.items():
    add(f"orient_{_code}", f"WITH {CFA}, o AS (SELECT {_sql}, round(v, 6) AS v FROM cfa, dim) SELECT * FROM o")(lambda spark, sf, code=_code: out(geometry.orient(views.cfa(spark, sf), code)))


@add("orient_roundtrip", f"WITH {CFA} SELECT CAST(code AS INTEGER) AS code, CAST(0 AS BIGINT) AS moved, (SELECT count(*) FROM cfa) AS n FROM (SELECT unnest(range(1, 9)) AS code)")
def orient_roundtrip(spark, sf):
    r = views.cfa(spark, sf)

    def moved(code: int):
        y, x = geometry.turned_place(code, F.col("y"), F.col("x"), r.height, r.width)
        h, w = (r.width, r.height) if code >= 5 else (r.height, r.width)
        y, x = geometry.turned_place(geometry.INVERSE[code], y, x, h, w)
        return F.count(F.when((y != F.col("y")) | (x != F.col("x")), 1))

    cells = F.array(*[F.struct(F.lit(code).alias("code"), moved(code).alias("moved"), F.count("*").alias("n")) for code in range(1, 9)])
    return r.df.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


@add("resize_half", f"WITH {CFA} SELECT y // 2 AS y, x // 2 AS x, round(avg(v), 12) AS v FROM cfa, dim WHERE y < h // 2 * 2 GROUP BY ALL")
def resize_half(spark, sf):
    return out(geometry.halve(views.cfa(spark, sf)), 12)


@add("pyramid", f"WITH {CFA}, l1 AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM cfa, dim WHERE y < h // 2 * 2 GROUP BY ALL), l2 AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM l1, dim WHERE y < h // 2 // 2 * 2 AND x < 50 GROUP BY ALL) SELECT 0 AS level, y, x, round(v, 12) AS v FROM cfa UNION ALL SELECT 1, y, x, round(v, 12) FROM l1 UNION ALL SELECT 2, y, x, round(v, 12) FROM l2")
def pyramid(spark, sf):
    parts = [r.df.select(F.lit(level).alias("level"), "y", "x", F.round("v", 12).alias("v")) for level, r in geometry.pyramid(views.cfa(spark, sf), 2).items()]
    return parts[0].union(parts[1]).union(parts[2])


@add("pyramid_pick", f"WITH {CFA}, l1 AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM cfa, dim WHERE y < h // 2 * 2 GROUP BY ALL) SELECT 1 AS level, y, x, round(v, 12) AS v FROM l1")
def pyramid_pick(spark, sf):
    made = geometry.pyramid(views.cfa(spark, sf), 2)
    level = geometry.pick_level([(r.height, r.width) for r in made.values()], 0.4)
    return made[level].df.select(F.lit(level).alias("level"), "y", "x", F.round("v", 12).alias("v"))


@add("size_constrained", "WITH s AS (SELECT CAST(l_suppkey AS BIGINT) AS image_id, level, sum(4e0 * l_quantity / pow(4, level)) AS bytes FROM lineitem, (SELECT unnest(range(0, 4)) AS level) GROUP BY ALL) SELECT image_id, CAST(coalesce(min(level) FILTER (WHERE bytes <= 20000), max(level)) AS INTEGER) AS level FROM s GROUP BY image_id")
def size_constrained(spark, sf):
    items = views.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg((F.sum("l_quantity") * 4).alias("full"))
    sizes = items.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("full") / 4.0**k).alias("bytes")) for k in range(4)])).alias("s")).select("image_id", "s.*")
    return geometry.fit_level(sizes, 20_000)


#: Completing a plane: its own value, side neighbours, then diagonal ones.
def _fill_sql(source: str, planes: dict[str, str]) -> str:
    n = ", ".join(
        f"max({c}) FILTER (WHERE dy = 0 AND dx = 0) AS {c}0, avg({c}) FILTER (WHERE abs(dy) + abs(dx) = 1) AS {c}1, avg({c}) FILTER (WHERE abs(dy) + abs(dx) = 2) AS {c}2" for c in planes.values()
    )
    pick = ", ".join(f"coalesce({c}0, {c}1, {c}2) AS {new}" for new, c in planes.items())
    return f"(SELECT y, x, {pick} FROM (SELECT y + dy AS y, x + dx AS x, {n} FROM {source}, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) GROUP BY y + dy, x + dx))"


MASK = "SELECT y, x, v, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END AS kr, CASE WHEN (y + x) % 2 = 1 THEN v END AS kg, CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END AS kb FROM cfa"


@add("demosaic_bilinear", f"WITH {CFA}, k AS ({MASK}) SELECT f.y, f.x, round(r, 12) AS r, round(g, 12) AS g, round(b, 12) AS b FROM {_fill_sql('k', {'r': 'kr', 'g': 'kg', 'b': 'kb'})} f JOIN cfa USING (y, x)")
def demosaic_bilinear(spark, sf):
    return out(stencil.demosaic(views.cfa(spark, sf)), 12)


def _edge_sql(fast: bool) -> str:
    curve = "0e0" if fast else "coalesce(2 * c.v - {a}2.v - {b}2.v, 0e0)"
    ch, cv = curve.format(a="l", b="r"), curve.format(a="u", b="d")
    base = "0e0" if fast else "g"
    joins = " ".join(f"LEFT JOIN cfa {n} ON {n}.y = c.y + ({dy}) AND {n}.x = c.x + ({dx})" for n, dy, dx in (("l1", 0, -1), ("r1", 0, 1), ("u1", -1, 0), ("d1", 1, 0), ("l2", 0, -2), ("r2", 0, 2), ("u2", -2, 0), ("d2", 2, 0)))
    return f"""
WITH {CFA},
a AS (SELECT c.y, c.x, c.v, coalesce((l1.v + r1.v) / 2 + {ch} / 4, l1.v, r1.v) AS hv, abs(l1.v - r1.v) + abs({ch}) AS hg,
        coalesce((u1.v + d1.v) / 2 + {cv} / 4, u1.v, d1.v) AS vv, abs(u1.v - d1.v) + abs({cv}) AS vg FROM cfa c {joins}),
gr AS (SELECT y, x, v, CASE WHEN (y + x) % 2 = 1 THEN v WHEN hg IS NULL AND vg IS NOT NULL THEN vv WHEN vg IS NULL AND hg IS NOT NULL THEN hv WHEN hg < vg THEN hv WHEN vg < hg THEN vv ELSE coalesce((hv + vv) / 2, hv, vv) END AS g FROM a),
k AS (SELECT *, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v - {base} END AS kr, CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v - {base} END AS kb FROM gr)
SELECT y, x, round(dr + {base} + 0e0, 12) AS r, round(g + 0e0, 12) AS g, round(db + {base} + 0e0, 12) AS b FROM {_fill_sql('k', {'dr': 'kr', 'db': 'kb'})} f JOIN gr USING (y, x)"""


for _fast, _name in ((False, "ea"), (True, "ea_fast")):
    add(f"demosaic_{_name}", _edge_sql(_fast))(lambda spark, sf, name=_name: out(stencil.demosaic(views.cfa(spark, sf), "RGGB", name), 12))


_PICK = ", ".join(f"round(CASE WHEN {here} THEN v ELSE least(greatest(v + coalesce(a{c}, {c} - v), 0e0), 1e0) END + 0e0, 10) AS {c}" for c, here in (("r", "y % 2 = 0 AND x % 2 = 0"), ("g", "(y + x) % 2 = 1"), ("b", "y % 2 = 1 AND x % 2 = 1")))


@add("demosaic_vng", f"""
WITH {CFA}, k AS ({MASK}), f AS (SELECT f.y, f.x, v, r, g, b FROM {_fill_sql('k', {'r': 'kr', 'g': 'kg', 'b': 'kb'})} f JOIN cfa USING (y, x)),
d AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE dy <> 0 OR dx <> 0),
n AS (SELECT c.y, c.x, c.v, c.r, c.g, c.b, coalesce(abs(p.v - m.v), 0) + coalesce(abs(q.v - c.v), 0) AS slope, p.r - p.v AS ar, p.g - p.v AS ag, p.b - p.v AS ab
  FROM f c CROSS JOIN d LEFT JOIN f p ON p.y = c.y + dy AND p.x = c.x + dx LEFT JOIN f m ON m.y = c.y - dy AND m.x = c.x - dx LEFT JOIN f q ON q.y = c.y + 2 * dy AND q.x = c.x + 2 * dx),
w AS (SELECT *, min(slope) OVER (PARTITION BY y, x) AS low, max(slope) OVER (PARTITION BY y, x) AS high FROM n),
o AS (SELECT y, x, v, r, g, b, {', '.join(f'avg(a{c}) FILTER (WHERE slope <= 1.5e0 * low + 0.5e0 * (high - low)) AS a{c}' for c in 'rgb')} FROM w GROUP BY y, x, v, r, g, b)
SELECT y, x, {_PICK} FROM o""")
def demosaic_vng(spark, sf):
    from sparkroom.operators.tiles import demosaic_vng as vng

    return out(vng(views.cfa(spark, sf), "RGGB"), 10)


GRID = [[1.0, 1.1, 1.2], [1.05, 1.0, 1.3], [1.2, 1.15, 1.0]]


@add("gain_map", f"WITH {CFA}, p AS (SELECT y, x, v, y * (2e0 / greatest(1, h - 1)) AS ay, x * (2e0 / 99) AS ax, [[1.0e0, 1.1e0, 1.2e0], [1.05e0, 1.0e0, 1.3e0], [1.2e0, 1.15e0, 1.0e0]] AS t FROM cfa, dim), i AS (SELECT *, CAST(least(floor(ay), 1) AS INTEGER) AS iy, CAST(least(floor(ax), 1) AS INTEGER) AS ix FROM p), f AS (SELECT *, ay - iy AS fy, ax - ix AS fx FROM i) SELECT y, x, round(v * ((t[iy + 1][ix + 1] * (1 - fx) + t[iy + 1][ix + 2] * fx) * (1 - fy) + (t[iy + 2][ix + 1] * (1 - fx) + t[iy + 2][ix + 2] * fx) * fy), 6) AS v FROM f")
def gain_map(spark, sf):
    return out(stencil.gain_map(views.cfa(spark, sf), GRID))


@add("warp_bilinear", f"WITH {CFA}, p AS (SELECT y, x, x - 49.5e0 AS dx, y - (h - 1) * 0.5e0 AS dy, h FROM cfa, dim), q AS (SELECT *, 0.98e0 + 0.015e0 * ((dx * dx + dy * dy) / (49.5e0 * 49.5e0 + (h - 1) * 0.5e0 * (h - 1) * 0.5e0)) AS f FROM p), s AS (SELECT y, x, dy * f + (h - 1) * 0.5e0 AS sy, dx * f + 49.5e0 AS sx, h FROM q), i AS (SELECT *, CAST(least(floor(sy), h - 2) AS BIGINT) AS iy, CAST(least(floor(sx), 98) AS BIGINT) AS ix FROM s WHERE sy >= 0 AND sx >= 0 AND sy <= h - 1 AND sx <= 99) SELECT i.y, i.x, round((a.v * (1 - (sx - ix)) + b.v * (sx - ix)) * (1 - (sy - iy)) + (c.v * (1 - (sx - ix)) + d.v * (sx - ix)) * (sy - iy), 6) AS v FROM i JOIN cfa a ON a.y = iy AND a.x = ix JOIN cfa b ON b.y = iy AND b.x = ix + 1 JOIN cfa c ON c.y = iy + 1 AND c.x = ix JOIN cfa d ON d.y = iy + 1 AND d.x = ix + 1")
def warp_bilinear(spark, sf):
    return out(opcodes.warp_rectilinear(views.cfa(spark, sf), (0.98, 0.015)))


_LENS = "p AS (SELECT rgb.*, x - 31.5e0 AS dx, y - (h - 1) * 0.5e0 AS dy, h, sqrt(31.5e0 * 31.5e0 + (h - 1) * 0.5e0 * (h - 1) * 0.5e0) AS rad FROM rgb, dim), q AS (SELECT *, dx / rad AS ux, dy / rad AS uy, (dx * dx + dy * dy) / (rad * rad) AS r2 FROM p), s AS (SELECT y, x, h, dx * (0.97e0 + 0.02e0 * r2) + rad * (0.002e0 * 2 * ux * uy + 0.003e0 * (r2 + 2 * ux * ux)) + 31.5e0 AS sx, dy * (0.97e0 + 0.02e0 * r2) + rad * (0.003e0 * 2 * ux * uy + 0.002e0 * (r2 + 2 * uy * uy)) + (h - 1) * 0.5e0 AS sy FROM q), i AS (SELECT *, CAST(least(floor(sy), h - 2) AS BIGINT) AS iy, CAST(least(floor(sx), 62) AS BIGINT) AS ix FROM s WHERE sy >= 0 AND sx >= 0 AND sy <= h - 1 AND sx <= 63)"
_CUBIC_AT = "(CASE WHEN abs({d}) < 1 THEN (abs({d}) * 1.5e0 - 2.5e0) * abs({d}) * abs({d}) + 1 WHEN abs({d}) < 2 THEN ((abs({d}) * -0.5e0 + 2.5e0) * abs({d}) - 4) * abs({d}) + 2 ELSE 0 END)"
_LINEAR_AT = "greatest(1 - abs({d}), 0)"
LENS = {"k": (0.97, 0.02), "tangential": (0.002, 0.003)}

for _bicubic, _name, _offsets, _at in ((False, "warp_rgb", "[0, 1]", _LINEAR_AT), (True, "warp_bicubic", "[-1, 0, 1, 2]", _CUBIC_AT)):
    _sum = ", ".join(f"round(sum({c} * wy * wx), 6) AS {c}" for c in "rgb")

    def _warped(spark, sf, bicubic=_bicubic):
        return out(opcodes.warp_rectilinear(views.rgb(spark, sf), **LENS, use_bicubic=bicubic))

    add(_name, f"WITH {RGB_SQL}, {_LENS}, w AS (SELECT i.y, i.x, {_at.format(d='(sy - iy - dy)')} AS wy, {_at.format(d='(sx - ix - dx)')} AS wx, least(greatest(iy + dy, 0), h - 1) AS ny, least(greatest(ix + dx, 0), 63) AS nx FROM i, (SELECT unnest({_offsets}) AS dy), (SELECT unnest({_offsets}) AS dx)) SELECT w.y, w.x, {_sum} FROM w JOIN rgb n ON n.y = ny AND n.x = nx GROUP BY w.y, w.x")(_warped)


PLANES = ((0.97, 0.02, 0.002, 0.003), (0.975, 0.018, 0.002, 0.003), (0.98, 0.016, 0.0, 0.0))
_SETS = "p AS (SELECT rgb.*, x - 31.5e0 AS dx, y - (h - 1) * 0.5e0 AS dy, h, sqrt(31.5e0 * 31.5e0 + (h - 1) * 0.5e0 * (h - 1) * 0.5e0) AS rad FROM rgb, dim), q AS (SELECT *, dx / rad AS ux, dy / rad AS uy, (dx * dx + dy * dy) / (rad * rad) AS r2, unnest([0, 1, 2]) AS c, unnest([0.97e0, 0.975e0, 0.98e0]) AS k0, unnest([0.02e0, 0.018e0, 0.016e0]) AS k1, unnest([0.002e0, 0.002e0, 0e0]) AS t0, unnest([0.003e0, 0.003e0, 0e0]) AS t1 FROM p), s AS (SELECT y, x, h, c, dx * (k0 + k1 * r2) + rad * (t0 * 2 * ux * uy + t1 * (r2 + 2 * ux * ux)) + 31.5e0 AS sx, dy * (k0 + k1 * r2) + rad * (t1 * 2 * ux * uy + t0 * (r2 + 2 * uy * uy)) + (h - 1) * 0.5e0 AS sy FROM q), i AS (SELECT *, CAST(least(floor(sy), h - 2) AS BIGINT) AS iy, CAST(least(floor(sx), 62) AS BIGINT) AS ix FROM s WHERE sy >= 0 AND sx >= 0 AND sy <= h - 1 AND sx <= 63)"


@add("warp_planes", f"WITH {RGB_SQL}, {_SETS}, w AS (SELECT i.y, i.x, i.c, greatest(1 - abs(sy - iy - dy), 0) AS wy, greatest(1 - abs(sx - ix - dx), 0) AS wx, iy + dy AS ny, ix + dx AS nx FROM i, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)), v AS (SELECT w.y, w.x, w.c, sum(CASE w.c WHEN 0 THEN n.r WHEN 1 THEN n.g ELSE n.b END * wy * wx) AS v FROM w JOIN rgb n ON n.y = ny AND n.x = nx GROUP BY ALL) SELECT y, x, " + ", ".join(f"round(max(v) FILTER (WHERE c = {i}), 6) AS {c}" for i, c in enumerate("rgb")) + " FROM v GROUP BY y, x HAVING count(*) = 3")
def warp_planes(spark, sf):
    """Lateral colour error: a set of coefficients for each channel."""
    return out(opcodes.warp_rectilinear(views.rgb(spark, sf), planes=PLANES))


@add("opcode_list", f"WITH {CFA}, p AS (SELECT y, x, v, ((x - 49.5e0) * (x - 49.5e0) + (y - (h - 1) * 0.5e0) * (y - (h - 1) * 0.5e0)) / (49.5e0 * 49.5e0 + (h - 1) * 0.5e0 * (h - 1) * 0.5e0) AS q FROM cfa, dim), a AS (SELECT y, x, least(greatest(v * (1 + 0.1e0 * q), 0e0), 1e0) AS v FROM p) SELECT y, x, round(least(greatest(0.02e0 + v * 0.9e0, 0e0), 1e0), 6) AS v FROM a")
def opcode_list(spark, sf):
    ops = [{"type": "fix_vignette", "k": (0.1,)}, {"type": "map_polynomial", "coefficients": (0.02, 0.9)}]
    return out(opcodes.apply_opcodes(views.cfa(spark, sf), ops))


def _resize_sql(weight: str, reach: int, source: str = "cfa", before: str = "", height: str = "h", width: int = 100, to_height: str = "h // 2", to_width: int = 60) -> str:
    """Every target pixel as weighted mean of the source pixels in reach."""
    axis = lambda t, sc, s: weight.format(d=f"((({t} + 0.5e0) * {sc} - 0.5e0 - {s}) / greatest(1e0, {sc}))")
    return f"""WITH {CFA}, {before}t AS (SELECT CAST({to_height} AS BIGINT) AS th, ({height}) / CAST(CAST({to_height} AS BIGINT) AS DOUBLE) AS sy, {width} / {to_width}e0 AS sx FROM dim),
px AS (SELECT c.y, tx.x, c.v, {axis('tx.x', 'sx', 'c.x')} AS w FROM {source} c, t, (SELECT unnest(range(0, {to_width})) AS x) tx WHERE abs((tx.x + 0.5e0) * sx - 0.5e0 - c.x) <= {reach} * sx),
hx AS (SELECT y, x, sum(v * w) / sum(w) AS v FROM px GROUP BY y, x),
ty AS (SELECT unnest(range(0, th)) AS y FROM t),
py AS (SELECT ty.y, hx.x, hx.v, {axis('ty.y', 'sy', 'hx.y')} AS w FROM hx, t, ty WHERE abs((ty.y + 0.5e0) * sy - 0.5e0 - hx.y) <= {reach} * sy)
SELECT y, x, round(sum(v * w) / sum(w) + 0e0, 9) AS v FROM py GROUP BY y, x"""


_CUBIC = "(CASE WHEN abs({d}) < 1 THEN (abs({d}) * 1.5e0 - 2.5e0) * abs({d}) * abs({d}) + 1 WHEN abs({d}) < 2 THEN ((abs({d}) * -0.5e0 + 2.5e0) * abs({d}) - 4) * abs({d}) + 2 ELSE 0 END)"
_LANCZOS = "(CASE WHEN abs({d}) < 1e-12 THEN 1 WHEN abs({d}) < 3 THEN sin(pi() * {d}) * sin(pi() * {d} / 3) * 3 / (pi() * {d} * pi() * {d}) ELSE 0 END)"


for _kind, _weight, _reach in (("catmull_rom", _CUBIC, 2), ("lanczos", _LANCZOS, 3)):

    def _resized(spark, sf, kind=_kind):
        r = views.cfa(spark, sf)
        return out(geometry.resize(r, r.height // 2, 60, kind), 9)

    add(f"resize_{_kind}", _resize_sql(_weight, _reach))(_resized)


_LIN = "lin AS (SELECT y, x, least(greatest((v - b) / (1e0 - b), 0e0), 1e0) AS v FROM (SELECT *, CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN 0.01e0 ELSE 0.02e0 END ELSE CASE WHEN x % 2 = 0 THEN 0.03e0 ELSE 0.015e0 END END AS b FROM cfa))"
@add("scaled", _resize_sql(_CUBIC, 2, "half", "half AS (SELECT y // 2 AS y, x // 2 AS x, avg(v) AS v FROM cfa, dim WHERE y < h // 2 * 2 GROUP BY ALL), ", "h // 2", 50, "round(h * 0.3e0)", 30))
def scaled(spark, sf):
    """The image at 0.3 of its size: halved once, then resampled."""
    return out(geometry.scale(views.cfa(spark, sf), 0.3), 9)


_STAGE_SQL = f"""
WITH {CFA}, {_LIN}, k AS ({MASK.replace('FROM cfa', 'FROM lin')}), rgb AS (SELECT f.y, f.x, r, g, b FROM {_fill_sql('k', {'r': 'kr', 'g': 'kg', 'b': 'kb'})} f JOIN cfa USING (y, x)),
cam AS (UNPIVOT (SELECT r, g, b FROM rgb) ON r, g, b INTO NAME c VALUE v),
{sql_render.look("rgb", "y, x", "-0.25e0", FLAGSHIP.camera_to_prophoto)},
u AS (SELECT 'raw' AS stage, 'v' AS c, v FROM cfa UNION ALL SELECT s, 'v', v FROM lin, (SELECT unnest(['linearized', 'linearized-plus-ops']) AS s) UNION ALL SELECT s, c, v FROM cam, (SELECT unnest(['camera-rgb', 'cropped']) AS s) UNION ALL SELECT 'display', c, v FROM (UNPIVOT (SELECT r, g, b FROM shown) ON r, g, b INTO NAME c VALUE v))
SELECT stage, c, count(*) AS n, round(avg(v), 6) AS mean FROM u GROUP BY stage, c"""


@add("stage_levels", _STAGE_SQL)
def stage_levels(spark, sf):
    """Mean and count of every channel after every stage of rendering, one
    aggregate for each stage."""
    from sparkroom.plans.render import STAGES, render

    parts = []
    for stage in STAGES:
        r = render(views.cfa(spark, sf), FLAGSHIP, stage)
        cells = F.array(*[F.struct(F.lit(stage).alias("stage"), F.lit(c).alias("c"), F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean")) for c in r.channels])
        parts.append(r.df.agg(cells.alias("s")))
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    return df.select(F.explode("s").alias("s")).select("s.*")


def _nodes(height: int) -> list[dict]:
    return [{"op": "sub_scalar", "k": 0.1}, {"op": "crop", "x": 3, "y": height // 5, "w": 60, "h": height // 2}, {"op": "orientation", "code": 6}, {"op": "mul_scalar", "k": 3.0}, {"op": "lut", "table": [0, 0.2, 1]}]


@add("node_list", f"WITH {CFA}, {_BOX}, a AS (SELECT x - 3 AS y, bh - 1 - (y - top) AS x, (v - 0.1e0) * 3e0 AS v FROM cfa, box WHERE y >= top AND y < top + bh AND x >= 3 AND x < 63), b AS (SELECT y, x, least(greatest(v, 0e0), 1e0) AS v FROM a) SELECT y, x, round(CASE WHEN v < 0.5e0 THEN v * 2 * 0.2e0 ELSE 0.2e0 + 0.8e0 * (v * 2 - 1) END, 6) AS v FROM b")
def node_list(spark, sf):
    from sparkroom.plans.render import apply_nodes

    r = views.cfa(spark, sf)
    return out(apply_nodes(r, _nodes(r.height)))
