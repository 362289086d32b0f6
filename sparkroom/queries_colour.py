"""Queries of colour operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroom.functions import colour, points
from sparkroom.operators import colour_maps
from sparkroom.operators.raster import RGB, Raster
from sparkroom.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_C = "least(greatest(CAST(embedding[(x + {i}) % 64 + 1] AS DOUBLE) * 0.5e0 + 0.5e0, 0e0), 1e0) + 0e0"
RGB_SQL = f"rgb AS (SELECT vec_id AS y, CAST(x AS BIGINT) AS x, {_C.format(i=0)} AS r, {_C.format(i=1)} AS g, {_C.format(i=2)} AS b FROM embeddings, (SELECT unnest(range(0, 64)) AS x)), dim AS (SELECT max(vec_id) + 1 AS h FROM embeddings)"


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def out(r: Raster) -> DataFrame:
    return r.df.select("y", "x", *[F.round(F.col(c) + 0.0, 6).alias(c) for c in r.channels])


class MatrixSql:
    """3x3 matrices as rows of SQL, each a table of cells named m00 to m22."""

    def __init__(self) -> None:
        self.tables: list[str] = []

    def _add(self, cells, source: str = "") -> str:
        name = f"t{len(self.tables)}"
        body = ", ".join(f"{c} AS m{i}{j}" for i, line in enumerate(cells) for j, c in enumerate(line))
        self.tables.append(f"{name} AS (SELECT {body}{source})")
        return name

    def given(self, rows) -> str:
        return self._add([[f"({v!r})::DOUBLE" for v in map(float, line)] for line in rows])

    def diagonal(self, values) -> str:
        return self._add([[values[i] if i == j else "0e0" for j in range(3)] for i in range(3)])

    def product(self, a: str, b: str) -> str:
        return self._add([[" + ".join(f"{a}.m{i}{k} * {b}.m{k}{j}" for k in range(3)) for j in range(3)] for i in range(3)], f" FROM {a}, {b}")

    def inverse(self, a: str) -> str:
        """By cofactors over the determinant."""
        minor = lambda i, j: "({0}.m{1}{3} * {0}.m{2}{4} - {0}.m{1}{4} * {0}.m{2}{3})".format(a, (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3)
        whole = " + ".join(f"{a}.m0{j} * {minor(0, j)}" for j in range(3))
        return self._add([[f"{minor(j, i)} / ({whole})" for j in range(3)] for i in range(3)], f" FROM {a}")

    def mix(self, a: str, b: str, part: str) -> str:
        return self._add([[f"{a}.m{i}{j} * ({part}) + {b}.m{i}{j} * (1 - ({part}))" for j in range(3)] for i in range(3)], f" FROM {a}, {b}")

    def times(self, a: str, b: str, values: list[str], scale: str = "1") -> list[str]:
        """Products of a matrix and three numbers, of tables ``a`` and ``b``."""
        return [f"((SELECT {' + '.join(f'{a}.m{i}{k} * ({v})' for k, v in enumerate(values))} FROM {a}{', ' + b if b else ''}) / ({scale}))" for i in range(3)]

    def bradford(self, source: list[str], target: list[str]) -> str:
        """Adaptation between two whites in XYZ."""
        m = self.given(colour.BRADFORD)
        gain = [f"{t} / {s}" for t, s in zip(self.times(m, "", target), self.times(m, "", source))]
        return self.product(self.product(self.inverse(m), self.diagonal(gain)), m)

    def over_pixels(self, m: str) -> str:
        cells = ", ".join(f"round(r * m{i}0 + g * m{i}1 + b * m{i}2 + 0e0, 6) AS {n}" for i, n in enumerate(RGB))
        return f"WITH {RGB_SQL}, {', '.join(self.tables)} SELECT y, x, {cells} FROM rgb, {m}"


def _xyz(xy) -> list[str]:
    x, y = xy
    return [f"({x}e0 / {y}e0)", "1e0", f"((1 - {x}e0 - {y}e0) / {y}e0)"]


def _matrix_sqls() -> dict[str, str]:
    """The queries' matrices worked out in SQL from their definitions."""
    out = {}

    def put(name: str, build) -> None:
        s = MatrixSql()
        out[name] = s.over_pixels(build(s))

    put("matrix3x3", lambda s: s.given(CAMERA))
    put("bradford", lambda s: s.bradford(_xyz(colour.D50_XY), _xyz(colour.D65_XY)))
    put("prophoto_to_srgb", lambda s: s.product(s.product(s.given(colour.XYZ_D65_TO_SRGB), s.bradford(_xyz(colour.D50_XY), _xyz(colour.D65_XY))), s.given(colour.PROPHOTO_TO_XYZ_D50)))
    put("dual_illuminant", lambda s: s.mix(s.given(COLOUR_A), s.given(COLOUR_B), "(1 / 4500e0 - 1 / 6504e0) / (1 / 2856e0 - 1 / 6504e0)"))
    put("camera_to_xyz", lambda s: s.inverse(s.product(s.product(s.given(np.diag(BALANCE)), s.given(CALIBRATION)), s.given(COLOUR_B))))

    def to_pcs(s: MatrixSql) -> str:
        back = s.inverse(s.given(COLOUR_B))
        white = s.times(back, "", [f"{v}e0" for v in NEUTRAL])
        # XYZ of the white's chromaticity has Y = 1
        adapted = s.product(s.bradford([f"({w} / {white[1]})" for w in white], _xyz(colour.D50_XY)), back)
        return s._add([[f"{adapted}.m{i}{j} / {white[1]}" for j in range(3)] for i in range(3)], f" FROM {adapted}")

    put("camera_to_pcs", to_pcs)
    forward = lambda s: s.product(s.product(s.given(FORWARD), s.inverse(s.diagonal([f"({n}e0 / {b}e0)" for n, b in zip(NEUTRAL, BALANCE)]))), s.inverse(s.given(np.diag(BALANCE))))
    put("forward_matrix", forward)
    put("camera_to_prophoto", lambda s: s.product(s.inverse(s.given(colour.PROPHOTO_TO_XYZ_D50)), to_pcs(s)))
    return out


def through(m):
    return lambda spark, sf: out(views.rgb(spark, sf).map_rgb(lambda r, g, b: points.matrix3(np.asarray(m).tolist(), r, g, b)))


CAMERA = ((1.6, -0.4, -0.2), (-0.3, 1.5, -0.2), (0.05, -0.45, 1.4))
COLOUR_A, COLOUR_B = np.array([[0.9, -0.3, -0.1], [-0.4, 1.2, 0.2], [-0.05, 0.2, 0.6]]), np.array([[0.7, -0.2, -0.06], [-0.5, 1.3, 0.2], [-0.1, 0.25, 0.55]])
FORWARD = ((0.7, 0.15, 0.11), (0.25, 0.8, -0.05), (0.02, -0.1, 0.9))
BALANCE, NEUTRAL = (0.9, 1.0, 1.1), (0.6, 1.0, 0.7)
CALIBRATION = ((1.02, 0.0, 0.01), (0.0, 0.99, 0.0), (-0.01, 0.0, 1.0))

_TO_PCS = colour.camera_to_pcs(NEUTRAL, COLOUR_B)
_MATRICES = {
    "matrix3x3": CAMERA,
    "prophoto_to_srgb": colour.prophoto_to_srgb(),
    "bradford": colour.bradford(colour.D50_XY, colour.D65_XY),
    "dual_illuminant": colour.interpolate_illuminants(4500.0, (2856.0, COLOUR_A), (6504.0, COLOUR_B)),
    "camera_to_xyz": colour.camera_to_xyz(BALANCE, CALIBRATION, COLOUR_B),
    "camera_to_pcs": _TO_PCS,
    "forward_matrix": colour.camera_to_pcs(NEUTRAL, COLOUR_B, FORWARD, BALANCE),
    "camera_to_prophoto": colour.camera_to_prophoto(_TO_PCS),
}
for _name, _sql in _matrix_sqls().items():
    add(_name, _sql)(through(_MATRICES[_name]))

_CURVE = "CASE WHEN {v} < 0.25e0 THEN {v} * 0.4e0 WHEN {v} < 0.5e0 THEN 0.1e0 + ({v} - 0.25e0) * 1.6e0 WHEN {v} < 0.75e0 THEN 0.5e0 + ({v} - 0.5e0) * 1.6e0 WHEN {v} < 1 THEN 0.9e0 + ({v} - 0.75e0) * 0.4e0 ELSE 1e0 END"
_HUE = ", ".join(f"round(nl + (nt - nl) * CASE WHEN t > l THEN ({c} - l) / (t - l) ELSE 0 END, 6) AS {c}" for c in RGB)


@add("tone_hue", f"WITH {RGB_SQL}, e AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM rgb), n AS (SELECT *, {_CURVE.format(v='t')} AS nt, {_CURVE.format(v='l')} AS nl FROM e) SELECT y, x, {_HUE} FROM n")
def tone_hue(spark, sf):
    tone = lambda v: points.curve(v, ((0, 0), (0.25, 0.1), (0.5, 0.5), (0.75, 0.9), (1, 1)))
    return out(views.rgb(spark, sf).map_rgb(lambda r, g, b: points.hue_tone(r, g, b, tone)))


SHAPE = (6, 2, 1)
SHIFT = [float(5 * i - 12) for i in range(12)]
SAT = [0.8 + 0.03 * i for i in range(12)]
VAL = [1.0 - 0.02 * i for i in range(12)]


def _table_sql(t) -> str:
    cells = "[" + ", ".join(f"{v:.17g}::DOUBLE" for v in t) + "]"
    return f"((1 - fh) * ((1 - fs) * {cells}[ih * 2 + 1] + fs * {cells}[ih * 2 + 2]) + fh * ((1 - fs) * {cells}[jh * 2 + 1] + fs * {cells}[jh * 2 + 2]))"


_SEXTANT = ", ".join(f"round(nv - nv * ns * greatest(0e0, least((nh + {n}) - 6 * floor((nh + {n}) / 6), 4 - ((nh + {n}) - 6 * floor((nh + {n}) / 6)), 1e0)), 6) AS {c}" for c, n in zip(RGB, (5, 3, 1)))


@add("hsv_map", f"""
WITH {RGB_SQL}, a AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
h0 AS (SELECT *, CASE WHEN d = 0 THEN 0e0 WHEN v = r THEN (g - b) / d WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS h_ FROM a),
h1 AS (SELECT y, x, v, CASE WHEN h_ < 0 THEN h_ + 6 ELSE h_ END AS h, CASE WHEN v = 0 THEN 0e0 ELSE d / v END AS s FROM h0),
i AS (SELECT *, CAST(least(floor(h / 6e0 * 6e0), 5) AS INTEGER) AS ih FROM h1),
f AS (SELECT *, (ih + 1) % 6 AS jh, h / 6e0 * 6e0 - ih AS fh, s AS fs FROM i),
m AS (SELECT *, h + {_table_sql(SHIFT)} / 60e0 AS hh, least(greatest(s * {_table_sql(SAT)}, 0e0), 1e0) AS ns, least(greatest(v * {_table_sql(VAL)}, 0e0), 1e0) AS nv FROM f),
n AS (SELECT y, x, ns, nv, hh - 6 * floor(hh / 6) AS nh FROM m)
SELECT y, x, {_SEXTANT} FROM n""")
def hsv_map(spark, sf):
    return out(colour_maps.hue_sat_map(views.rgb(spark, sf), SHAPE, SHIFT, SAT, VAL))


LOOK = (12, 4, 4)
LOOK_TABLES = {"hs": [i % 7 - 3.0 for i in range(192)], "ss": [0.9 + 0.2 * i / 192 for i in range(192)], "vs": [1.0 - 0.1 * i / 192 for i in range(192)]}
LOOK_MIX = 0.35


def _cube(t: str) -> str:
    """A table at a hue, saturation and value by its eight corners."""
    out = []
    for k in range(8):
        i, j, l = k >> 2, k >> 1 & 1, k & 1
        weight = " * ".join(w if bit else f"(1 - {w})" for bit, w in ((i, "fh"), (j, "fs"), (l, "fv")))
        out.append(f"{weight} * {t}[(({'jh' if i else 'ih'} * 4 + {'si + 1' if j else 'si'}) * 4 + {'vi + 1' if l else 'vi'}) + 1]")
    return "(" + " + ".join(out) + ")"


def _look_sql(tables: str) -> str:
    return f"""
WITH {RGB_SQL}, {tables}, a AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
h0 AS (SELECT *, CASE WHEN d = 0 THEN 0e0 WHEN v = r THEN (g - b) / d WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS h_ FROM a),
h1 AS (SELECT y, x, v, CASE WHEN h_ < 0 THEN h_ + 6 ELSE h_ END AS h, CASE WHEN v = 0 THEN 0e0 ELSE d / v END AS s FROM h0),
i AS (SELECT *, CAST(least(floor(h / 6e0 * 12e0), 11) AS INTEGER) AS ih, CAST(least(floor(s * 3), 2) AS INTEGER) AS si, CAST(least(floor(v * 3), 2) AS INTEGER) AS vi FROM h1),
f AS (SELECT *, (ih + 1) % 12 AS jh, h / 6e0 * 12e0 - ih AS fh, s * 3 - si AS fs, v * 3 - vi AS fv FROM i),
m AS (SELECT *, h + {_cube('hs')} / 60e0 AS hh, least(greatest(s * {_cube('ss')}, 0e0), 1e0) AS ns, least(greatest(v * {_cube('vs')}, 0e0), 1e0) AS nv FROM f, tab),
n AS (SELECT y, x, ns, nv, hh - 6 * floor(hh / 6) AS nh FROM m)
SELECT y, x, {_SEXTANT} FROM n"""


@add("look_table", _look_sql("tab AS (SELECT list_transform(range(0, 192), lambda i: i % 7 - 3e0) AS hs, list_transform(range(0, 192), lambda i: 0.9e0 + 0.2e0 * i / 192) AS ss, list_transform(range(0, 192), lambda i: 1 - 0.1e0 * i / 192) AS vs)"))
def look_table(spark, sf):
    return out(colour_maps.hue_sat_map(views.rgb(spark, sf), LOOK, *LOOK_TABLES.values()))


@add("hsv_map_mixed", _look_sql(f"tab AS (SELECT list_transform(range(0, 192), lambda i: (i % 7 - 3e0) * {LOOK_MIX} + 2e0 * (1 - {LOOK_MIX})) AS hs, list_transform(range(0, 192), lambda i: (0.9e0 + 0.2e0 * i / 192) * {LOOK_MIX} + 1.1e0 * (1 - {LOOK_MIX})) AS ss, list_transform(range(0, 192), lambda i: (1 - 0.1e0 * i / 192) * {LOOK_MIX} + 0.9e0 * (1 - {LOOK_MIX})) AS vs)"))
def hsv_map_mixed(spark, sf):
    """The maps of two illuminants, mixed."""
    other = ([2.0] * 192, [1.1] * 192, [0.9] * 192)
    return out(colour_maps.hue_sat_map(views.rgb(spark, sf), LOOK, *colour_maps.mix_maps(LOOK_TABLES.values(), other, LOOK_MIX)))


@add("default_tone", f"WITH {RGB_SQL}, t AS (SELECT list_transform(range(0, 256), lambda i: i / 255e0 - 0.18e0 * sin(2 * pi() * i / 255) / (2 * pi())) AS l), p AS (SELECT y, x, r * 255 AS a, CAST(least(floor(r * 255), 254) AS INTEGER) AS i FROM rgb) SELECT y, x, round(l[i + 1] + (l[i + 2] - l[i + 1]) * (a - i), 6) AS v FROM p, t")
def default_tone(spark, sf):
    """The default curve over one channel."""
    return views.rgb(spark, sf).df.select("y", "x", F.round(points.lut(F.col("r"), colour.default_tone()), 6).alias("v"))


GAINS = [1.0, 1.1, 1.2, 0.9, 1.05, 1.3, 1.15, 0.95]
_G = "[" + ", ".join(f"{v}::DOUBLE" for v in GAINS) + "]"
_GAIN = "((1 - fy) * ((1 - fx) * ((1 - l) * {g}[1] + l * {g}[2]) + fx * ((1 - l) * {g}[3] + l * {g}[4])) + fy * ((1 - fx) * ((1 - l) * {g}[5] + l * {g}[6]) + fx * ((1 - l) * {g}[7] + l * {g}[8])))".format(g=_G)


@add("gain_table", f"WITH {RGB_SQL}, p AS (SELECT rgb.*, y / CAST(greatest(1, h - 1) AS DOUBLE) AS fy, x / 63e0 AS fx, least(greatest((r * 0.2e0 + g * 0.6e0 + b * 0.2e0) * pow(2, 0.5e0), 0e0), 1e0) AS l FROM rgb, dim), q AS (SELECT *, {_GAIN} AS k FROM p) SELECT y, x, " + ", ".join(f"round(least(greatest({c} * k, 0e0), 1e0), 6) AS {c}" for c in RGB) + " FROM q")
def gain_table(spark, sf):
    return out(colour_maps.gain_table(views.rgb(spark, sf), (2, 2, 2), GAINS, exposure=0.5))


_PRESETS = ", ".join(f"('{n}', {k}, {t})" for n, (k, t) in colour.WB_PRESETS.items())


@add("wb_presets", f"WITH p(preset, kelvin, tint) AS (VALUES {_PRESETS}), c AS (SELECT ['daylight', 'cloudy', 'shade', 'tungsten', 'fluorescent', 'flash'][CAST(c_nationkey % 6 + 1 AS INTEGER)] AS preset, c_custkey FROM customer) SELECT c_custkey, preset, kelvin, tint FROM c JOIN p USING (preset)")
def wb_presets(spark, sf):
    names = F.lit(list(colour.WB_PRESETS))
    kelvin, tint = (F.create_map(*[F.lit(x) for n, v in colour.WB_PRESETS.items() for x in (n, v[i])]) for i in (0, 1))
    c = views.table(spark, sf, "customer").select("c_custkey", F.get(names, (F.col("c_nationkey") % 6).cast("int")).alias("preset"))
    return c.select("c_custkey", "preset", F.element_at(kelvin, F.col("preset")).alias("kelvin"), F.element_at(tint, F.col("preset")).alias("tint"))


_LINES = ", ".join(f"({i}, {r}::DOUBLE, {u}::DOUBLE, {v}::DOUBLE, {t}::DOUBLE)" for i, (r, u, v, t) in enumerate(colour.ROBERTSON))


@add("cct", f"""
WITH l(i, r, u, v, t) AS (VALUES {_LINES}),
k AS (SELECT p_partkey, 2000e0 + p_partkey % 13001 AS kelvin, CAST(p_size % 161 - 80 AS DOUBLE) AS tint FROM part),
s AS (SELECT a.r AS r0, a.u AS u0, a.v AS v0, a.t AS t0, b.r AS r1, b.u AS u1, b.v AS v1, b.t AS t1 FROM l a JOIN l b ON b.i = a.i + 1),
j AS (SELECT k.*, s.*, (r1 - 1e6 / kelvin) / (r1 - r0) AS f FROM k JOIN s ON 1e6 / kelvin > r0 AND 1e6 / kelvin <= r1),
d AS (SELECT *, f / sqrt(1 + t0 * t0) + (1 - f) / sqrt(1 + t1 * t1) AS a, f * t0 / sqrt(1 + t0 * t0) + (1 - f) * t1 / sqrt(1 + t1 * t1) AS b FROM j),
w AS (SELECT p_partkey, kelvin, tint, u0 * f + u1 * (1 - f) + a / sqrt(a * a + b * b) * tint / -3000e0 AS u, v0 * f + v1 * (1 - f) + b / sqrt(a * a + b * b) * tint / -3000e0 AS v FROM d)
SELECT p_partkey, kelvin, tint, round(u, 6) AS u, round(v, 6) AS v, round(3 * u / (2 * u - 8 * v + 4), 6) AS cx, round(2 * v / (2 * u - 8 * v + 4), 6) AS cy FROM w""")
def cct(spark, sf):
    lines = colour.ROBERTSON
    k = views.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 13001 + 2000.0).alias("kelvin"), (F.col("p_size") % 161 - 80).cast("double").alias("tint"))
    mired = F.lit(1e6) / F.col("kelvin")
    # the segment between two of 31 lines: a chain of conditions on literals
    place = reduce(lambda acc, i: F.when(mired <= float(lines[i][0]), F.lit(i)).otherwise(acc), range(len(lines) - 1, 0, -1), F.lit(len(lines) - 1))
    at = lambda j, i: F.get(F.lit([float(line[j]) for line in lines]), i)
    i = F.col("i")
    seg = k.withColumn("i", place)
    f = (at(0, i) - mired) / (at(0, i) - at(0, i - 1))
    part = lambda t: (1 / F.sqrt(1 + t * t), t / F.sqrt(1 + t * t))
    (a0, b0), (a1, b1) = part(at(3, i - 1)), part(at(3, i))
    a, b = a0 * f + a1 * (1 - f), b0 * f + b1 * (1 - f)
    n, shift = F.sqrt(a * a + b * b), F.col("tint") / colour.TINT_SCALE
    u, v = at(1, i - 1) * f + at(1, i) * (1 - f) + a / n * shift, at(2, i - 1) * f + at(2, i) * (1 - f) + b / n * shift
    uv = seg.select("p_partkey", "kelvin", "tint", u.alias("u"), v.alias("v"))
    d = 2 * F.col("u") - 8 * F.col("v") + 4
    return uv.select("p_partkey", "kelvin", "tint", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), F.round(3 * F.col("u") / d, 6).alias("cx"), F.round(2 * F.col("v") / d, 6).alias("cy"))
