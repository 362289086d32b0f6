"""SQL of rendering by the order of the rendering document, shared by queries' SQL."""

from __future__ import annotations

from collections.abc import Sequence

from sparkroom.functions import colour


def product(m: Sequence[Sequence[float]], names: Sequence[str] = ("r", "g", "b")) -> str:
    """Three columns r, g and b: a matrix times three columns."""
    row = lambda line: " + ".join(f"{n} * ({v!r}e0)" for n, v in zip(names, map(float, line)))
    return ", ".join(f"{row(line)} AS {c}" for c, line in zip("rgb", m))


def look(source: str, keys: str, exposure: str, to_prophoto: Sequence[Sequence[float]] | None = None, shadows: float = 5.0) -> str:
    """CTEs from ``source`` (keys, r, g, b: linear camera values; or without a matrix
    linear sRGB) to ``shown`` (keys, r, g, b in [0, 1])."""
    start = to_prophoto if to_prophoto is not None else INVERSE
    ramp = lambda c: f"least(greatest(CASE WHEN {c} <= 0 THEN 0e0 WHEN {c} < 2 * bl THEN {c} * {c} / ((wh - bl) * 4 * bl) ELSE ({c} - bl) / (wh - bl) END, 0e0), 1e0)"
    dark = lambda c: f"CASE WHEN ev >= 0 THEN {c} WHEN {c} <= 0.25e0 THEN {c} * pow(2e0, ev) ELSE ((16 / 9e0 * (1 - pow(2e0, ev))) * {c} + (pow(2e0, ev) - 8 / 9e0 * (1 - pow(2e0, ev)))) * {c} + (1 - 16 / 9e0 * (1 - pow(2e0, ev)) - pow(2e0, ev) + 8 / 9e0 * (1 - pow(2e0, ev))) END"
    at = lambda c: f"(curve[CAST(least(floor({c} * 255), 254) AS INTEGER) + 1] + (curve[CAST(least(floor({c} * 255), 254) AS INTEGER) + 2] - curve[CAST(least(floor({c} * 255), 254) AS INTEGER) + 1]) * ({c} * 255 - CAST(least(floor({c} * 255), 254) AS INTEGER)))"
    tone = lambda c: f"lo2 + (hi2 - lo2) * CASE WHEN hi > lo THEN ({c} - lo) / (hi - lo) ELSE 0e0 END AS {c}"
    gamma = lambda c: f"CASE WHEN {c} <= 0.0031308e0 THEN {c} * 12.92e0 ELSE pow({c}, 1 / 2.4e0) * 1.055e0 - 0.055e0 END AS {c}"
    each = lambda f: ", ".join(f(c) for c in "rgb")
    return f"""pp AS (SELECT {keys}, {exposure} AS ev, 1e0 / pow(2e0, greatest({exposure}, 0e0)) AS wh, {product(start)} FROM {source}),
pe AS (SELECT {keys}, ev, {each(lambda c: f'{ramp(c)} AS {c}')} FROM (SELECT *, least({shadows * 0.001!r}e0, wh * 0.99e0) AS bl FROM pp)),
pd AS (SELECT {keys}, {each(lambda c: f'{dark(c)} AS {c}')} FROM pe),
tc AS (SELECT list_transform(range(0, 256), lambda i: i / 255e0 - 0.18e0 * sin(2 * pi() * i / 255) / (2 * pi())) AS curve),
ph AS (SELECT {keys}, r, g, b, curve, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pd, tc),
pt AS (SELECT {keys}, {each(tone)} FROM (SELECT *, {at('hi')} AS hi2, {at('lo')} AS lo2 FROM ph)),
ps AS (SELECT {keys}, {product(colour.prophoto_to_srgb().tolist())} FROM pt),
shown AS (SELECT {keys}, {each(gamma)} FROM (SELECT {keys}, {each(lambda c: f'least(greatest({c}, 0e0), 1e0) AS {c}')} FROM ps))"""


#: Linear sRGB to ProPhoto, for files without a colour matrix.
INVERSE = colour.working_matrix(None).tolist()


def mosaic(source: str, keys: str, pattern: str) -> str:
    """CTE ``rgb`` from ``source`` (keys, y, x, v): the known colour, else the mean of the
    side neighbours of that colour, else of the diagonal ones. ``pattern`` is a text of
    four letters; ``keys`` name the image."""
    same = " AND ".join(f"n.{k} = c.{k}" for k in keys.split(", "))
    own = ", ".join(f"c.{k}" for k in keys.split(", "))
    letter = f"substr({pattern}, CAST(y % 2 * 2 + x % 2 + 1 AS INTEGER), 1)"
    pick = lambda c: f"coalesce(max(n.v) FILTER (WHERE n.l = '{c}' AND n.y = c.y AND n.x = c.x), avg(n.v) FILTER (WHERE n.l = '{c}' AND abs(n.y - c.y) + abs(n.x - c.x) = 1), avg(n.v) FILTER (WHERE n.l = '{c}' AND abs(n.y - c.y) + abs(n.x - c.x) = 2))"
    return f"""lettered AS (SELECT *, {letter} AS l FROM {source}),
rgb AS (SELECT {own}, c.y, c.x, {', '.join(f"{pick(c.upper())} AS {c}" for c in 'rgb')}
  FROM lettered c JOIN (SELECT {keys}, y + dy AS ky, x + dx AS kx, y, x, v, l FROM lettered, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) n ON {same} AND n.ky = c.y AND n.kx = c.x
  GROUP BY {own}, c.y, c.x)"""
