"""Colour science on columns: 3x3 matrices as arrays of nine numbers, and temperature and
tint both ways, for tables with values of their own in each row. All is text of built-in
functions, so no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkroom.functions.colour import ROBERTSON, TINT_SCALE

_LAST = len(ROBERTSON) - 1
_MIRED, _U, _V, _SLOPE = ("array(" + ", ".join(f"{float(line[j])!r}D" for line in ROBERTSON) + ")" for j in range(4))
#: Unit directions of the isotemperature lines.
_ACROSS = "array(" + ", ".join(f"{1 / (1 + line[3] ** 2) ** 0.5!r}D" for line in ROBERTSON) + ")"
_UP = "array(" + ", ".join(f"{line[3] / (1 + line[3] ** 2) ** 0.5!r}D" for line in ROBERTSON) + ")"


def _once(name: str, value: str, use: str) -> str:
    """``use`` with ``value`` computed once, as ``name``."""
    return f"transform(array({value}), {name} -> {use})[0]"


def product(a: str, b: str) -> Column:
    """The product of two columns of nine numbers, row by row."""
    cells = [" + ".join(f"{a}[{3 * i + k}] * {b}[{3 * k + j}]" for k in range(3)) for i in range(3) for j in range(3)]
    return F.expr(f"array({', '.join(cells)})")


def inverse(m: str) -> Column:
    """The inverse of a column of nine numbers by its cofactors; null where there is none."""
    at = lambda i, j: f"{m}[{3 * (i % 3) + j % 3}]"
    # indices that run around give cofactors their signs
    cofactor = lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})"
    determinant = " + ".join(f"{at(0, j)} * {cofactor(0, j)}" for j in range(3))
    cells = ", ".join(f"{cofactor(j, i)} / d" for i in range(3) for j in range(3))
    return F.expr(_once("d", f"nullif({determinant}, 0D)", f"if(d is null, null, array({cells}))"))


def _between(body: str) -> str:
    """``body`` with s.foot_u, s.foot_v, s.a, s.b and s.mired of the line at part p.f of
    the way back from line p.i to the one before."""
    mix = lambda values: f"(p.f * {values}[p.i - 1] + (1 - p.f) * {values}[p.i])"
    line = f"named_struct('foot_u', {mix(_U)}, 'foot_v', {mix(_V)}, 'x', {mix(_ACROSS)}, 'y', {mix(_UP)}, 'mired', {mix(_MIRED)})"
    unit = "named_struct('foot_u', r.foot_u, 'foot_v', r.foot_v, 'mired', r.mired, 'a', r.x / sqrt(r.x * r.x + r.y * r.y), 'b', r.y / sqrt(r.x * r.x + r.y * r.y))"
    return _once("r", line, _once("s", unit, body))


def uv_of_temperature(kelvin: str, tint: str) -> Column:
    """u and v of columns of kelvin and tint: a point between Robertson's lines, moved
    along them by the tint."""
    i = f"least(greatest(size(filter(slice({_MIRED}, 2, {_LAST}), r -> r < m)) + 1, 1), {_LAST})"
    place = _once("i", i, f"named_struct('i', i, 'f', ({_MIRED}[i] - m) / ({_MIRED}[i] - {_MIRED}[i - 1]))")
    point = f"named_struct('u', s.foot_u + s.a * {tint} / {TINT_SCALE!r}D, 'v', s.foot_v + s.b * {tint} / {TINT_SCALE!r}D)"
    return F.expr(_once("m", f"1e6D / {kelvin}", _once("p", place, _between(point))))


def temperature_of_uv(u: str, v: str) -> Column:
    """kelvin and tint of columns of u and v: the point lies between the two lines to which
    its signed distances differ in sign; beyond all lines the first or last one counts."""
    distances = f"transform(sequence(0, {_LAST}), i -> ({v} - {_V}[i]) * {_ACROSS}[i] - ({u} - {_U}[i]) * {_UP}[i])"
    i = f"coalesce(get(filter(sequence(1, {_LAST}), i -> d[i] <= 0), 0), {_LAST})"
    part = "case when d[i - 1] <= 0 then 1D when d[i] > 0 then 0D else d[i] / (d[i] - d[i - 1]) end"
    place = _once("i", i, f"named_struct('i', i, 'f', {part})")
    made = f"named_struct('kelvin', 1e6D / nullif(s.mired, 0D), 'tint', (({u} - s.foot_u) * s.a + ({v} - s.foot_v) * s.b) * {TINT_SCALE!r}D)"
    return F.expr(_once("d", distances, _once("p", place, _between(made))))
