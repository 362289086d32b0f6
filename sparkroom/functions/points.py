"""Pixel values: expressions of one column, or of the three of a pixel.

All are built-in functions, so that chains of them fuse into one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it. (A column
    that stands several times in an expression is computed that often, and nested ones
    multiply.)"""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def quantize(v: Column, top: int) -> Column:
    """[0, 1] to whole numbers up to ``top``, rounded half up."""
    return F.floor(clamp(v) * float(top) + 0.5).cast("int")


def rescale_bits(v: Column, source: int, target: int) -> Column:
    """Whole numbers of ``source`` bits to ``target`` bits, truncated."""
    return F.floor(v.cast("double") * float(2**target - 1) / float(2**source - 1)).cast("int")


def normalize(v: Column, black: Column, white: Column) -> Column:
    return clamp((v - black) / (white - black))


def table_lookup(v: Column, table: Sequence[float]) -> Column:
    """Whole numbers through a table; beyond its end its last entry counts."""
    return F.get(F.lit([float(t) for t in table]), F.least(F.greatest(v, F.lit(0)), F.lit(len(table) - 1)).cast("int"))


def lut(v: Column, table: Sequence[float]) -> Column:
    """Linear interpolation in a table spread evenly over [0, 1]."""
    last = len(table) - 1
    if last < 1:
        raise ValueError("a table needs two entries")
    at = clamp(v) * float(last)
    i = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    t = F.lit([float(x) for x in table])
    return F.get(t, i) + (F.get(t, i + 1) - F.get(t, i)) * (at - i)


def curve(v: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through ``points`` in order of x, flat beyond them."""
    points = sorted(points)
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        if x1 > x0:
            out = F.when(v < x1, F.lit(float(y0)) + (v - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(v < points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def polynomial(v: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * v + float(c)
    return out


def radial_gain(x: Column, y: Column, k: Sequence[float], cx: float, cy: float, radius: float) -> Column:
    """1 + k0 r^2 + ... + k4 r^10 around a centre; r is 1 at ``radius``."""
    r2 = ((x - cx) * (x - cx) + (y - cy) * (y - cy)) / float(radius * radius)
    return 1.0 + polynomial(r2, k) * r2


def exposure_ramp(v: Column, exposure: float | Column, shadows: float | Column = 5.0, shadow_scale: float = 1.0, toe: float | None = None) -> Column:
    """Linear between black and white, with a quadratic toe that meets the line
    with equal slope; the toe's radius is black unless given. ``shadows`` may be a
    column, then scaled already."""
    if isinstance(shadows, Column):
        e = exposure if isinstance(exposure, Column) else F.lit(float(exposure))
        white = F.lit(1.0) / F.pow(F.lit(2.0), F.greatest(e, F.lit(0.0)))
        black = F.least(shadows * 0.001, white * 0.99)
        line = (v - black) / (white - black)
        foot = v * v / ((white - black) * 4 * F.nullif(black, F.lit(0.0)))
        return clamp(F.when(black <= 0, line).when(v <= 0, F.lit(0.0)).when(v < black * 2, foot).otherwise(line))
    level = shadows * shadow_scale * 0.001
    if isinstance(exposure, Column):
        white = F.lit(1.0) / F.pow(F.lit(2.0), F.greatest(exposure, F.lit(0.0)))
        black = F.least(F.lit(level), white * 0.99)
    else:
        white = 1.0 / 2.0 ** max(0.0, exposure)
        black = min(level, 0.99 * white)
    r = black if toe is None else toe
    slope = 1.0 / (white - black)
    line = (v - black) * slope
    if level <= 0 and toe is None or toe is not None and toe <= 0:
        return clamp(line)
    foot = (v - black + r) * (v - black + r) * (slope / (4 * r))
    return clamp(F.when(v <= black - r, F.lit(0.0)).when(v < black + r, foot).otherwise(line))


def exposure_tone(v: Column, exposure: float | Column) -> Column:
    """Darkening by an exposure below 0: a line of slope 2^exposure up to a quarter,
    and from there the parabola that goes on smoothly and ends at 1."""
    e = exposure if isinstance(exposure, Column) else F.lit(float(exposure))
    slope = F.pow(F.lit(2.0), e)
    a = (1 - slope) * (16 / 9)
    b = slope - a / 2
    dark = F.when(v <= 0.25, v * slope).otherwise((v * a + b) * v + (1 - a - b))
    return F.when(e < 0, dark).otherwise(v)


def lut_column(v: Column, table: Column) -> Column:
    """``lut`` with a table of its own in each row; a null table changes nothing."""
    last = F.size(table) - 1
    at = clamp(v) * last
    i = F.least(F.floor(at), last - 1).cast("int")
    return F.when(table.isNull(), v).otherwise(F.get(table, i) + (F.get(table, i + 1) - F.get(table, i)) * (at - i))


def srgb_gamma(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def srgb_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def matrix3(m: Sequence[Sequence[float | Column]], r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    k = lambda v: v if isinstance(v, Column) else float(v)
    return tuple(r * k(row[0]) + g * k(row[1]) + b * k(row[2]) for row in m)


def hue_tone(r: Column, g: Column, b: Column, tone) -> tuple[Column, Column, Column]:
    """A curve on the largest and least channel; the middle keeps its place
    between them, and so the hue."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    new_top, new_low = tone(top), tone(low)

    def one(c: Column) -> Column:
        part = F.when(top > low, (c - low) / F.nullif(top - low, F.lit(0.0))).otherwise(F.lit(0.0))
        return new_low + (new_top - new_low) * part

    return one(r), one(g), one(b)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 6), saturation and value."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(v - low, F.lit(0.0))
    h = F.when(v == r, (g - b) / d).when(v == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    h = F.coalesce(F.when(h < 0, h + 6.0).otherwise(h), F.lit(0.0))
    return h, F.coalesce((v - low) / F.nullif(v, F.lit(0.0)), F.lit(0.0)), v


def rgb_of_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """The published sextant form: channel n is v - v s max(0, min(k, 4 - k, 1))."""

    def one(n: int) -> Column:
        k = F.pmod(h + float(n), F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return one(5), one(3), one(1)
