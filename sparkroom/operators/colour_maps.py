"""Table-driven colour: hue/saturation maps, look tables, gain tables.

A table is metadata of an image, so it is a literal array and its lookups are
part of the projection. Lookups interpolate between the corners around a value;
hue wraps around."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkroom.functions import points
from sparkroom.operators.raster import Raster


def _axis(v: Column, n: int, wrap: bool) -> tuple[list[Column], Column]:
    """Both neighbours' places and the part of the upper one; ``v`` in [0, 1]."""
    if n == 1:
        return [F.lit(0), F.lit(0)], F.lit(0.0)
    at = v * float(n if wrap else n - 1)
    low = F.least(F.floor(at), F.lit(n - 1 if wrap else n - 2)).cast("int")
    high = (low + 1) % n if wrap else low + 1
    return [low, high], at - low


def interpolate(table: Sequence[float], shape: Sequence[int], at: Sequence[Column], wrap: Sequence[bool]) -> Column:
    """Multilinear interpolation in a table of any number of axes, row-major."""
    return _corners(table, shape, [_axis(v, n, w) for v, n, w in zip(at, shape, wrap)])


def _corners(table: Sequence[float], shape: Sequence[int], axes: Sequence[tuple[list[Column], Column]]) -> Column:
    flat = F.lit([float(v) for v in table])
    out = None
    for corner in product((0, 1), repeat=len(axes)):
        place, weight = F.lit(0), F.lit(1.0)
        for bit, n, (places, part) in zip(corner, shape, axes):
            place = place * n + places[bit]
            weight = weight * (part if bit else 1.0 - part)
        term = weight * F.get(flat, place)
        out = term if out is None else out + term
    return out


def hue_sat_map(r: Raster, shape: tuple[int, int, int], hue_shift: Sequence[float], sat_scale: Sequence[float], val_scale: Sequence[float]) -> Raster:
    """A map over (hue, saturation, value) of hue shift in degrees and scales of
    saturation and value. A look table has the same form."""

    r.need(3)
    # each step is a projection of its own, so that later ones name its columns
    # and the tree of expressions stays small
    h, s, v = points.hsv(*[F.col(c) for c in r.channels])
    df = r.df.withColumns({"_h": h, "_s": s, "_v": v})
    at = (F.col("_h") / 6.0, points.clamp(F.col("_s")), points.clamp(F.col("_v")))
    axes = {}
    for i, (value, n, wrap) in enumerate(zip(at, shape, (True, False, False))):
        (low, high), part = _axis(value, n, wrap)
        axes |= {f"_l{i}": low, f"_u{i}": high, f"_p{i}": part}
    df = df.withColumns(axes)
    named = [([F.col(f"_l{i}"), F.col(f"_u{i}")], F.col(f"_p{i}")) for i in range(3)]
    shift, ss, vs = (_corners(t, shape, named) for t in (hue_shift, sat_scale, val_scale))
    df = df.withColumns({"_h2": F.pmod(F.col("_h") + shift / 60.0, F.lit(6.0)), "_s2": points.clamp(F.col("_s") * ss), "_v2": points.clamp(F.col("_v") * vs)})
    new = points.rgb_of_hsv(F.col("_h2"), F.col("_s2"), F.col("_v2"))
    df = df.withColumns(dict(zip(r.channels, new)))
    return replace(r, df=df.select(*r.df.columns))


def mix_maps(low: Iterable[Sequence[float]], high: Iterable[Sequence[float]], weight: float) -> list[list[float]]:
    """The tables of two illuminants at a temperature: ``weight`` is the first one's
    share, as for their matrices."""
    return [[a * weight + b * (1 - weight) for a, b in zip(x, y, strict=True)] for x, y in zip(low, high, strict=True)]


def gain_table(r: Raster, shape: tuple[int, int, int], gains: Sequence[float], weights: Sequence[float] = (0.2, 0.6, 0.2), exposure: float = 0.0) -> Raster:
    """Gain by row, column and brightness; the brightness index follows the exposure."""
    r.need(3)
    red, green, blue = (F.col(c) for c in r.channels)
    light = points.clamp((red * weights[0] + green * weights[1] + blue * weights[2]) * 2.0**exposure)
    row, column = F.col("y") / float(max(1, r.height - 1)), F.col("x") / float(max(1, r.width - 1))
    gain = interpolate(gains, shape, (row, column, light), (False, False, False))
    return r.map(lambda c: points.clamp(c * gain))
