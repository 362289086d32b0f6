"""Linearization and lists of opcodes, folded into one chain of expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkroom.functions import points
from sparkroom.operators.lens import warp_lens
from sparkroom.operators.raster import Raster
from sparkroom.operators.stencil import gain_map


def total_black(black: Sequence[Sequence[float]], delta_h: Sequence[float] = (), delta_v: Sequence[float] = ()) -> Column:
    """Repeating black level plus what columns and rows add."""
    rows, cols = len(black), len(black[0])
    flat = F.lit([float(v) for line in black for v in line])
    out = F.get(flat, ((F.col("y") % rows) * cols + F.col("x") % cols).cast("int"))
    for name, delta in (("x", delta_h), ("y", delta_v)):
        if len(delta):
            out = out + F.coalesce(F.get(F.lit([float(v) for v in delta]), F.col(name).cast("int")), F.lit(0.0))
    return out


def linearize(r: Raster, black: Sequence[Sequence[float]], white: float, delta_h: Sequence[float] = (), delta_v: Sequence[float] = (), table: Sequence[float] | None = None) -> Raster:
    """Sensor values to [0, 1]: table, black levels, white level, clamp."""
    level = total_black(black, delta_h, delta_v)
    if table is not None:
        r = r.map(lambda v: points.table_lookup(v, table))
    return r.map(lambda v: points.normalize(v, level, F.lit(float(white))))


def map_polynomial(r: Raster, coefficients: Sequence[float], area: tuple[int, int, int, int] | None = None, row_pitch: int = 1, col_pitch: int = 1, planes: Sequence[str] | None = None) -> Raster:
    """A polynomial over an area (top, left, bottom, right), every ``pitch`` rows
    and columns, clamped."""
    top, left, bottom, right = area or (0, 0, r.height, r.width)
    here = (F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right)
    here = here & ((F.col("y") - top) % row_pitch == 0) & ((F.col("x") - left) % col_pitch == 0)
    chosen = set(planes or r.channels)
    changed = {c: F.when(here, points.clamp(points.polynomial(F.col(c), coefficients))).otherwise(F.col(c)) for c in r.channels if c in chosen}
    return Raster(r.df.withColumns(changed), r.height, r.width, r.channels, r.y0, r.x0)


def fix_vignette(r: Raster, k: Sequence[float], centre: tuple[float, float] = (0.5, 0.5)) -> Raster:
    """Radial gain around a centre in parts of the image; the farthest corner has radius 1."""
    cx, cy = centre[0] * (r.width - 1), centre[1] * (r.height - 1)
    radius = max(((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 for x in (0, r.width - 1) for y in (0, r.height - 1))
    gain = points.radial_gain(F.col("x"), F.col("y"), k, cx, cy, radius or 1.0)
    return r.map(lambda v: points.clamp(v * gain))


def warp_rectilinear(r: Raster, k: Sequence[float] = (), tangential: tuple[float, float] = (0.0, 0.0), centre: tuple[float, float] = (0.5, 0.5), use_bicubic: bool = False, planes: Sequence[Sequence[float]] | None = None, edge: bool = False) -> Raster:
    """Resampling by the published lens model (``lens.Lens.source``), with radial numbers
    ``k`` and two tangential ones for all channels, or a set of both for each channel in
    ``planes``. Pixels that point outside take the border's with ``edge``, else are left out."""
    return warp_lens(r, planes if planes is not None else [(*k, *tangential)], centre, use_bicubic, edge)


APPLY = {"gain_map": gain_map, "map_polynomial": map_polynomial, "fix_vignette": fix_vignette, "warp_rectilinear": warp_rectilinear}


def apply_opcodes(r: Raster, opcodes: Sequence[dict]) -> Raster:
    """An opcode list in order; each is its type and arguments."""
    for op in opcodes:
        args = dict(op)
        kind = args.pop("type")
        if kind not in APPLY:
            raise ValueError(f"UNKNOWN_OP {kind!r}")
        r = APPLY[kind](r, **args)
    return r
