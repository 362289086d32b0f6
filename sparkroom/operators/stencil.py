"""Demosaicing and gain grids: operators that read a pixel's neighbours.

Neighbours in a row come from a window over (image_id, y), those in a column from
one over (image_id, x); diagonals are the row neighbours' sums taken along the
column. So one pass is two exchanges whatever the pattern, with each image's rows
and columns spread over tasks. Images of more rows than ``BAND`` are cut into bands
of so many, with the rows around as a halo, so that no column of one is a task's.
Means take the neighbours that exist, which is also the rule at borders.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroom.operators.raster import RGB, Raster

# Colours of the 2x2 block, row by row.
PATTERNS = {"RGGB": "RGGB", "GRBG": "GRBG", "GBRG": "GBRG", "BGGR": "BGGR"}
ALGORITHMS = ("bilinear", "ea", "ea_fast")
#: Rows of a band, and rows around it that a stencil reads at most.
BAND, HALO = 1024, 3


def colour_at(pattern: str | Column, y: Column, x: Column) -> Column:
    """Colour letter of a pixel; the pattern may be a column."""
    if isinstance(pattern, Column):
        return F.substring(pattern, ((y % 2) * 2 + x % 2 + 1).cast("int"), F.lit(1))
    if pattern not in PATTERNS:
        raise ValueError(f"no pattern {pattern!r}")
    return F.get(F.lit(list(pattern)), ((y % 2) * 2 + x % 2).cast("int"))


def _rows() -> Window:
    return Window.partitionBy("image_id", "band", "y").orderBy("x")


def _columns() -> Window:
    return Window.partitionBy("image_id", "band", "x").orderBy("y")


def _banded(df: DataFrame, height: int) -> DataFrame:
    """Rows with their band; those near a border are in the next one's halo too."""
    if height <= BAND:
        return df.withColumn("band", F.lit(0))
    at = lambda d: F.floor((F.col("y") + d) / BAND)
    near = F.sequence(F.greatest(at(-HALO), F.lit(0)), F.least(at(HALO), F.lit((height - 1) // BAND)))
    return df.withColumn("band", F.explode(near))


def _unbanded(df: DataFrame, height: int) -> DataFrame:
    return df if height <= BAND else df.where(F.col("band") == F.floor(F.col("y") / BAND))


def _add(a: Column, b: Column) -> Column:
    """Sum of what is there; null if nothing is."""
    return F.coalesce(a + b, a, b)


def _fill(df: DataFrame, planes: dict[str, str], rows_first: bool = True) -> DataFrame:
    """Complete planes that are known at some pixels: the known value, else the
    mean of the side neighbours known, else that of the diagonal ones."""
    one, other = (_rows(), _columns()) if rows_first else (_columns(), _rows())
    lag = lambda c, w: F.lag(c, 1).over(w)
    lead = lambda c, w: F.lead(c, 1).over(w)
    has = lambda c: c.isNotNull().cast("int")
    first = {}
    for src in planes.values():
        a, b = lag(src, one), lead(src, one)
        first |= {f"{src}_s": _add(a, b), f"{src}_n": has(a) + has(b)}
    df = df.withColumns(first)
    second = {}
    for src in planes.values():
        a, b = lag(src, other), lead(src, other)
        s, n = f"{src}_s", f"{src}_n"
        second |= {f"{src}_t": _add(F.col(s), _add(a, b)), f"{src}_m": F.col(n) + has(a) + has(b), f"{src}_d": _add(lag(s, other), lead(s, other)), f"{src}_k": F.coalesce(lag(n, other), F.lit(0)) + F.coalesce(lead(n, other), F.lit(0))}
    df = df.withColumns(second)
    value = lambda src: F.coalesce(F.col(src), F.col(f"{src}_t") / F.nullif(F.col(f"{src}_m"), F.lit(0)), F.col(f"{src}_d") / F.nullif(F.col(f"{src}_k"), F.lit(0)))
    return df.withColumns({new: value(src) for new, src in planes.items()})


def _planes(df: DataFrame, pattern: str | Column) -> DataFrame:
    colour = colour_at(pattern, F.col("y"), F.col("x"))
    return df.withColumn("colour", colour)


def demosaic(r: Raster, pattern: str | Column = "RGGB", algorithm: str = "bilinear") -> Raster:
    """One-channel mosaic to r, g and b; images may have patterns of their own, then a
    column of ``r``."""
    r.need(1)
    if algorithm not in ALGORITHMS:
        raise TypeError(f"no algorithm {algorithm!r}")
    df = _planes(_banded(r.df, r.height), pattern).select("image_id", "band", "y", "x", "v", "colour")
    if algorithm == "bilinear":
        known = df.withColumns({f"_{c}": F.when(F.col("colour") == c.upper(), F.col("v")) for c in RGB})
        full = _fill(known, {c: f"_{c}" for c in RGB})
    else:
        full = _edge_aware(df, fast=algorithm == "ea_fast")
    return replace(r, df=_unbanded(full, r.height).select("image_id", "y", "x", *RGB), channels=RGB)


def _edge_aware(df: DataFrame, fast: bool) -> DataFrame:
    """Green along the smaller gradient (the mean on a tie), with the second
    difference of the pixel's own colour unless ``fast``; then the other colours,
    as differences from green, or directly if ``fast``."""
    row, column = _rows(), _columns()

    def axis(w: Window) -> tuple[Column, Column]:
        """Value and gradient along one axis; null where a side is missing."""
        a, b = F.lag("v", 1).over(w), F.lead("v", 1).over(w)
        if fast:
            return _mean(a, b), F.abs(a - b)
        curve = F.coalesce(F.col("v") * 2 - F.lag("v", 2).over(w) - F.lead("v", 2).over(w), F.lit(0.0))
        return F.coalesce((a + b) / 2 + curve / 4, a, b), F.abs(a - b) + F.abs(curve)

    hv, hg = axis(row)
    df = df.withColumns({"hv": hv, "hg": hg})
    vv, vg = axis(column)
    df = df.withColumns({"vv": vv, "vg": vg})
    green = (
        F.when(F.col("colour") == "G", F.col("v"))
        .when(F.col("hg") < F.col("vg"), F.col("hv"))
        .when(F.col("vg") < F.col("hg"), F.col("vv"))
        .otherwise(_mean(F.col("hv"), F.col("vv")))
    )
    # at a border one axis has one neighbour: the whole axis counts before the half one
    green = F.when((F.col("colour") != "G") & F.col("hg").isNull() & F.col("vg").isNotNull(), F.col("vv")).when((F.col("colour") != "G") & F.col("vg").isNull() & F.col("hg").isNotNull(), F.col("hv")).otherwise(green)
    df = df.withColumn("g", green)
    base = F.lit(0.0) if fast else F.col("g")
    df = df.withColumns({f"_{c}": F.when(F.col("colour") == c.upper(), F.col("v") - base) for c in "rb"})
    # the last exchange was by columns: starting with them again needs one more only
    df = _fill(df, {"dr": "_r", "db": "_b"}, rows_first=False)
    return df.withColumns({"r": F.col("dr") + base, "b": F.col("db") + base})


def _mean(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2, a, b)


def gain_map(r: Raster, grid: list[list[float]]) -> Raster:
    """Multiply by a grid spread over the image, interpolated bilinearly. The
    grid is a few hundred numbers of the image's metadata, so it is a literal."""
    rows, cols = len(grid), len(grid[0])
    flat = F.lit([float(v) for line in grid for v in line])

    def place(c: str, size: int, n: int) -> tuple[Column, Column]:
        at = F.col(c) * (float(n - 1) / max(1, size - 1))
        i = F.least(F.floor(at), F.lit(max(0, n - 2))).cast("int")
        return i, at - i

    iy, fy = place("y", r.height, rows)
    ix, fx = place("x", r.width, cols)
    v = lambda dy, dx: F.get(flat, F.least(iy + dy, F.lit(rows - 1)) * cols + F.least(ix + dx, F.lit(cols - 1)))
    gain = (v(0, 0) * (1 - fx) + v(0, 1) * fx) * (1 - fy) + (v(1, 0) * (1 - fx) + v(1, 1) * fx) * fy
    return r.map(lambda c: c * gain)
