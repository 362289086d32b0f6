"""Geometry: crops, the eight orientations, halving, pyramids, resampling.

Crops and orientations are projections and filters and fuse with what stands
around them. Halving is one aggregate whose keys hold image and block."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom.operators.raster import Raster

# New row and column of each orientation code as (row, column)
# with h and w the source's height and width less 1.
ORIENT = {
    1: ("y", "x"),
    2: ("y", "w-x"),
    3: ("h-y", "w-x"),
    4: ("h-y", "x"),
    5: ("x", "y"),
    6: ("x", "h-y"),
    7: ("w-x", "h-y"),
    8: ("w-x", "y"),
}
INVERSE = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}
MIN_LEVEL, MIN_SOURCE = 128, 256


def crop(r: Raster, x: int, y: int, w: int, h: int, reset_origin: bool = False) -> Raster:
    """Rows [y, y + h) and columns [x, x + w), numbered from 0 again."""
    if x < 0 or y < 0 or w < 1 or h < 1 or x + w > r.width or y + h > r.height:
        raise ValueError(f"crop {x},{y} {w}x{h} is out of bounds of {r.width}x{r.height}")
    inside = r.df.where(F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1))
    moved = inside.withColumns({"y": F.col("y") - y, "x": F.col("x") - x})
    return replace(r, df=moved, height=h, width=w, y0=0 if reset_origin else r.y0 + y, x0=0 if reset_origin else r.x0 + x)


def crop_fraction(r: Raster, left: float, top: float, right: float, bottom: float) -> Raster:
    """Crop by edges in parts of the image, as metadata states them."""
    x, y = round(left * r.width), round(top * r.height)
    return crop(r, x, y, max(1, round(right * r.width) - x), max(1, round(bottom * r.height) - y))


def turned_place(code: int, y: Column, x: Column, height: int, width: int) -> tuple[Column, Column]:
    """Row and column that a pixel of an image gets by an orientation code."""
    at = {"y": y, "x": x, "h-y": F.lit(height - 1) - y, "w-x": F.lit(width - 1) - x}
    row, column = ORIENT[code]
    return at[row], at[column]


def orient(r: Raster, code: int) -> Raster:
    """The pixel permutation of an orientation code; 1 returns its input."""
    if code not in ORIENT:
        raise ValueError(f"no orientation {code}")
    if code == 1:
        return r
    row, column = turned_place(code, F.col("y"), F.col("x"), r.height, r.width)
    turned = code >= 5
    return replace(r, df=r.df.withColumns({"y": row, "x": column}), height=r.width if turned else r.height, width=r.height if turned else r.width)


def halve(r: Raster) -> Raster:
    """Means of 2x2 blocks; an odd last row or column is left out."""
    h, w = r.height // 2, r.width // 2
    whole = r.df.where((F.col("y") < 2 * h) & (F.col("x") < 2 * w))
    # sums of the two rows' parts in a fixed order, so that results do not depend on the partitioning
    block = [F.col("image_id"), F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")]
    place = (F.col("y") % 2) * 2 + F.col("x") % 2
    part = lambda c, k: F.max(F.when(place == k, F.col(c)))
    mean = lambda c: ((part(c, 0) + part(c, 1)) + (part(c, 2) + part(c, 3))) / 4
    df = whole.groupBy(*block).agg(*[mean(c).alias(c) for c in r.channels])
    return replace(r, df=df, height=h, width=w, y0=r.y0 // 2, x0=r.x0 // 2)


def levels(height: int, width: int, wanted: int, least: int = MIN_LEVEL, source: int = MIN_SOURCE) -> list[int]:
    """Numbers of the halving levels that a pyramid gets: from sources of at
    least ``source``, down to ``least`` pixels."""
    out, small = [], min(height, width)
    if small < source:
        return out
    for level in range(1, wanted + 1):
        small //= 2
        if small < least:
            break
        out.append(level)
    return out


def pyramid(r: Raster, wanted: int) -> dict[int, Raster]:
    """Levels 0 (the source) to ``wanted`` by repeated halving."""
    out = {0: r}
    for level in range(1, wanted + 1):
        out[level] = halve(out[level - 1])
    return out


def pick_level(sizes: list[tuple[int, int]], scale: float) -> int:
    """Place of the smallest level that still reaches the scaled size of the first."""
    h, w = sizes[0][0] * scale, sizes[0][1] * scale
    fitting = [i for i, (a, b) in enumerate(sizes) if a >= h - 0.5 and b >= w - 0.5]
    return max(fitting, key=lambda i: (-sizes[i][0], i)) if fitting else 0


def scale(r: Raster, part: float, kind: str = "catmull_rom") -> Raster:
    """The image at a part of its size: halved while that still reaches it, then
    resampled to the exact size."""
    h, w = max(1, round(r.height * part)), max(1, round(r.width * part))
    wanted = max(0, int(math.log2(1 / part) + 1e-9)) if part < 1 else 0
    made = pyramid(r, wanted)
    level = pick_level([(x.height, x.width) for x in made.values()], part)
    return made[level] if (made[level].height, made[level].width) == (h, w) else resize(made[level], h, w, kind)


def preview_scale(height: int, width: int, unit: int = 128) -> str:
    """FULL, HALF or QUARTER by the smaller side."""
    small = min(height, width)
    return "QUARTER" if small >= 4 * unit else "HALF" if small >= 2 * unit else "FULL"


def fit_level(sizes: DataFrame, target: int) -> DataFrame:
    """For each image the largest level (least number) of at most ``target``
    bytes, else its smallest. Columns image_id, level, bytes."""
    best = F.coalesce(F.min(F.when(F.col("bytes") <= target, F.col("level"))), F.max("level"))
    return sizes.groupBy("image_id").agg(best.alias("level"))


def warp(r: Raster, source_y: Column, source_x: Column, bicubic: bool = False) -> Raster:
    """Resample all channels: every target pixel takes the mean of the source pixels
    around (source_y, source_x), four by their distance or, ``bicubic``, sixteen by
    the cubic's weights; those beyond a border are its pixels again. Pixels that
    point outside are left out.

    One join on the pixel: each target asks for its neighbours, and the weighted
    parts are added in a fixed order."""
    ask = r.df.select("image_id", "y", "x", source_y.alias("sy"), source_x.alias("sx")).where(
        (F.col("sy") >= 0) & (F.col("sx") >= 0) & (F.col("sy") <= r.height - 1) & (F.col("sx") <= r.width - 1)
    )
    base = ask.withColumns({"iy": F.greatest(F.least(F.floor("sy"), F.lit(r.height - 2)), F.lit(0)), "ix": F.greatest(F.least(F.floor("sx"), F.lit(r.width - 2)), F.lit(0))})
    reach = range(-1, 3) if bicubic else range(2)
    weight = catmull_rom if bicubic else (lambda d: F.greatest(1.0 - F.abs(d), F.lit(0.0)))
    inside = lambda v, size: F.least(F.greatest(v, F.lit(0)), F.lit(size - 1))
    cell = lambda k, dy, dx: F.struct(
        F.lit(k).alias("k"),
        inside(F.col("iy") + dy, r.height).alias("ny"),
        inside(F.col("ix") + dx, r.width).alias("nx"),
        weight(F.col("sy") - F.col("iy") - dy).alias("wy"),
        weight(F.col("sx") - F.col("ix") - dx).alias("wx"),
    )
    cells = [(dy, dx) for dy in reach for dx in reach]
    asked = base.withColumn("n", F.explode(F.array(*[cell(k, *at) for k, at in enumerate(cells)]))).select("image_id", "y", "x", "n.*")
    source = r.df.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), *[F.col(c).alias(f"_{c}") for c in r.channels])
    got = asked.join(source, ["image_id", "ny", "nx"])
    side = len(reach)

    def value(c: str) -> Column:
        # a row's parts first, then the rows, as four numbers are interpolated by hand
        part = lambda k: F.max(F.when(F.col("k") == k, F.col(f"_{c}") * F.col("wx")))
        rows = []
        for j in range(side):
            line = part(side * j)
            for k in range(side * j + 1, side * (j + 1)):
                line = line + part(k)
            rows.append(line * F.max(F.when(F.col("k") == side * j, F.col("wy"))))
        out = rows[0]
        for line in rows[1:]:
            out = out + line
        return out

    return replace(r, df=got.groupBy("image_id", "y", "x").agg(*[value(c).alias(c) for c in r.channels]))


def catmull_rom(d: Column) -> Column:
    """Weight of a sample at distance ``d``, the published cubic."""
    a = F.abs(d)
    return F.when(a < 1, (a * 1.5 - 2.5) * a * a + 1.0).when(a < 2, ((a * -0.5 + 2.5) * a - 4.0) * a + 2.0).otherwise(F.lit(0.0))


def lanczos(d: Column, lobes: int = 3) -> Column:
    """Weight of a sample at distance ``d``: sinc under a wider sinc."""
    x = d * math.pi
    return F.when(F.abs(d) < 1e-12, F.lit(1.0)).when(F.abs(d) < lobes, F.sin(x) * F.sin(x / lobes) * lobes / (x * x)).otherwise(F.lit(0.0))


FILTERS = {"catmull_rom": (catmull_rom, 2), "lanczos": (lanczos, 3)}


def _resample(df: DataFrame, axis: str, other: str, size: int, target: int, weight, reach: int, channels: tuple[str, ...]) -> DataFrame:
    """One axis of a separable filter: every source pixel adds its weighted part
    to the targets in reach, so one aggregate does it and no join."""
    scale = size / target
    wide = max(1.0, scale)
    at = (F.col(axis) + 0.5) / scale - 0.5
    span = reach * wide / scale
    first, last = F.greatest(F.ceil(at - span), F.lit(0)), F.least(F.floor(at + span), F.lit(target - 1))
    sent = df.where(first <= last).withColumn("_t", F.explode(F.sequence(first, last)))
    w = weight(((F.col("_t") + 0.5) * scale - 0.5 - F.col(axis)) / wide)
    parts = sent.select("image_id", F.col("_t").alias(axis), other, w.alias("_w"), *channels)
    return parts.groupBy("image_id", axis, other).agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in channels])


def resize(r: Raster, height: int, width: int, kind: str = "catmull_rom") -> Raster:
    """Separable resampling to another size; weights are made to add up to 1, so
    borders use what is there."""
    if kind not in FILTERS:
        raise ValueError(f"no filter {kind!r}")
    weight, reach = FILTERS[kind]
    df = r.df.select("image_id", "y", "x", *r.channels)
    df = _resample(df, "x", "y", r.width, width, weight, reach, r.channels)
    df = _resample(df, "y", "x", r.height, height, weight, reach, r.channels)
    return replace(r, df=df, height=height, width=width)
