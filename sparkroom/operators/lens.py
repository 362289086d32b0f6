"""Resampling by lens models, tile by tile.

Each tile of the target asks for the box of source pixels under the lens; a source tile
meets the tiles that ask for a part of it and sends them that part, packed. So pixels
move once as rows and about once as packed numbers, whatever the filter's reach, and a
task holds a tile and its box. A tile whose box is much larger than itself, under a lens
that shrinks a lot, is asked for in quarters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkroom.operators.raster import Raster

TILE = 256
#: A box of more than this many tiles is split, down to targets of this side.
WIDE, LEAST = 4, 16

ASKED = "height int, width int, sets int, k array<double>, centre array<double>, top long, left long, side int, ty long, tx long, y0 long, x0 long, y1 long, x1 long"
PIECE = "height int, width int, sets int, k array<double>, centre array<double>, top long, left long, side int, y0 long, x0 long, h int, w int, block binary"


@dataclass(frozen=True)
class Lens:
    """An image's size and its coefficients: for all channels, or a set for each."""

    height: int
    width: int
    sets: np.ndarray
    centre: tuple[float, float]

    @classmethod
    def of(cls, row) -> Lens:
        return cls(int(row.height), int(row.width), np.asarray(row.k, float).reshape(int(row.sets), -1), tuple(row.centre))

    def source(self, y: np.ndarray, x: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the target pixels lie in the source by the published model: in offsets
        from the centre, where the farthest corner has radius 1, at k0 + k1 r^2 + ...
        times the offset, plus t0 2 dx dy + t1 (r^2 + 2 dx^2) across and
        t1 2 dx dy + t0 (r^2 + 2 dy^2) down; t0 and t1 are the last two of ``k``."""
        cx, cy = self.centre[0] * (self.width - 1), self.centre[1] * (self.height - 1)
        radius = max(((a - cx) ** 2 + (b - cy) ** 2) ** 0.5 for a in (0, self.width - 1) for b in (0, self.height - 1)) or 1.0
        dx, dy = x - cx, y - cy
        r2 = (dx * dx + dy * dy) / (radius * radius)
        factor = np.zeros_like(r2)
        for c in k[-3::-1]:
            factor = factor * r2 + c
        sx, sy = dx * factor, dy * factor
        t0, t1 = k[-2:] * radius
        if t0 or t1:
            ux, uy = dx / radius, dy / radius
            sx = sx + (ux * uy * (2 * t0) + (r2 + ux * ux * 2) * t1)
            sy = sy + (ux * uy * (2 * t1) + (r2 + uy * uy * 2) * t0)
        return sy + cy, sx + cx

    def targets(self, top: int, left: int, side: int, edge: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Rows and columns of a target tile, and their places in the source by set; with
        ``edge`` places outside are the border's, else pixels with any such are left out."""
        y, x = (a.reshape(-1) for a in np.mgrid[top : min(top + side, self.height), left : min(left + side, self.width)])
        with np.errstate(all="ignore"):
            at = [self.source(y, x, k) for k in self.sets]
            ok = np.logical_and.reduce([np.isfinite(sy) & np.isfinite(sx) for sy, sx in at])
            if edge:
                at = [(np.clip(sy, 0, self.height - 1), np.clip(sx, 0, self.width - 1)) for sy, sx in at]
            else:
                ok &= np.logical_and.reduce([(sy >= 0) & (sx >= 0) & (sy <= self.height - 1) & (sx <= self.width - 1) for sy, sx in at])
        return y[ok], x[ok], [(sy[ok], sx[ok]) for sy, sx in at]


def _reach(bicubic: bool) -> range:
    return range(-1, 3) if bicubic else range(2)


def _first(s: np.ndarray, size: int) -> np.ndarray:
    return np.maximum(np.minimum(np.floor(s), size - 2), 0).astype(np.int64)


def _boxes(lens: Lens, top: int, left: int, side: int, bicubic: bool, edge: bool, tile: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """Target tiles (top, left, side) and the box (y0, x0, y1, x1, ends included) of the
    source pixels that each takes."""
    _, _, at = lens.targets(top, left, side, edge)
    if not len(at[0][0]):
        return
    reach = _reach(bicubic)
    ys = [f(_first(sy, lens.height)) for sy, _ in at for f in (np.min, np.max)]
    xs = [f(_first(sx, lens.width)) for _, sx in at for f in (np.min, np.max)]
    y0, y1 = max(int(min(ys)) + reach[0], 0), min(int(max(ys)) + reach[-1], lens.height - 1)
    x0, x1 = max(int(min(xs)) + reach[0], 0), min(int(max(xs)) + reach[-1], lens.width - 1)
    if (y1 - y0 + 1) * (x1 - x0 + 1) > WIDE * tile * tile and side > LEAST and side % 2 == 0:
        for t in (top, top + side // 2):
            for le in (left, left + side // 2):
                yield from _boxes(lens, t, le, side // 2, bicubic, edge, tile)
        return
    yield top, left, side, y0, x0, y1, x1


def asked_parts(lenses: DataFrame, bicubic: bool, edge: bool, tile: int = TILE) -> DataFrame:
    """A row for each target tile and source tile that it needs a part of."""
    kind = lenses.schema["image_id"].dataType.simpleString()
    last = lambda c: F.expr(f"({c} - 1) div {tile}")
    every = lenses.withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), last("height")))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), last("width"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lens, out = Lens.of(row), []
                for top, left, side, y0, x0, y1, x1 in _boxes(lens, int(row.ty) * tile, int(row.tx) * tile, tile, bicubic, edge, tile):
                    for ty in range(y0 // tile, y1 // tile + 1):
                        for tx in range(x0 // tile, x1 // tile + 1):
                            out.append((row.image_id, row.height, row.width, row.sets, row.k, row.centre, top, left, side, ty, tx, y0, x0, y1, x1))
                yield pd.DataFrame(out, columns=["image_id", *[c.split()[0] for c in ASKED.split(", ")]])

    return every.repartition("image_id", "ty", "tx").select("image_id", "height", "width", "sets", "k", "centre", "ty", "tx").mapInPandas(run, f"image_id {kind}, {ASKED}")


def _cubic(d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    return np.where(a < 1, (a * 1.5 - 2.5) * a * a + 1.0, np.where(a < 2, ((a * -0.5 + 2.5) * a - 4.0) * a + 2.0, 0.0))


def _taken(source: np.ndarray, y0: int, x0: int, sy: np.ndarray, sx: np.ndarray, lens: Lens, bicubic: bool) -> np.ndarray:
    """Values of one channel at places: parts of a row first, then the rows."""
    iy, ix = _first(sy, lens.height), _first(sx, lens.width)
    weight = _cubic if bicubic else (lambda d: np.maximum(1.0 - np.abs(d), 0.0))
    inside = lambda v, size: np.clip(v, 0, size - 1)
    out = None
    for dy in _reach(bicubic):
        line = None
        for dx in _reach(bicubic):
            part = source[inside(iy + dy, lens.height) - y0, inside(ix + dx, lens.width) - x0] * weight(sx - ix - dx)
            line = part if line is None else line + part
        line = line * weight(sy - iy - dy)
        out = line if out is None else out + line
    return out


def warp_by(px: DataFrame, lenses: DataFrame, channels: Sequence[str], bicubic: bool = False, edge: bool = False, tile: int = TILE) -> DataFrame:
    """image_id, y, x and ``channels`` of pixels resampled by the lens of their image:
    rows of image_id, height, width, sets (1, or the number of channels), k (the sets one
    after the other, each its radial numbers and two tangential ones) and centre.

    A pixel whose place is outside takes the border's with ``edge``, else is left out;
    places that are not finite are left out. A target that takes a missing, null or NaN
    pixel is null. Images without a lens give no rows."""
    kind = px.schema["image_id"].dataType.simpleString()
    asked = asked_parts(lenses, bicubic, edge, tile)
    at = lambda c: F.expr(f"cast({c} div {tile} as long)")
    dealt = px.select("image_id", at("y").alias("ty"), at("x").alias("tx"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(c).cast("double").alias(c) for c in channels])
    names = ["image_id", *[c.split()[0] for c in PIECE.split(", ")]]

    def send(key: tuple, pixels: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        _, ty, tx = key
        top, left = int(ty) * tile, int(tx) * tile
        plane = np.full((len(channels), tile, tile), np.nan)
        if len(parts):
            plane[:, pixels.y.to_numpy() - top, pixels.x.to_numpy() - left] = pixels[list(channels)].to_numpy(float).T
        out = []
        for p in parts.itertuples(index=False):
            y0, x0 = max(p.y0, top), max(p.x0, left)
            block = plane[:, y0 - top : min(p.y1, top + tile - 1) - top + 1, x0 - left : min(p.x1, left + tile - 1) - left + 1]
            out.append((p.image_id, p.height, p.width, p.sets, p.k, p.centre, p.top, p.left, p.side, y0, x0, *block.shape[1:], block.tobytes()))
        return pd.DataFrame(out, columns=names)

    def make(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        image, top, left, side = key
        lens = Lens.of(pieces.iloc[0])
        y0, x0 = int(pieces.y0.min()), int(pieces.x0.min())
        box = np.full((len(channels), int((pieces.y0 + pieces.h).max()) - y0, int((pieces.x0 + pieces.w).max()) - x0), np.nan)
        for p in pieces.itertuples(index=False):
            box[:, p.y0 - y0 : p.y0 - y0 + p.h, p.x0 - x0 : p.x0 - x0 + p.w] = np.frombuffer(p.block).reshape(len(channels), p.h, p.w)
        y, x, places = lens.targets(int(top), int(left), int(side), edge)
        values = {c: _taken(box[i], y0, x0, *places[i if len(places) > 1 else 0], lens, bicubic) for i, c in enumerate(channels)}
        return pd.DataFrame({"image_id": image, "y": y, "x": x} | values)

    grid = ["image_id", "ty", "tx"]
    pieces = dealt.groupBy(*grid).cogroup(asked.groupBy(*grid)).applyInPandas(send, f"image_id {kind}, {PIECE}")
    return pieces.groupBy("image_id", "top", "left", "side").applyInPandas(make, f"image_id {kind}, y long, x long, " + ", ".join(f"{c} double" for c in channels))


def warp_lens(r: Raster, sets: Sequence[Sequence[float]], centre: tuple[float, float] = (0.5, 0.5), bicubic: bool = False, edge: bool = False, tile: int = TILE) -> Raster:
    """A raster by one lens: a set of radial and two tangential numbers for all channels,
    or a set for each."""
    if len(sets) not in (1, len(r.channels)) or len({len(s) for s in sets}) != 1 or len(sets[0]) < 3:
        raise ValueError(f"{len(sets)} sets of coefficients do not fit {len(r.channels)} channels")
    flat = F.lit([float(v) for s in sets for v in s])
    lenses = r.df.select("image_id").distinct().select("image_id", F.lit(r.height).alias("height"), F.lit(r.width).alias("width"), F.lit(len(sets)).alias("sets"), flat.alias("k"), F.lit([float(v) for v in centre]).alias("centre"))
    return Raster(warp_by(r.df, lenses, r.channels, bicubic, edge, tile), r.height, r.width, r.channels, r.y0, r.x0)
