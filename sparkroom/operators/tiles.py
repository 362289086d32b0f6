"""Tiles with a halo, for stencils too wide for windows.

A pixel goes to its tile and to those whose halo holds it, so tiles are grouped
once, each a bounded array, and a crop after a stencil gives what the stencil
gives on the whole image."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkroom.operators.raster import RGB, Raster
from sparkroom.operators.stencil import PATTERNS

TILE = 256


def map_tiles(r: Raster, run: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], channels: tuple[str, ...], halo: int, tile: int = TILE) -> Raster:
    """``run(mosaic, y, x)`` on each tile with its halo; it returns arrays of the
    same shape. The mosaic has NaN where the image ends; y and x are the place of
    its first pixel."""
    r.need(1)
    near = lambda c, size: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile)), F.least(F.lit((size - 1) // tile), F.floor((F.col(c) + halo) / tile)))
    dealt = r.df.select("image_id", "y", "x", "v").withColumn("ty", F.explode(near("y", r.height))).withColumn("tx", F.explode(near("x", r.width)))
    kind = r.df.schema["image_id"].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, ty, tx = key
        y0, x0 = int(ty) * tile - halo, int(tx) * tile - halo
        plane = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        plane[pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0] = pdf.v.to_numpy()
        made = run(plane, y0, x0)
        inner = (slice(halo, halo + tile),) * 2
        yy, xx = np.nonzero(~np.isnan(plane[inner]))
        return pd.DataFrame({"image_id": image, "y": yy + int(ty) * tile, "x": xx + int(tx) * tile} | {c: made[c][inner][yy, xx] for c in channels})

    df = dealt.groupBy("image_id", "ty", "tx").applyInPandas(one, f"image_id {kind}, y long, x long, " + ", ".join(f"{c} double" for c in channels))
    return replace(r, df=df, channels=channels)


def _shift(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a at (y + dy, x + dx); NaN beyond."""
    out = np.full_like(a, np.nan)
    h, w = a.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _means(*planes: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        stack = np.stack(planes)
        n = (~np.isnan(stack)).sum(0)
        return np.where(n, np.nansum(stack, 0) / np.maximum(n, 1), np.nan)


def vng(plane: np.ndarray, y0: int, x0: int, pattern: str) -> dict[str, np.ndarray]:
    """Variable number of gradients: of eight directions those with a gradient up
    to 1.5 min + 0.5 (max - min) give their mean difference between colours."""
    yy, xx = np.indices(plane.shape)
    colour = np.array(list(pattern))[((yy + y0) % 2) * 2 + (xx + x0) % 2]
    full = {}
    for c in "RGB":
        known = np.where(colour == c, plane, np.nan)
        side = _means(*[_shift(known, dy, dx) for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0))])
        diagonal = _means(*[_shift(known, dy, dx) for dy, dx in ((-1, -1), (-1, 1), (1, -1), (1, 1))])
        full[c] = np.where(np.isnan(known), np.where(np.isnan(side), diagonal, side), known)
        full[c][np.isnan(plane)] = np.nan  # nothing stands beyond the image
    own = np.select([colour == c for c in "RGB"], [full[c] for c in "RGB"])
    directions = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    gradient = np.stack([np.nan_to_num(np.abs(_shift(plane, dy, dx) - _shift(plane, -dy, -dx))) + np.nan_to_num(np.abs(_shift(plane, 2 * dy, 2 * dx) - plane)) for dy, dx in directions])
    low, high = gradient.min(0), gradient.max(0)
    chosen = gradient <= 1.5 * low + 0.5 * (high - low)
    out = {}
    for name, c in zip(RGB, "RGB"):
        parts = np.stack([np.where(chosen[i], _shift(full[c], dy, dx) - _shift(own, dy, dx), np.nan) for i, (dy, dx) in enumerate(directions)])
        n = (~np.isnan(parts)).sum(0)
        difference = np.where(n, np.nansum(parts, 0) / np.maximum(n, 1), full[c] - own)
        out[name] = np.clip(np.where(colour == c, plane, plane + difference), 0, 1)
    return out


def demosaic_vng(r: Raster, pattern: str = "RGGB", tile: int = TILE) -> Raster:
    if pattern not in PATTERNS:
        raise ValueError(f"no pattern {pattern!r}")
    return map_tiles(r, lambda plane, y, x: vng(plane, y, x, pattern), RGB, halo=3, tile=tile)
