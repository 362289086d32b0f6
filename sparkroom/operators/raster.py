"""A raster: pixel rows and what is known of their shape.

Pixels are rows (image_id, y, x, c, v), or (image_id, y, x, r, g, b) where the
channels of a pixel are used together. A ``Raster`` adds height, width, channels
and a world origin, checks arguments when an operator is applied, and leaves the
work to Spark's plan. Rasters are never joined implicitly, so arithmetic between
two of them is a ``TypeError``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


@dataclass(frozen=True)
class Raster:
    df: DataFrame
    height: int
    width: int
    channels: tuple[str, ...] = ("v",)
    y0: int = 0
    x0: int = 0

    def __post_init__(self) -> None:
        missing = {"image_id", "y", "x", *self.channels} - set(self.df.columns)
        if missing:
            raise ValueError(f"pixel rows lack {sorted(missing)}")

    def need(self, channels: int) -> None:
        if len(self.channels) != channels:
            raise ValueError(f"expected {channels} channel{'s' * (channels > 1)}, got {len(self.channels)}")

    def map(self, change, **attrs) -> Raster:
        """Every channel through an expression."""
        if attrs:
            raise TypeError(f"unknown attrs {sorted(attrs)}")
        return replace(self, df=self.df.withColumns({c: change(F.col(c)) for c in self.channels}))

    def map_rgb(self, change) -> Raster:
        """The three channels of a pixel through a function of three columns."""
        self.need(3)
        new = change(*[F.col(c) for c in self.channels])
        return replace(self, df=self.df.withColumns(dict(zip(self.channels, new))))

    def __add__(self, k):
        return self.map(lambda v: v + _number(k))

    def __sub__(self, k):
        return self.map(lambda v: v - _number(k))

    def __mul__(self, k):
        return self.map(lambda v: v * _number(k))


def _number(k) -> float:
    if isinstance(k, (Raster, DataFrame, Column)) or not isinstance(k, (int, float)):
        raise TypeError("a raster takes numbers only")
    return float(k)
