"""Rendering: the stages from sensor values to display values.

Stages only extend the plan; Spark sees the whole of it at the action, prunes
columns, fuses projections and picks the exchanges of the stencils."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroom.functions import colour, points
from sparkroom.operators import geometry, opcodes, stencil
from sparkroom.operators.raster import Raster
from sparkroom.sources import views

STAGES = ("raw", "linearized", "linearized-plus-ops", "camera-rgb", "cropped", "display")


@dataclass
class Settings:
    black: Sequence[Sequence[float]] = ((0.0,),)
    white: float = 1.0
    table: Sequence[float] | None = None
    pattern: str | None = "RGGB"
    algorithm: str = "bilinear"
    opcodes2: Sequence[dict] = ()
    opcodes3: Sequence[dict] = ()
    crop: tuple[int, int, int, int] | None = None
    camera_to_prophoto: Sequence[Sequence[float]] = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    hue_map: Callable[[Raster], Raster] | None = None
    exposure: float = 0.0
    shadows: float = 5.0
    look: Callable[[Raster], Raster] | None = None
    #: Samples over [0, 1]; None for a straight line.
    curve: Sequence[float] | None = field(default_factory=colour.default_tone)
    orientation: int = 1
    extra: dict = field(default_factory=dict)


def render(r: Raster, s: Settings, until: str = "display") -> Raster:
    """The raster after the stage ``until``."""
    if until not in STAGES:
        raise ValueError(f"no stage {until!r}")
    steps = STAGES.index(until)
    if steps >= 1:
        r = opcodes.linearize(r, s.black, s.white, table=s.table)
    if steps >= 2:
        r = opcodes.apply_opcodes(r, s.opcodes2)
    if steps >= 3:
        if s.pattern and len(r.channels) == 1:
            r = stencil.demosaic(r, s.pattern, s.algorithm)
        r = opcodes.apply_opcodes(r, s.opcodes3)
    if steps >= 4 and s.crop:
        r = geometry.crop(r, *s.crop)
    return show(r, s) if steps >= 5 else r


def show(r: Raster, s: Settings) -> Raster:
    """Camera values to display values: ProPhoto, the profile's map, exposure, its look,
    the tone curve, and only then the display's gamut."""
    tone = (lambda v: points.lut(v, s.curve)) if s.curve is not None else (lambda v: v)
    expose = lambda v: points.exposure_ramp(v, s.exposure, s.shadows)
    darken = (lambda v: points.exposure_tone(v, s.exposure)) if s.exposure < 0 else (lambda v: v)
    if len(r.channels) != 3:
        return geometry.orient(r.map(lambda v: points.srgb_gamma(tone(darken(expose(v))))), s.orientation)
    r = r.map_rgb(lambda a, b, c: points.matrix3(s.camera_to_prophoto, a, b, c))
    r = s.hue_map(r) if s.hue_map else r
    r = r.map(expose)
    r = s.look(r) if s.look else r
    r = r.map(darken).map_rgb(lambda a, b, c: points.hue_tone(a, b, c, tone))
    r = r.map_rgb(lambda a, b, c: points.matrix3(colour.prophoto_to_srgb().tolist(), a, b, c))
    return geometry.orient(r.map(lambda v: points.srgb_gamma(points.clamp(v))), s.orientation)


FLAGSHIP = Settings(black=((0.01, 0.02), (0.03, 0.015)), camera_to_prophoto=((1.6, -0.4, -0.2), (-0.3, 1.5, -0.2), (0.05, -0.45, 1.4)), exposure=-0.25)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaic to 8-bit display values, and their count, mean and largest value
    in each channel."""
    done = render(views.cfa(spark, sf_dir), FLAGSHIP)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), points.quantize(F.col(c), 255).alias("u")) for c in done.channels]))
    return done.df.select(cells.alias("p")).groupBy("p.c").agg(F.count("*").alias("n"), F.round(F.avg("p.u"), 6).alias("mean"), F.max("p.u").alias("top"))


#: Operators of a node list by name.
NODES = {
    "sub_scalar": lambda r, k: r - k,
    "mul_scalar": lambda r, k: r * k,
    "crop": lambda r, **a: geometry.crop(r, **a),
    "orientation": lambda r, code: geometry.orient(r, code),
    "matrix_3x3": lambda r, m: r.map_rgb(lambda a, b, c: points.matrix3(m, a, b, c)),
    "lut": lambda r, table: r.map(lambda v: points.lut(v, table)),
    "bilinear_demosaic": lambda r, pattern: stencil.demosaic(r, pattern, "bilinear"),
    "ea_demosaic": lambda r, pattern, fast=False: stencil.demosaic(r, pattern, "ea_fast" if fast else "ea"),
    "cast_dtype": lambda r, dtype: r.map(lambda v: v.cast(dtype)),
    "opcodes": lambda r, items: opcodes.apply_opcodes(r, items),
}


def apply_nodes(r: Raster, nodes: Sequence[dict]) -> Raster:
    """A list of named operators with their arguments, as one plan."""
    for node in nodes:
        args = dict(node)
        name = args.pop("op")
        if name not in NODES:
            raise ValueError(f"UNKNOWN_OP {name!r}")
        r = NODES[name](r, **args)
    return r
