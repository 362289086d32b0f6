"""File jobs: open, render, encode, write, with each file's status in its row.

Files come as rows of path and content (``binaryFile``). What a file's tags say, its
levels, pattern, crop, orientation, opcodes and colour, becomes a row of typed columns;
these rows, one a file, are kept in the shared folder and joined to the pixels, so that
any mixture of files is one plan with one reading of the contents (two, where some are
mosaics and others are not). Up to ``BROADCAST_FILES`` rows are broadcast; beyond,
pixels are shuffled by file, of which a task holds each whole at reading anyway."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkroom.functions import colour, points
from sparkroom.operators import geometry, lens, stencil
from sparkroom.operators.raster import RGB, Raster
from sparkroom.sources import opcode_lists, tiff
from sparkroom.sources.files import by_bytes, by_steps, shared_dir

# Codes of the tags that say how to render a page.
ORIENTATION, CFA_PATTERN, TABLE, BLACK_DIM, BLACK, DELTA_H, DELTA_V, WHITE, CROP_AT, CROP_SIZE = 274, 33422, 50712, 50713, 50714, 50715, 50716, 50717, 50719, 50720
COLOUR1, COLOUR2, CALIBRATION1, CALIBRATION2, BALANCE, NEUTRAL, WHITE_XY, EXPOSURE, SHADOW_SCALE, ILLUMINANT1, ILLUMINANT2 = 50721, 50722, 50723, 50724, 50727, 50728, 50729, 50730, 50739, 50778, 50779
TONE, FORWARD1, FORWARD2, OPCODES2, OPCODES3, EXPOSURE_OFFSET, BLACK_RENDER = 50940, 50964, 50965, 51009, 51022, 51109, 51110
PREVIEW_SUBTYPE = 1

#: Files up to which their rows of parameters are broadcast (some hundred bytes each).
BROADCAST_FILES = 100_000
#: Entries of a file's tone curve after sampling it anew.
TONE_SIZE = 256
SHADOWS = 5.0

LISTS = {"colour1": COLOUR1, "colour2": COLOUR2, "calibration1": CALIBRATION1, "calibration2": CALIBRATION2, "balance": BALANCE, "neutral": NEUTRAL, "white_xy": WHITE_XY, "forward": FORWARD1, "forward2": FORWARD2, "curve": TONE}
NUMBERS = {"illuminant1": ILLUMINANT1, "illuminant2": ILLUMINANT2, "exposure": EXPOSURE, "exposure_offset": EXPOSURE_OFFSET, "shadow_scale": SHADOW_SCALE, "black_render": BLACK_RENDER}


def pages_of(files: DataFrame) -> DataFrame:
    """A row for each page: path, ifd, its shape and role (cfa, linear, rgb or gray),
    levels, opcodes and colour, and what is wrong with its pixels. Colour that a page
    does not state is the first page's. Files that cannot be read have one row."""
    t = tiff.tags_of(files, check=True).where("place = 'ifd' or place is null")
    all_ = lambda code: F.max(F.when(F.col("code") == code, F.col("value")))
    one = lambda code: F.get(all_(code), F.lit(0))
    list_ = lambda code: F.max(F.when(F.col("code") == code, F.col("ops")))
    kind = one(tiff.PHOTOMETRIC).cast("int")
    letters = F.transform(all_(CFA_PATTERN), lambda v: F.get(F.lit(["R", "G", "B"]), v.cast("int")))
    role = F.when(kind == tiff.CFA, "cfa").when(kind == tiff.LINEAR_RAW, "linear").when(kind.isin(tiff.RGB_KIND, 6), "rgb").otherwise("gray")
    full = F.when(one(tiff.FORMAT) == 3, 1.0).otherwise(F.pow(F.lit(2.0), one(tiff.BITS)) - 1)
    page = t.groupBy("path", "ifd").agg(
        one(tiff.HEIGHT).cast("int").alias("height"),
        one(tiff.WIDTH).cast("int").alias("width"),
        F.coalesce(one(tiff.SAMPLES), F.lit(1.0)).cast("int").alias("samples"),
        F.coalesce(one(tiff.SUBTYPE), F.lit(0.0)).cast("int").alias("subtype"),
        role.alias("role"),
        F.array_join(letters, "").alias("pattern"),
        F.coalesce(all_(BLACK), F.array(F.lit(0.0))).alias("black"),
        F.coalesce(all_(BLACK_DIM).cast("array<int>"), F.array(F.lit(1), F.lit(1))).alias("black_dim"),
        all_(DELTA_H).alias("delta_h"),
        all_(DELTA_V).alias("delta_v"),
        all_(TABLE).alias("table"),
        F.coalesce(all_(WHITE), F.array(full)).alias("white"),
        F.coalesce(one(ORIENTATION), F.lit(1.0)).cast("int").alias("orientation"),
        F.concat(all_(CROP_AT), all_(CROP_SIZE)).cast("array<int>").alias("crop"),
        list_(OPCODES2).alias("ops2"),
        list_(OPCODES3).alias("ops3"),
        *[all_(code).alias(f"_{name}") for name, code in LISTS.items()],
        *[one(code).alias(f"_{name}") for name, code in NUMBERS.items()],
        F.max("error").alias("error"),
    )
    first = Window.partitionBy("path")
    from_first = lambda c: F.coalesce(F.col(c), F.max(F.when(F.col("ifd") == 0, F.col(c))).over(first))
    return page.withColumns({c: from_first(f"_{c}") for c in (*LISTS, *NUMBERS)}).drop(*[f"_{c}" for c in (*LISTS, *NUMBERS)])


def _largest(pages: DataFrame) -> DataFrame:
    """The largest page of each file among ``pages``, the first of equal ones."""
    best = F.max_by(F.struct(*pages.columns), F.struct(F.col("height").cast("long") * F.col("width"), -F.col("ifd")))
    return pages.where("ifd is not null").groupBy("path").agg(best.alias("p")).select("p.*")


def main_pages(pages: DataFrame) -> DataFrame:
    """The page that a file is about: of sub-file type 0, raw ones before others."""
    raw = pages.where("subtype = 0").withColumn("other", ~F.col("role").isin("cfa", "linear"))
    least = raw.groupBy("path").agg(F.min("other").alias("least"))
    return _largest(raw.join(least, "path").where("other = least").drop("other", "least"))


def _with_status(files: DataFrame, chosen: DataFrame, missing: str, pages: DataFrame) -> DataFrame:
    """path, status and error of every file: that of its chosen page, or of the file, or
    that there is no such page."""
    whole = pages.where("ifd is null").groupBy("path").agg(F.max("error").alias("_whole"))
    found = chosen.select("path", F.lit(True).alias("_found"), F.col("error").alias("_error"))
    joined = files.select("path").join(found, "path", "left").join(whole, "path", "left")
    error = F.coalesce("_error", "_whole", F.when(F.col("_found").isNull(), F.lit(missing)))
    return joined.select("path", F.when(error.isNull(), "ok").otherwise("errored").alias("status"), error.alias("error"))


def _warps() -> Column:
    """Number of lens warps in the third list of opcodes of a page."""
    return F.coalesce(F.size(F.filter("ops3", lambda o: o["id"] == opcode_lists.WARP)), F.lit(0))


@dataclass
class Chosen:
    """Rows of parameters, one a file, kept in the shared folder, and what is known of all."""

    rows: DataFrame
    count: int
    height: int
    cfa: bool
    other: bool
    opcodes: bool
    #: The most lens warps of any file's third list, and whether some file has none.
    warps: int
    unwarped: bool

    def side(self, *columns: str) -> DataFrame:
        """The rows as the small side of a join."""
        some = self.rows.select(*columns)
        return F.broadcast(some) if self.count <= BROADCAST_FILES else some


def settled(rows: DataFrame) -> Chosen:
    """``rows`` with a number for each file, computed once."""
    shared_dir(rows.sparkSession)
    kept = rows.withColumn("image_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    s = kept.agg(F.count("*").alias("n"), F.max("height").alias("h"), F.coalesce(F.bool_or(F.col("role") == "cfa"), F.lit(False)).alias("cfa"), F.coalesce(F.bool_or(F.col("role") != "cfa"), F.lit(False)).alias("other"), F.coalesce(F.bool_or(F.col("ops2").isNotNull() | F.col("ops3").isNotNull()), F.lit(False)).alias("ops"), F.max(F.when(F.col("error").isNull(), _warps())).alias("warps"), F.coalesce(F.bool_or(_warps() == 0), F.lit(False)).alias("unwarped")).first()
    return Chosen(kept, s.n, s.h or 0, s.cfa, s.other, s.ops, s.warps or 0, s.unwarped)


def with_opcodes(pages: DataFrame) -> DataFrame:
    """Pages whose opcode lists need what is not here get that as their error."""
    refused = F.concat(*[F.coalesce(opcode_lists.refused(F.col(c), taken), F.array().cast("array<int>")) for c, taken in (("ops2", opcode_lists.POINTWISE), ("ops3", (*opcode_lists.POINTWISE, opcode_lists.WARP)))])
    needs = F.when(F.size(refused) > 0, F.concat(F.lit("opcodes not taken: "), F.array_join(refused.cast("array<string>"), ", ")))
    return pages.withColumn("error", F.coalesce("error", needs))


LEVELS = ("path", "image_id", "height", "width", "samples", "role", "pattern", "black", "black_dim", "delta_h", "delta_v", "table", "white", "ops2")


def _samples(files: DataFrame, chosen: Chosen, cfa: bool | None = None) -> DataFrame:
    """Samples of the chosen pages with the parameters of their levels."""
    rows = chosen.rows.where("error is null")
    if cfa is not None:
        rows = rows.where((F.col("role") == "cfa") == cfa)
    some = replace(chosen, rows=rows)
    px = tiff.samples_of(files.join(some.side("path", "ifd"), "path")).where("error is null").drop("ifd", "error")
    return px.join(some.side(*LEVELS), "path")


def linear_values(px: DataFrame, opcodes: bool, names: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """Samples through their file's table, between its black and white levels, and, if
    any file has some, through the opcodes for linear values."""
    for plane, v in enumerate(names):
        stored = f"coalesce(get(table, cast(least(greatest({v}, 0D), size(table) - 1) as int)), {v})"
        black = f"(coalesce(get(black, cast(((y % black_dim[0]) * black_dim[1] + x % black_dim[1]) * samples + {plane} as int)), black[0]) + coalesce(get(delta_h, cast(x as int)), 0D) + coalesce(get(delta_v, cast(y as int)), 0D))"
        white = f"coalesce(get(white, {plane}), white[0])"
        px = px.withColumn(v, F.expr(f"least(greatest(({stored} - {black}) / ({white} - {black}), 0D), 1D)"))
    return px.withColumns({v: opcode_lists.apply(v, "ops2", i) for i, v in enumerate(names)}) if opcodes else px


def _wide(files: DataFrame, chosen: Chosen, cfa: bool | None = None) -> DataFrame:
    """path, image_id, y, x, r, g and b of the chosen pages, linear; one sample fills all."""
    # a null sample stays null, but greatest() would take the other side for it
    px = _samples(files, chosen, cfa).withColumn("_n", (F.col("b").isNotNull()).cast("int"))
    wide = linear_values(px, chosen.opcodes)
    own = lambda c: F.when(F.col("_n") == 1, F.col(c)).otherwise(F.col("a"))
    return wide.select("path", "image_id", "y", "x", F.col("a").alias("r"), own("b").alias("g"), own("c").alias("b"))


def preview_rgb(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels (path, y, x, r, g, b in [0, 1]) of each file's largest preview, or of
    its main page if that is no raw one; and the status of each file. A raw file
    without a preview is an error."""
    pages = pages_of(files)
    shown = pages.where(F.col("role").isin("rgb", "gray"))
    preview = settled(with_opcodes(_largest(shown.where((F.col("subtype") == PREVIEW_SUBTYPE) | (F.col("ifd") == 0)))))
    return _wide(files, preview).select("path", "y", "x", *RGB), _with_status(files, preview.rows, "no preview page", pages)


def linear_raw(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linear values in [0, 1] (path, y, x, r, g, b; equal for one sample) of each
    file's largest linear page, and the status of each file."""
    pages = pages_of(files)
    linear = settled(with_opcodes(_largest(pages.where("role = 'linear'"))))
    return _wide(files, linear).select("path", "y", "x", *RGB), _with_status(files, linear.rows, "no linear page", pages)


def mosaics(files: DataFrame, stage: str = "linearized") -> tuple[DataFrame, DataFrame]:
    """Mosaic values (path, y, x, v, pattern) of each file's largest mosaic page, as
    stored ("raw"), between black and white ("linearized") or also after the opcodes for
    linear values ("linearized-plus-ops"), and each file's status."""
    if stage not in ("raw", "linearized", "linearized-plus-ops"):
        raise ValueError(f"no stage {stage!r}")
    pages = pages_of(files)
    chosen = settled(with_opcodes(_largest(pages.where("role = 'cfa'"))))
    px = _samples(files, chosen)
    if stage != "raw":
        px = linear_values(px, chosen.opcodes and stage == "linearized-plus-ops", ("a",))
    return px.select("path", "y", "x", F.col("a").alias("v"), "pattern"), _with_status(files, chosen.rows, "no mosaic page", pages)


def camera_rgb(files: DataFrame, chosen: Chosen, algorithm: str = "bilinear") -> DataFrame:
    """path, image_id, y, x, r, g, b: mosaics demosaiced, linear pages as they are, before
    the opcodes of the third list."""
    parts = []
    if chosen.cfa:
        px = linear_values(_samples(files, chosen, True), chosen.opcodes, ("a",)).select("image_id", "y", "x", F.col("a").alias("v"), "pattern")
        made = stencil.demosaic(Raster(px, chosen.height, 1), F.col("pattern"), algorithm).df
        parts.append(made.join(chosen.side("path", "image_id"), "image_id").select("path", "image_id", "y", "x", *RGB))
    if chosen.other or not chosen.cfa:
        parts.append(_wide(files, chosen, False if chosen.cfa else None))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def corrected_rgb(files: DataFrame, chosen: Chosen, algorithm: str = "bilinear") -> DataFrame:
    """image_id, y, x, r, g, b: ``camera_rgb`` after the opcodes of the third list, in their
    order. Images with lens warps are resampled tile by tile, once for each warp; the
    others are not moved. Places outside of an image are those of its border."""
    if not chosen.warps:
        px = camera_rgb(files, chosen, algorithm)
        return _pointwise(px, chosen, F.col("ops3")) if chosen.opcodes else px.select("image_id", "y", "x", *RGB)
    warped = replace(chosen, rows=chosen.rows.where(_warps() > 0), unwarped=False)
    px = _pointwise(camera_rgb(files, warped, algorithm), warped, _segment(0))
    for i in range(chosen.warps):
        here = _warps() > i
        op = F.get(F.filter("ops3", lambda o: o["id"] == opcode_lists.WARP), F.lit(i))
        lenses = warped.rows.where(here & F.col("error").isNull()).select("image_id", "height", "width", F.get(op["grid"], F.lit(0)).alias("sets"), op["k"].alias("k"), op["centre"].alias("centre"))
        if i:  # images whose warps are done stay as they are
            px = px.checkpoint()
            which = warped.side("image_id", here.alias("_more"))
            flagged = px.join(which, "image_id")
            rest = flagged.where("not _more").drop("_more")
            px = rest.unionByName(_pointwise(lens.warp_by(flagged.where("_more"), lenses, RGB, edge=True), warped, _segment(i + 1)))
        else:
            px = _pointwise(lens.warp_by(px, lenses, RGB, edge=True), warped, _segment(1))
    if chosen.unwarped:
        others = replace(chosen, rows=chosen.rows.where(_warps() == 0), warps=0)
        px = px.unionByName(corrected_rgb(files, others, algorithm))
    return px


def _segment(i: int) -> Column:
    """The opcodes of the third list between warp i - 1 and warp i; none beyond the last."""
    places = f"filter(transform(ops3, (o, j) -> if(o.id = {opcode_lists.WARP}, j, null)), j -> j is not null)"
    start = f"coalesce(get({places}, {i - 1}), -1)" if i else "-1"
    there = f"size({places}) >= {i}"
    return F.expr(f"case when {there} then slice(ops3, {start} + 2, coalesce(get({places}, {i}), size(ops3)) - {start} - 1) end")


def _pointwise(px: DataFrame, chosen: Chosen, ops: Column) -> DataFrame:
    """Pixels through opcodes that change values where they stand."""
    side = px.select("image_id", "y", "x", *RGB).join(chosen.side("image_id", "height", "width", ops.alias("_ops")), "image_id")
    return side.select("image_id", "y", "x", *[opcode_lists.apply(c, "_ops", i).alias(c) for i, c in enumerate(RGB)])


def camera_images(files: DataFrame, algorithm: str = "bilinear") -> tuple[DataFrame, DataFrame]:
    """Camera values (path, y, x, r, g, b) of the main page of each file after all its
    opcodes, and the status of each file."""
    pages = pages_of(files)
    chosen = settled(with_opcodes(main_pages(pages)))
    px = corrected_rgb(files, chosen, algorithm).join(chosen.side("image_id", "path"), "image_id")
    return px.select("path", "y", "x", *RGB), _with_status(files, chosen.rows, "no page to show", pages)


def _looks(rows: pd.DataFrame) -> pd.DataFrame:
    at = np.linspace(0, 1, TONE_SIZE)
    out = []
    some = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else v
    for r in rows.itertuples(index=False):
        white = None if pd.isna(r.Temperature) else colour.xy_of_uv(*colour.uv_of_temperature(r.Temperature, 0.0 if pd.isna(r.Tint) else r.Tint))
        neutral, curve = some(r.neutral), some(r.curve)
        if white is None and neutral is None and some(r.white_xy) is not None:
            white = tuple(r.white_xy)
        codes = (17 if pd.isna(r.illuminant1) else r.illuminant1, 21 if pd.isna(r.illuminant2) else r.illuminant2)
        m = colour.working_matrix(some(r.colour1), some(r.colour2), codes, neutral, some(r.forward), some(r.balance), white, (some(r.calibration1), some(r.calibration2)), some(r.forward2))
        tone = None if curve is None else np.interp(at, *np.reshape(np.asarray(curve, float), (-1, 2)).T).tolist()
        out.append((m.reshape(-1).tolist(), tone))
    return pd.DataFrame(out, columns=["m", "tone"])


def file_looks() -> Column:
    """m (nine numbers, camera to linear ProPhoto RGB) and tone (the file's own curve,
    sampled anew, or null) of the columns of ``pages_of`` and of Temperature and Tint;
    files are few against pixels, so this may be Python."""
    names = ("colour1", "colour2", "calibration1", "calibration2", "illuminant1", "illuminant2", "neutral", "white_xy", "forward", "forward2", "balance", "curve", "Temperature", "Tint")
    return F.pandas_udf(_looks, "m array<double>, tone array<double>")(F.struct(*names))


# Columns of a settings file and their types.
SETTINGS = {"Temperature": "double", "Tint": "double", "Exposure2012": "double", "orientation": "int"}


def _with_settings(mains: DataFrame, settings: DataFrame | None) -> DataFrame:
    """Pages with their settings: by path, or by file name where ``settings`` has
    ``filename``. What a file has no setting for is as its tags say."""
    stated = mains.withColumn("exposure", F.coalesce("exposure", F.lit(0.0)) + F.coalesce("exposure_offset", F.lit(0.0)))
    if settings is None:
        return stated.withColumns({k: F.lit(None).cast(t) for k, t in SETTINGS.items() if k in ("Temperature", "Tint")})
    own = [(F.col(k) if k in settings.columns else F.lit(None)).cast(t).alias(f"_{k}") for k, t in SETTINGS.items()]
    if "filename" in settings.columns:
        named = stated.withColumn("_name", F.regexp_extract("path", r"([^/]*)$", 1))
        joined = named.join(settings.select(F.col("filename").alias("_name"), *own), "_name", "left").drop("_name")
    else:
        joined = stated.join(settings.select("path", *own), "path", "left")
    given = {"exposure": F.coalesce("_Exposure2012", "exposure"), "orientation": F.coalesce("_orientation", "orientation"), "Temperature": F.col("_Temperature"), "Tint": F.col("_Tint")}
    return joined.withColumns(given).drop(*[f"_{k}" for k in SETTINGS])


def turned() -> tuple[Column, Column]:
    """Row and column by the orientation, height and width of each row's own; unknown
    codes change nothing."""
    text = {"y": "y", "x": "x", "h-y": "height - 1 - y", "w-x": "width - 1 - x"}
    case = lambda i, other: "case orientation " + " ".join(f"when {k} then {text[at[i]]}" for k, at in geometry.ORIENT.items()) + f" else {other} end"
    return F.expr(case(0, "y")), F.expr(case(1, "x"))


def shown_rgb(px: DataFrame) -> DataFrame:
    """Camera values r, g and b to display values in the order of the rendering document:
    ProPhoto, exposure, tone curve, and the display's gamut last. Each row has its matrix
    m, exposure, shadows and tone. Steps are projections of their own, so that no value
    is computed anew for each use."""
    cell = [[F.get("m", F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    each = lambda df, f: df.withColumns({c: f(F.col(c)) for c in RGB})
    e = F.col("exposure")
    px = by_steps(px).withColumns(dict(zip(RGB, points.matrix3(cell, *[F.col(c) for c in RGB]))))
    px = each(px, lambda v: points.exposure_ramp(v, e, F.col("shadows")))
    px = each(px, lambda v: points.exposure_tone(v, e))
    px = px.withColumns({"_top": F.greatest(*RGB), "_low": F.least(*RGB)})
    px = px.withColumns({"_new_top": points.lut_column(F.col("_top"), F.col("tone")), "_new_low": points.lut_column(F.col("_low"), F.col("tone"))})
    part = lambda c: F.when(F.col("_top") > F.col("_low"), (c - F.col("_low")) / F.nullif(F.col("_top") - F.col("_low"), F.lit(0.0))).otherwise(F.lit(0.0))
    px = each(px, lambda c: F.col("_new_low") + (F.col("_new_top") - F.col("_new_low")) * part(c))
    px = px.withColumns(dict(zip(RGB, points.matrix3(colour.prophoto_to_srgb().tolist(), *[F.col(c) for c in RGB]))))
    return each(each(px, points.clamp), points.srgb_gamma).drop("_top", "_low", "_new_top", "_new_low")


def render_files(files: DataFrame, settings: DataFrame | None = None, algorithm: str = "bilinear", shadows: float = SHADOWS, curve: list[float] | str | None = "default") -> tuple[DataFrame, DataFrame]:
    """Display values (path, y, x, r, g, b in [0, 1]) of the main page of each file,
    and path, status and error of every file.

    ``settings`` overrides by ``path`` or ``filename``: columns Temperature, Tint,
    Exposure2012 and orientation, where not null. ``curve`` is the tone curve (samples
    over [0, 1]) of files that bring none, or None for a straight line. Pages that are
    no raw ones are shown as they are."""
    shared_dir(files.sparkSession)
    pages = pages_of(files).checkpoint()  # for the pixels and for the status: contents are parsed for them once
    default = colour.default_tone() if curve == "default" else curve
    level = F.when(F.coalesce("black_render", F.lit(0.0)) == 1, 0.0).otherwise(F.coalesce("shadow_scale", F.lit(1.0)) * float(shadows))
    straight = F.lit([float(v) for v in default]) if default is not None else F.lit(None).cast("array<double>")
    mains = with_opcodes(_with_settings(main_pages(pages), settings)).withColumns({"look": file_looks(), "shadows": level})
    chosen = settled(mains)
    px = corrected_rgb(files, chosen, algorithm).join(chosen.side("image_id", "path", "role", "height", "width", "crop", "orientation", "look", "exposure", "shadows"), "image_id")
    px = px.withColumns({"m": F.col("look.m"), "tone": F.coalesce("look.tone", straight)}).drop("look")
    h, w, y, x = (F.col(c) for c in ("height", "width", "y", "x"))
    left, top, cw, ch = (F.get("crop", F.lit(i)) for i in range(4))
    inside = F.col("crop").isNull() | ((x >= left) & (x < left + cw) & (y >= top) & (y < top + ch))
    cut = px.where(inside).withColumns({"y": y - F.coalesce(top, F.lit(0)), "x": x - F.coalesce(left, F.lit(0)), "height": F.coalesce(ch, h), "width": F.coalesce(cw, w)})
    raw = F.col("role").isin("cfa", "linear")
    made = shown_rgb(cut.withColumns({f"_{c}": F.col(c) for c in RGB}))
    row, column = turned()
    shown = made.select("path", row.alias("y"), column.alias("x"), *[F.when(raw, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in RGB])
    return shown, _with_status(files, chosen.rows, "no page to show", pages)


def _quantized(pixels: DataFrame, channels: tuple[str, ...], top: int) -> DataFrame:
    return pixels.select(F.col("path").alias("image_id"), "y", "x", *[points.quantize(F.col(c), top).alias(c) for c in channels])


def kept_tags(files: DataFrame, dropped: tuple[int, ...] = (), highest: int = 65_535) -> DataFrame:
    """Tags (``tiff.NEW_TAGS``, all of page 0) that a copy keeps: those of the file's
    first page, and of its EXIF and GPS directories, but what says how pixels are stored,
    the ``dropped`` codes, and codes over ``highest``."""
    t = tiff.tags_of(files).where((F.col("ifd") == 0) & F.col("code").isNotNull() & F.col("dtype").isin(*tiff.TYPES))
    own = t.where((F.col("place") != "ifd") | (~F.col("code").isin(*tiff.STRUCTURE, *dropped) & (F.col("code") <= highest)))
    return own.select(F.col("path").alias("image_id"), F.lit(0).alias("page"), "place", "code", "dtype", "value", "text")


#: Tags that a rendered copy has used up: orientation and pattern; and the first of the raw ones.
USED, RAW_FROM = (ORIENTATION, 33421, CFA_PATTERN), 50_706


def encode_rgb(pixels: DataFrame, bits: int = 8, tags: DataFrame | None = None) -> DataFrame:
    """path and content of an RGB container of each image."""
    page = tiff.PageRows(_quantized(pixels, RGB, 2**bits - 1), RGB, "u1" if bits == 8 else "u2")
    return tiff.encode_pages([page], tags=tags).withColumnRenamed("image_id", "path")


#: Tags that no longer hold for values between black and white, in a copy of them.
LEVEL_TAGS = (TABLE, BLACK_DIM, BLACK, DELTA_H, DELTA_V, WHITE, OPCODES2)


def copy_pages(files: DataFrame, levels: int = 0, preview: bool = True, least: int = geometry.MIN_LEVEL, source: int = geometry.MIN_SOURCE, demosaic: str | None = None, drop: tuple[int, ...] = (), extra: DataFrame | None = None) -> DataFrame:
    """path and content of copies of files' linear pages, of any mixture of sizes: 16
    bits, up to ``levels`` halvings as further raw pages (of sources of ``source``
    pixels, down to ``least``), and a rendered preview, full, half or a quarter of the
    size. With ``demosaic``, an algorithm, mosaics are copied as linear pages too.

    Copies keep their source's tags, but those that the stored values have used up and
    ``drop``; rows of ``extra`` (``tiff.NEW_TAGS``, by path in image_id) are laid over."""
    pages = pages_of(files)
    raw = pages.where(F.col("role").isin("cfa", "linear") if demosaic else F.col("role") == "linear")
    chosen = settled(with_opcodes(_largest(raw)).where("error is null"))
    full = camera_rgb(files, chosen, demosaic or "bilinear").withColumn("image_id", F.col("path"))
    r = Raster(full, 1, 1, RGB)
    wanted = max(levels, 2 if preview else 0)
    small = F.least("height", "width")
    fitting = chosen.side("path", "height", "width").withColumn("small", small)
    sizes = {0: r}
    for level in range(1, wanted + 1):
        sizes[level] = _halved(sizes[level - 1], fitting, level)
    kept = lambda level: (F.col("small") >= source) & (F.floor(F.col("small") / 2**level) >= least)
    shown_at = F.when(F.col("small") >= 4 * least, 2).when(F.col("small") >= 2 * least, 1).otherwise(0)
    of = lambda level, which: sizes[level].df.join(fitting.where(which).select("path"), "path")
    page = lambda df, top, dtype, tags: tiff.PageRows(_quantized(df.select("path", "y", "x", *RGB), RGB, top), RGB, dtype, tags=tags)
    raw_kind = {tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,))}
    made = [page(r.df, 65535, "u2", raw_kind)]
    made += [page(of(level, kept(level)), 65535, "u2", raw_kind | {tiff.SUBTYPE: (4, (PREVIEW_SUBTYPE,))}) for level in range(1, levels + 1)]
    if preview:
        views = [of(level, shown_at == level).select("path", "y", "x", *[points.srgb_gamma(F.col(c)).alias(c) for c in RGB]) for level in range(3)]
        made.append(page(views[0].unionByName(views[1]).unionByName(views[2]), 255, "u1", {tiff.SUBTYPE: (4, (PREVIEW_SUBTYPE,))}))
    tags = kept_tags(files, (*LEVEL_TAGS, *((33421, CFA_PATTERN) if demosaic else ()), *drop))
    if extra is not None:
        tags = tags.join(extra.select("image_id", "page", "place", "code"), ["image_id", "page", "place", "code"], "left_anti").select(*tiff.NEW_TAGS).unionByName(extra.select(*tiff.NEW_TAGS))
    return tiff.encode_pages(made, tags=tags).withColumnRenamed("image_id", "path")


def _halved(r: Raster, sizes: DataFrame, level: int) -> Raster:
    """Halvings of images of different sizes: an odd last row or column is left out."""
    even = r.df.join(sizes.select("path", *[F.floor(F.col(c) / 2**level).alias(f"_{c}") for c in ("height", "width")]), "path")
    whole = even.where((F.col("y") < F.col("_height") * 2) & (F.col("x") < F.col("_width") * 2)).drop("_height", "_width", "path")
    made = geometry.halve(Raster(whole, 2**30, 2**30, RGB))
    return Raster(made.df.withColumn("path", F.col("image_id")), 1, 1, RGB)


def output_names(files: DataFrame, suffix: str, root: str | None = None) -> DataFrame:
    """path and name of each file's output: its path below ``root`` (or below the folder
    that all share) with another suffix. Where that gives equal names, the old suffix
    stays in them; names that are still equal are null."""
    if root is None:
        ends = files.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
        same = next((i for i, (a, b) in enumerate(zip(ends.a or "", ends.b or "")) if a != b), len(ends.a or ""))
        root = (ends.a or "")[:same].rpartition("/")[0]
    below = F.when(F.startswith("path", F.lit(root)), F.ltrim(F.substring("path", len(root) + 1, 1 << 30), F.lit("/"))).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    stem = F.regexp_replace(below, r"\.[^./]*$", "")
    taken = lambda c: F.count("*").over(Window.partitionBy(c))
    short = files.select("path", below.alias("below"), F.concat(stem, F.lit(suffix)).alias("name"))
    long = short.withColumn("name", F.when(taken("name") > 1, F.concat("below", F.lit(suffix))).otherwise(F.col("name")))
    return long.select("path", F.when(taken("name") == 1, F.col("name")).alias("name"))


def write_files(contents: DataFrame, folder: str, names: DataFrame | None = None, suffix: str = ".tif") -> DataFrame:
    """Write each row's content (path, content) under ``folder`` by ``names`` (of
    ``output_names``); name, bytes, status and error of each.

    A file is written under a name of its own and then moved, so that a task that
    runs twice leaves one whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            out = []
            for path, name, content in zip(pdf.path, pdf.name, pdf.content):
                if name is None:
                    out.append((path, None, 0, "errored", "its output's name is another's too"))
                    continue
                inside, _, last = f"{root}/{name}".rpartition("/")
                part = f"{inside}/.{last}.{uuid.uuid4().hex}"
                try:
                    store.create_dir(inside, recursive=True)
                    with store.open_output_stream(part) as sink:
                        sink.write(bytes(content))
                    store.move(part, f"{inside}/{last}")
                    out.append((path, name, len(content), "written", None))
                except OSError as e:
                    out.append((path, name, 0, "errored", str(e)))
            yield pd.DataFrame(out, columns=["path", "name", "bytes", "status", "error"])

    named = contents.select("path", "content").join(output_names(contents, suffix) if names is None else names, "path")
    return by_bytes(named.select("path", "name", "content")).mapInPandas(run, "path string, name string, bytes long, status string, error string")


def written_status(status: DataFrame, written: DataFrame) -> DataFrame:
    """path, status and error of a job: what went wrong before writing, or at it."""
    result = status.join(written.select("path", F.col("status").alias("_s"), F.col("error").alias("_e")), "path", "left")
    done = result.select("path", F.when(F.col("status") == "ok", F.coalesce("_s", F.lit("errored"))).otherwise(F.col("status")).alias("status"), F.coalesce("error", "_e", F.when(F.col("_s").isNull(), F.lit("no pixels"))).alias("error"))
    return done.withColumn("error", F.when(F.col("status") != "written", F.col("error")))


def without_existing(files: DataFrame, names: DataFrame, existing: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Files still to be done, and the status of those whose output's name, suffix aside,
    is among ``existing`` names."""
    if existing is None:
        return files, None
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    there = names.join(existing.select(stem("name").alias("_stem")).distinct(), stem("name") == F.col("_stem"), "left_semi").select("path")
    skipped = there.select("path", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    return files.join(there, "path", "left_anti"), skipped


def convert(files: DataFrame, folder: str, settings: DataFrame | None = None, existing: DataFrame | None = None, algorithm: str = "bilinear", bits: int = 8, root: str | None = None, names: DataFrame | None = None, **look) -> DataFrame:
    """Open, render, encode and write every file: path, status (written, skipped or
    errored) and error of each. Outputs keep their place below ``root`` and the tags that
    still hold, or have the ``names`` given (of ``output_names``' kind); names in
    ``existing`` are skipped; ``look`` goes to ``render_files``."""
    names = output_names(files, ".tif", root) if names is None else names
    todo, skipped = without_existing(files, names, existing)
    shown, status = render_files(todo, settings, algorithm, **look)
    encoded = encode_rgb(shown, bits, kept_tags(todo, USED, RAW_FROM - 1))
    done = written_status(status, write_files(encoded, folder, names))
    return done if skipped is None else done.union(skipped)
