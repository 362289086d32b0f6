"""FITS frames to DNG files: each with the tags that its own header and pixels give.

One pass over the files makes a row for each (header and histogram), from which status,
exposure, black level, tags and the XMP packet follow as columns. A second pass cuts the
images into packed tiles. Tag rows and tile rows of a file meet where its container is
built, so no two files need share anything. A file's bytes are what one task holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom.operators import fits as rules
from sparkroom.operators import statistics
from sparkroom.operators import tags as registry
from sparkroom.plans import convert
from sparkroom.sources import fits, tiff
from sparkroom.sources.files import shared_dir

# Type codes by name, and the version that files state.
TYPE_CODES = {name: code for code, name in registry.TIFF_TYPES.items()}
DNG_VERSION = (1, 4, 0, 0)


def frames_of(files: DataFrame) -> DataFrame:
    """``fits.scan`` with status (ok, skipped or errored) and error of each file, and the
    black and exposure that its pixels give."""
    scanned = fits.scan(files)
    number = lambda k: F.try_element_at("header", F.lit(k)).try_cast("double")
    scaled = F.coalesce(number("BSCALE"), F.lit(1.0)) != 1.0
    gate = rules.gate(F.when(scaled, F.lit(-32)).otherwise(number("BITPIX").cast("int")), number("NAXIS").cast("int"), number("BZERO"))
    parts = F.split(gate, ": ")
    why = F.when(gate != "ok", F.get(parts, F.lit(1)))
    kind = F.get(parts, F.lit(0))
    # a header's own verdict goes before what reading the data raised
    unread = F.col("error").isNotNull() & ((F.size("header") == 0) | (gate == "ok"))
    status = F.when(unread, "errored").when(kind == "error", "errored").when(kind == "skipped", "skipped").otherwise("ok")
    judged = scanned.withColumns({"status": status, "error": F.when(unread, F.col("error")).otherwise(why)})
    shared_dir(files.sparkSession)
    kept = judged.checkpoint(eager=True)  # a row a file
    # frames without counts (all pixels beyond white) keep their row
    hist = kept.select("path", "white", "bins", F.explode("hist").alias("h")).select("path", "white", "bins", "h.*")
    measured = statistics.auto_exposure_of(hist, image="path").select("path", "black", "exposure")
    return kept.drop("hist").join(measured, "path", "left")


def named_tags(frames: DataFrame, seconds: Column | None = None, zone: str | None = None, exposure: float | None = None, linear: bool = False, white_xy: tuple[float, float] | None = None, strip: Sequence[str] = (), extra: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """path, name and value (a list of texts) of every tag of each frame: those of the
    header and of AVM as an XMP packet; then ``strip`` names go and ``extra`` ones come."""
    own = rules.dng_tags(frames, seconds=seconds, zone=zone, keys=("path",), exposure=exposure, linear=linear, white_xy=white_xy)
    packet = registry.xmp_document(F.transform_keys(rules.avm(F.col("header")), lambda k, _: F.concat(F.lit("avm:"), k)))
    xmp = frames.select("path", F.lit("XMP").alias("name"), F.array(packet).alias("value"))
    made = own.unionByName(xmp)
    gone = sorted({*strip, *(extra or {})})
    kept = made.where(~F.col("name").isin(gone)) if gone else made
    if not extra:
        return kept
    cells = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*[F.lit(str(x)) for x in v]).alias("value")) for k, v in extra.items()])
    return kept.unionByName(frames.select("path", F.explode(cells).alias("t")).select("path", "t.*"))


def tag_rows(named: DataFrame) -> DataFrame:
    """Named tags as rows to be written (``tiff.NEW_TAGS``): code, type and place by the
    registry; names that it does not know are left out."""
    reg = F.broadcast(registry.registry(named.sparkSession))
    known = named.join(reg, "name")
    numbers = F.transform("value", lambda v: v.try_cast("double"))
    whole = F.forall(numbers, lambda v: v.isNull() | (v == F.floor(v)))
    kind = registry.infer_type(F.col("types"), F.when(whole, F.lit("int")).otherwise(F.lit("float")))
    code = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_CODES.items() for x in pair]), kind)
    letters = F.transform(F.regexp_extract_all(F.get("value", F.lit(0)), F.lit("[RGB]"), F.lit(0)), lambda c: F.when(c == "R", 0.0).when(c == "G", 1.0).otherwise(2.0))
    value = F.when(F.col("name") == "CFAPattern", letters).when((kind == "ASCII") | (F.col("name") == "XMP"), F.lit(None)).otherwise(numbers)
    text = F.when((kind == "ASCII") | (F.col("name") == "XMP"), F.get("value", F.lit(0)))
    place = F.when(F.col("place") == "exif", "exif").otherwise("ifd")
    return known.select(F.col("path").alias("image_id"), F.lit(0).alias("page"), place.alias("place"), "code", code.alias("dtype"), value.alias("value"), text.alias("text"))


def to_dng(files: DataFrame, frames: DataFrame, named: DataFrame, tile: int = 256) -> DataFrame:
    """path and content of a DNG file for each frame that is ok."""
    usable = frames.where("status = 'ok'")
    mosaic = F.coalesce(F.length(F.trim(F.try_element_at("header", F.lit("BAYERPAT")))) > 0, F.lit(False))
    cell = lambda code, dtype, *values: F.struct(F.lit(code).alias("code"), F.lit(dtype).alias("dtype"), F.array(*[v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in values]).alias("value"))
    kind = F.when(mosaic, F.lit(tiff.CFA)).otherwise(F.lit(tiff.LINEAR_RAW))
    always = F.array(cell(50706, 1, *DNG_VERSION), cell(tiff.PHOTOMETRIC, 3, kind), cell(tiff.SUBTYPE, 4, 0))
    cells = F.when(mosaic, F.concat(always, F.array(cell(33421, 3, 2, 2)))).otherwise(always)
    shape = usable.select("path", F.explode(cells).alias("t")).select(F.col("path").alias("image_id"), F.lit(0).alias("page"), F.lit("ifd").alias("place"), "t.*", F.lit(None).cast("string").alias("text"))
    rows = tag_rows(named.join(usable.select("path"), "path", "left_semi")).unionByName(shape)
    specs = [(1, dtype, None, {}) for dtype in fits.STORED]
    return tiff.containers(fits.tiles_of(files.join(usable.select("path"), "path", "left_semi"), tile), specs, tile, rows).withColumnRenamed("image_id", "path")


def convert_frames(files: DataFrame, folder: str, existing: DataFrame | None = None, root: str | None = None, tile: int = 256, **options) -> DataFrame:
    """Every FITS file as a DNG file under ``folder``: path, status (written, skipped or
    errored) and error of each. ``options`` go to ``named_tags``; outputs keep their
    place below ``root``, and names in ``existing`` are skipped."""
    names = convert.output_names(files, ".dng", root)
    todo, there = convert.without_existing(files, names, existing)
    frames = frames_of(todo)
    written = convert.write_files(to_dng(todo, frames, named_tags(frames, **options), tile), folder, names)
    done = convert.written_status(frames.select("path", "status", "error"), written)
    # a frame that is left out says why
    told = done.join(frames.select("path", F.col("status").alias("_s"), F.col("error").alias("_e")), "path").select("path", "status", F.when(F.col("status") == "skipped", F.col("_e")).otherwise(F.col("error")).alias("error"))
    return told if there is None else told.union(there)
