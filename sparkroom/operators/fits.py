"""FITS headers to tags: gain and white-balance tables, dispatch, mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkroom.functions import points
from sparkroom.operators import times

# Fixed values of the supported camera: the maker's published table of gain against
# electrons a unit, and a calibration of blue settings that is not the maker's.
GAIN_TABLE = ((0, 2.55), (50, 1.5), (100, 0.85), (150, 0.5), (200, 0.3))
BLUE_TABLE = ((1, 0.01), (50, 0.59), (55, 0.73), (65, 0.87), (75, 1.0), (100, 1.34))

# Single-text fields and the header keyword of each.
AVM_TEXTS = {
    "Subject.Name": ("OBJECT",),
    "Instrument": ("INSTRUME",),
    "Facility": ("TELESCOP",),
    "Spectral.Bandpass": ("FILTER",),
    "Creator": ("OBSERVER", "AUTHOR", "CREATOR"),
}
AVM_DEFAULTS = {"Type": "Observation", "MetadataVersion": "1.1"}


def interpolate(v: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Linear between knots, flat beyond the ends."""
    return points.curve(v, table)


def iso_of_gain(gain: Column, table: Sequence[tuple[float, float]] = GAIN_TABLE) -> Column:
    return F.floor(100.0 * table[0][1] / interpolate(gain, table)).cast("long")


def balance_ratio(wb: Column, table: Sequence[tuple[float, float]] = BLUE_TABLE, at: float = 100.0) -> Column:
    """A setting's balance against that of ``at``."""
    return interpolate(wb, table) / interpolate(F.lit(float(at)), table)


# The instrument whose tables these are, and its neutral red setting.
TABLED_INSTRUMENT, NEUTRAL_RED = "ZWO ASI676MC", 80.0


def camera_iso(instrument: Column, gain: Column) -> Column:
    """By table for the instrument it belongs to, else the whole part of the gain."""
    return F.when(F.trim(instrument) == TABLED_INSTRUMENT, iso_of_gain(gain)).otherwise(F.floor(gain).cast("long"))


def analog_balance(instrument: Column, red: Column, blue: Column) -> Column:
    """Red, green and blue balance of the tabled instrument, null for others."""
    return F.when((F.trim(instrument) == TABLED_INSTRUMENT) & red.isNotNull() & blue.isNotNull(), F.array(red / NEUTRAL_RED, F.lit(1.0), balance_ratio(blue)))


def _angle(text: Column) -> Column:
    """Degrees, or hours, of "d m s" or a single number, with a sign before."""
    return points.let(text, _angle_of)


def _angle_of(text: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d*)?"), F.lit(0)), lambda n: n.try_cast("double"))
    size = points.let(parts, lambda p: F.get(p, F.lit(0)) + F.coalesce(F.get(p, F.lit(1)), F.lit(0.0)) / 60.0 + F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)) / 3600.0)
    whole = F.rlike(text, F.lit(r"^\s*[+-]?\d+(?:\.\d*)?(?:[\s:hdm°'’]+\d+(?:\.\d*)?){0,2}[\s\"s]*$"))
    return F.when(whole, F.when(F.rlike(text, F.lit(r"^\s*-")), -size).otherwise(size))


WCS = ("ra", "dec", "px", "py", "cd11", "cd12", "cd21", "cd22")


def wcs(header: Column) -> Column:
    """The linear part of a header's world coordinates, or null: reference point on the
    sky and in pixels (from 1), and the matrix of degrees a pixel, by the CD matrix, else by
    PC and CDELT, else by CDELT and CROTA2 (the published FITS convention). Axes must be
    right ascension and declination of one projection, and the matrix invertible."""
    cells = [(i, j) for i in (1, 2) for j in (1, 2)]
    names = [*(f"{k}{i}_{j}" for k in ("CD", "PC") for i, j in cells), "CDELT1", "CDELT2", "CROTA2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2"]

    def stated(h: Column) -> Column:
        kind = lambda i: F.upper(F.trim(F.try_element_at(h, F.lit(f"CTYPE{i}"))))
        return F.struct(*[F.try_element_at(h, F.lit(k)).try_cast("double").alias(k) for k in names], kind(1).alias("kind1"), kind(2).alias("kind2"))

    def matrix(n: Column) -> Column:
        has = lambda k: F.coalesce(*[n[f"{k}{i}_{j}"] for i, j in cells]).isNotNull()
        turn = F.radians(F.coalesce(n["CROTA2"], F.lit(0.0)))
        step = [n["CDELT1"], n["CDELT2"]]
        turned = [[step[0] * F.cos(turn), -step[1] * F.sin(turn)], [step[0] * F.sin(turn), step[1] * F.cos(turn)]]

        def cell(i: int, j: int) -> Column:
            cd = F.coalesce(n[f"CD{i}_{j}"], F.lit(0.0))
            pc = F.coalesce(n[f"PC{i}_{j}"], F.lit(float(i == j))) * step[i - 1]
            return F.when(has("CD"), cd).when(has("PC"), pc).otherwise(turned[i - 1][j - 1])

        values = {"ra": n["CRVAL1"], "dec": n["CRVAL2"], "px": n["CRPIX1"], "py": n["CRPIX2"]} | {f"cd{i}{j}": cell(i, j) for i, j in cells}
        fit = F.startswith(n["kind1"], F.lit("RA--")) & F.startswith(n["kind2"], F.lit("DEC-")) & (F.substring(n["kind1"], 6, 3) == F.substring(n["kind2"], 6, 3))
        return F.struct(*[v.alias(k) for k, v in values.items()], F.substring(n["kind1"], 6, 3).alias("projection"), fit.alias("fit"))

    def whole(m: Column) -> Column:
        fit = m["fit"] & (m["cd11"] * m["cd22"] - m["cd12"] * m["cd21"] != 0)
        for k in WCS:
            fit = fit & m[k].isNotNull()
        return F.when(F.coalesce(fit, F.lit(False)), F.struct(*[m[k].alias(k) for k in (*WCS, "projection")]))

    # each step's values once, however often the next one names them
    return points.let(points.let(points.let(header, stated), matrix), whole)


def wcs_scale(w: Column) -> Column:
    """Degrees a pixel across (negative where right ascension grows to the left) and up."""
    across = F.hypot(w["cd11"], w["cd21"])
    left = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"] < 0
    return F.array(F.when(left, -across).otherwise(across), F.hypot(w["cd12"], w["cd22"]))


def wcs_rotation(w: Column) -> Column:
    """Position angle of the image's upward axis, degrees east of north."""
    return F.degrees(F.atan2(w["cd12"], w["cd22"]))


def sky_of_pixel(w: Column, x: Column, y: Column) -> Column:
    """Right ascension and declination, in degrees, of a pixel (from 1) under the tangent
    plane's projection."""
    dx, dy = x - w["px"], y - w["py"]
    xi, eta = F.radians(w["cd11"] * dx + w["cd12"] * dy), F.radians(w["cd21"] * dx + w["cd22"] * dy)
    d0 = F.radians(w["dec"])
    below = F.cos(d0) - eta * F.sin(d0)
    right = F.pmod(w["ra"] + F.degrees(F.atan2(xi, below)), F.lit(360.0))
    up = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.hypot(xi, below)))
    return F.struct(right.alias("ra"), up.alias("dec"))


def avm(header: Column) -> Column:
    """A header map's fields, each a list of texts; absent ones are left out.

    World coordinates that a header states whole (``wcs``) go before single keywords.
    Those are tried in order; blank texts and, for numbers, zeros before the last one
    are passed over."""
    return points.let(header, lambda h: points.let(_place(h), lambda p: _avm(h, p)))


def _texts(header: Column):
    return lambda k: F.nullif(F.trim(F.try_element_at(header, F.lit(k))), F.lit(""))


def _pair(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.array(a.cast("string"), b.cast("string")))


def _place(header: Column) -> Column:
    """w (of ``wcs``) and the place on the sky of a header."""
    get = _texts(header)
    right = F.pmod(_angle(F.coalesce(get("RA"), get("OBJCTRA"))) * 15.0, F.lit(360.0))
    single = F.struct(right.alias("right"), _angle(F.coalesce(get("DEC"), get("OBJCTDEC"))).alias("up"))
    keywords = points.let(single, lambda s: _pair(F.when(F.abs(s["up"]) <= 90.0, s["right"]), s["up"]))
    return points.let(wcs(header), lambda w: F.struct(w.alias("w"), F.when(w.isNotNull(), _pair(w["ra"], w["dec"])).otherwise(keywords).alias("place")))


def _avm(header: Column, at: Column) -> Column:
    get = _texts(header)
    number = lambda k: get(k).try_cast("double")
    some = lambda k: F.nullif(number(k), F.lit(0.0))
    text = lambda v: points.let(v, lambda t: F.when(t.isNotNull(), F.array(t.cast("string"))))
    w, place = at["w"], at["place"]
    known = w.isNotNull()
    scale = points.let(F.coalesce(some("SCALE"), some("CDELT2")), lambda s: F.when(s.isNotNull(), F.transform(spatial_scale(s), lambda v: v.cast("string"))))
    middle = F.struct((F.coalesce(some("NAXIS1"), some("IMAGEW")) / 2.0).alias("x"), (F.coalesce(some("NAXIS2"), some("IMAGEH")) / 2.0).alias("y"))
    fields = {
        "Spatial.ReferenceValue": place,
        "Spatial.CoordinateFrame": F.when(place.isNotNull(), F.array(F.lit("ICRS"))),
        "Spatial.CoordinateDimension": F.when(place.isNotNull(), F.array(F.lit("2"), F.lit("2"))),
        "Spatial.CoordsystemProjection": F.when(place.isNotNull(), F.array(F.coalesce(w["projection"], F.lit("TAN")))),
        "Spatial.Scale": F.when(known, F.transform(wcs_scale(w), lambda v: v.cast("string"))).otherwise(scale),
        "Spatial.Rotation": F.when(known, text(wcs_rotation(w))).otherwise(text(F.coalesce(some("CROTA1"), some("CROTA2"), number("ROTATANG")))),
        "Spatial.ReferencePixel": F.when(known, _pair(w["px"], w["py"])).otherwise(points.let(middle, lambda m: _pair(m["x"], m["y"]))),
        "TemporalStartTime": text(F.trim(F.try_element_at(header, F.lit("DATE-OBS")))),
        "TemporalIntegrationTime": text(number("EXPTIME")),
    }
    fields |= {k: text(F.coalesce(*[get(n) for n in names])) for k, names in AVM_TEXTS.items()}
    fields |= {k: F.array(F.lit(v)) for k, v in AVM_DEFAULTS.items()}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def dng_tags(frames: DataFrame, header: str = "header", seconds: Column | None = None, zone: str | None = None, keys: Sequence[str] = ("image_id",), exposure: float | None = None, linear: bool = False, white_xy: tuple[float, float] | None = None) -> DataFrame:
    """``keys``, name and value (a list of texts) of the tags that a header, and the
    columns black and exposure of the frame's statistics, give.

    A pedestal in the header goes before a measured black level, and shifts move
    the time of capture, not its zone. An ``exposure`` given by hand goes before
    statistics, of exposure and of black (0 gives no tag); ``linear`` adds a straight
    tone curve, and ``white_xy`` a white point."""
    get = lambda k: F.nullif(F.trim(F.try_element_at(header, F.lit(k))), F.lit(""))
    one = lambda v: F.when(v.isNotNull(), F.array(v.cast("string")))
    whole = lambda k: F.floor(get(k).try_cast("double")).cast("long")
    instrument = F.coalesce(get("INSTRUME"), F.lit(""))
    balance = analog_balance(instrument, get("WB_RED").try_cast("double"), get("WB_BLUE").try_cast("double"))
    taken = times.fits_datetime(get("DATE-OBS"))
    moved = times.shift(taken, seconds) if seconds is not None else taken
    stamp = F.date_format(moved, "yyyy:MM:dd HH:mm:ss")
    given = {
        "CFAPattern": one(F.upper(get("BAYERPAT"))),
        "UniqueCameraModel": one(get("INSTRUME")),
        "ISOSpeedRatings": one(camera_iso(instrument, get("GAIN").try_cast("double"))),
        "AnalogBalance": F.when(balance.isNotNull(), F.transform(balance, lambda v: v.cast("string"))),
        "Software": one(get("SWCREATE")),
        "ExposureTime": one(get("EXPTIME").try_cast("double")),
        "DateTimeOriginal": one(stamp),
        "BlackLevel": one(F.coalesce(whole("PEDESTAL"), F.col("black").cast("long") if exposure is None else F.lit(None))),
        "WhiteLevel": one(whole("CWHITE")),
        "BaselineExposure": one(F.col("exposure") if exposure is None else F.lit(float(exposure) or None)),
    }
    if linear:
        given["ProfileToneCurve"] = F.array(*map(F.lit, ("0.0", "0.0", "1.0", "1.0")))
    if white_xy is not None:
        given["AsShotWhiteXY"] = F.array(*[F.lit(str(float(v))) for v in white_xy])
    if zone:
        given |= {k: F.array(F.lit(zone)) for k in ("OffsetTimeOriginal", "OffsetTimeDigitized", "OffsetTime")}
    cells = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in given.items()])
    return frames.select(*keys, F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("t")).select(*keys, "t.*")


def spatial_scale(scale: Column) -> Column:
    """Degrees for each pixel as [-s, s]: values from 0.01 on are arc seconds."""
    s = F.when(scale < 0.01, scale).otherwise(scale / 3600.0)
    return F.array(-s, s)


def pixel_type(bitpix: Column, bzero: Column) -> Column:
    """The target type of a frame's pixels, or null: whole numbers must be unsigned,
    which files of 16 and 32 bits say by their zero point; 64-bit floats are narrowed."""
    zero = F.coalesce(bzero.cast("double"), F.lit(0.0))
    return (
        F.when((bitpix == 8) & (zero == 0), "uint8")
        .when((bitpix == 16) & (zero == 2.0**15), "uint16")
        .when((bitpix == 32) & (zero == 2.0**31), "uint32")
        .when(bitpix.isin(-32, -64), "float32")
    )


def gate(bitpix: Column, naxis: Column, bzero: Column) -> Column:
    """ok, or why a frame is left out; types are judged before axes, if there is data."""
    return (
        F.when(naxis == 0, F.lit("skipped: no data"))
        .when(pixel_type(bitpix, bzero).isNull(), F.lit("error: pixel type"))
        .when(naxis != 2, F.lit("skipped: not two axes"))
        .otherwise(F.lit("ok"))
    )


def compression(dtype: Column, wanted: Column) -> Column:
    """32-bit and floating pixels stay uncompressed."""
    return F.when(dtype.isin("uint32", "float16", "float32"), F.lit("none")).otherwise(wanted)


# Presets of compression as codec, distance and effort.
PRESETS = {"uncompressed": ("none", None, None), "lossless_jpeg": ("jpeg", 0.0, None), "jxl_lossless": ("jxl", 0.0, 4), "jxl_lossy": ("jxl", 1.0, 4)}


def dump(headers: DataFrame) -> DataFrame:
    """hdu, name, n, low and high of every keyword of every unit of the files whose headers
    could be read (rows of ``sources.fits.headers_of``): how many files have it, and its
    least and greatest value, as numbers where all are."""
    cells = headers.where("status = 'ok'").select("hdu", F.explode("header").alias("name", "value"))
    number = F.col("value").try_cast("double")
    numeric = F.count(number) == F.count("*")
    least = lambda f, pick: F.when(numeric, f(number).cast("string")).otherwise(pick("value"))
    return cells.groupBy("hdu", "name").agg(F.count("*").alias("n"), least(F.min, F.min).alias("low"), least(F.max, F.max).alias("high"))
