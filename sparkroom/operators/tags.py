"""Metadata as rows: image_id, ifd, name, value, and what the registry knows.

A tag set is a table with one row for each image, IFD and name. The registry is a
small fixed table and is broadcast; tag sets meet in joins on their full key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkroom.functions import points

KEY = ("image_id", "ifd", "name")

# TIFF type codes and names.
TIFF_TYPES = {1: "BYTE", 2: "ASCII", 3: "SHORT", 4: "LONG", 5: "RATIONAL", 6: "SBYTE", 7: "UNDEFINED", 8: "SSHORT", 9: "SLONG", 10: "SRATIONAL", 11: "FLOAT", 12: "DOUBLE", 13: "IFD", 16: "LONG8", 17: "SLONG8", 18: "IFD8"}
INTEGERS = ("BYTE", "SHORT", "LONG", "SBYTE", "UNDEFINED", "SSHORT", "SLONG", "IFD", "LONG8", "SLONG8", "IFD8", "ASCII")
FRACTIONS = ("RATIONAL", "SRATIONAL", "FLOAT", "DOUBLE")

# Registered tags as name, code, types, count (0: any) and where they belong.
REGISTRY = (
    ("ImageWidth", 256, "SHORT LONG", 1, "any"),
    ("ImageLength", 257, "SHORT LONG", 1, "any"),
    ("BitsPerSample", 258, "SHORT", 0, "any"),
    ("Compression", 259, "SHORT", 1, "any"),
    ("PhotometricInterpretation", 262, "SHORT", 1, "any"),
    ("ImageDescription", 270, "ASCII", 0, "any"),
    ("Make", 271, "ASCII", 0, "ifd0"),
    ("Model", 272, "ASCII", 0, "ifd0"),
    ("StripOffsets", 273, "SHORT LONG", 0, "any"),
    ("Orientation", 274, "SHORT", 1, "any"),
    ("SamplesPerPixel", 277, "SHORT", 1, "any"),
    ("RowsPerStrip", 278, "SHORT LONG", 1, "any"),
    ("StripByteCounts", 279, "SHORT LONG", 0, "any"),
    ("Software", 305, "ASCII", 0, "ifd0"),
    ("DateTime", 306, "ASCII", 20, "ifd0"),
    ("Artist", 315, "ASCII", 0, "ifd0"),
    ("SubIFDs", 330, "LONG IFD", 0, "any"),
    ("SampleFormat", 339, "SHORT", 0, "any"),
    ("CFARepeatPatternDim", 33421, "SHORT", 2, "raw"),
    ("CFAPattern", 33422, "BYTE", 0, "raw"),
    ("ExposureTime", 33434, "RATIONAL", 1, "exif"),
    ("FNumber", 33437, "RATIONAL", 1, "exif"),
    ("ISOSpeedRatings", 34855, "SHORT", 0, "exif"),
    ("ExifVersion", 36864, "UNDEFINED", 4, "exif"),
    ("DateTimeOriginal", 36867, "ASCII", 20, "exif"),
    ("OffsetTime", 36880, "ASCII", 7, "exif"),
    ("DateTimeDigitized", 36868, "ASCII", 20, "exif"),
    ("OffsetTimeOriginal", 36881, "ASCII", 7, "exif"),
    ("OffsetTimeDigitized", 36882, "ASCII", 7, "exif"),
    ("XMP", 700, "BYTE", 0, "ifd0"),
    ("DNGVersion", 50706, "BYTE", 4, "ifd0"),
    ("UniqueCameraModel", 50708, "ASCII", 0, "ifd0"),
    ("AsShotWhiteXY", 50729, "RATIONAL", 2, "ifd0"),
    ("ProfileToneCurve", 50940, "FLOAT", 0, "ifd0"),
    ("BlackLevel", 50714, "SHORT LONG RATIONAL", 0, "raw"),
    ("WhiteLevel", 50717, "SHORT LONG", 0, "raw"),
    ("DefaultCropOrigin", 50719, "SHORT LONG RATIONAL", 2, "raw"),
    ("DefaultCropSize", 50720, "SHORT LONG RATIONAL", 2, "raw"),
    ("ColorMatrix1", 50721, "SRATIONAL", 9, "ifd0"),
    ("ColorMatrix2", 50722, "SRATIONAL", 9, "ifd0"),
    ("AnalogBalance", 50727, "RATIONAL", 0, "ifd0"),
    ("AsShotNeutral", 50728, "RATIONAL", 0, "ifd0"),
    ("BaselineExposure", 50730, "SRATIONAL", 1, "ifd0"),
    ("ForwardMatrix1", 50964, "SRATIONAL", 9, "ifd0"),
)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(n, code, types.split(), count, place) for n, code, types, count, place in REGISTRY]
    return spark.createDataFrame(rows, "name string, code int, types array<string>, need int, place string")


def infer_type(types: Column, value_kind: Column) -> Column:
    """A single registered type wins; else int is LONG, float RATIONAL, others LONG."""
    guess = F.when(value_kind == "float", F.lit("RATIONAL")).otherwise(F.lit("LONG"))
    return F.when(F.size(types) == 1, F.get(types, F.lit(0))).otherwise(guess)


def compatible(a: Column, b: Column) -> Column:
    """Integers and ASCII interchange, and fractions do."""
    return (a.isin(*INTEGERS) & b.isin(*INTEGERS)) | (a.isin(*FRACTIONS) & b.isin(*FRACTIONS))


def upsert(tags: DataFrame, new: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``new`` over ``tags``: one row for each key, the new value where there is one."""
    a, b = tags.select(*keys, F.col("value").alias("_old")), new.select(*keys, F.col("value").alias("_new"), F.lit(True).alias("_given"))
    return a.join(b, list(keys), "full").select(*keys, F.when(F.col("_given"), F.col("_new")).otherwise(F.col("_old")).alias("value"))


merge = upsert


def latest(tags: DataFrame, order: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """The last of repeated additions of a tag."""
    within = Window.partitionBy(*keys).orderBy(order.desc())
    return tags.withColumn("_n", F.row_number().over(within)).where("_n = 1").drop("_n")


def strip(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Without the tags of the given names."""
    return tags.join(names.select("name"), "name", "left_anti")


def apply_ops(tags: DataFrame, ops: Sequence[dict], keys: Sequence[str] = KEY) -> DataFrame:
    """Every tag set after a list of operations: names of "strip" go first, then those
    of "set" are laid over what is left, the last value of a name. Other kinds and
    blank names do nothing."""
    gone = sorted({n for o in ops if o["type"] == "strip" and (n := o.get("name", "").strip())})
    given = {n: str(o.get("value", "")) for o in ops if o["type"] == "set" and (n := o.get("name", "").strip())}
    kept = tags.where(~F.col("name").isin(gone)) if gone else tags
    if not given:
        return kept.select(*keys, "value")
    sets = tags.select(*[k for k in keys if k != "name"]).distinct()
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in given.items()])
    new = sets.withColumn("_t", F.explode(pairs)).select(*sets.columns, "_t.*")
    return upsert(kept, new, keys)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Keys that only one side has; side is missing (from b) or extra."""
    both = a.select(*keys, F.lit(1).alias("_n")).unionByName(b.select(*keys, F.lit(-1).alias("_n")))
    # dealt by key first: keys hardly repeat within a task, whose whole input would stand in its map
    more = both.repartition(*keys).groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    each = F.explode(F.array_repeat(F.when(F.col("_n") > 0, "missing").otherwise("extra"), F.abs("_n").cast("int")))
    return more.select(*keys, each.alias("side"))


def compare(a: DataFrame, b: DataFrame, skip: Sequence[str] = (), keys: Sequence[str] = KEY) -> DataFrame:
    """Keys on both sides whose values differ, nulls being equal to nulls."""
    joined = a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), list(keys))
    differ = joined.where(~F.col("a").eqNullSafe(F.col("b")))
    return differ.where(~F.col("name").isin(list(skip))) if skip else differ


def filter_tags(tags: DataFrame, pattern: str | None = None, exclude: str | None = None, ifd: int | None = None) -> DataFrame:
    out = tags
    if pattern:
        out = out.where(F.rlike("name", F.lit(pattern)))
    if exclude:
        out = out.where(~F.rlike("name", F.lit(exclude)))
    return out.where(F.col("ifd") == ifd) if ifd is not None else out


def summary(tags: DataFrame) -> DataFrame:
    return tags.groupBy("ifd").agg(F.count("*").alias("n_tags"), F.countDistinct("name").alias("n_names"))


def matrix(value: Column) -> Column:
    """Nine numbers as three rows."""
    return F.when(F.size(value) == 9, F.array(*[F.slice(value, 3 * i + 1, 3) for i in range(3)]))


def lookup(names: DataFrame, reg: DataFrame, name: str = "asked") -> DataFrame:
    """Registered names by exact spelling, else by spelling without case."""
    exact = F.broadcast(reg.select(F.col("name").alias("_exact")))
    folded = F.broadcast(reg.groupBy(F.lower("name").alias("_lower")).agg(F.min("name").alias("_folded")))
    found = names.join(exact, names[name] == F.col("_exact"), "left").join(folded, F.lower(names[name]) == F.col("_lower"), "left")
    how = F.when(F.col("_exact").isNotNull(), F.lit("exact")).when(F.col("_folded").isNotNull(), F.lit("folded")).otherwise(F.lit("unknown"))
    return found.select(*names.columns, F.coalesce("_exact", "_folded").alias("name"), how.alias("how"))


def encode(dtype: Column, number: Column, text: Column, limit: int = 1_000_000) -> Column:
    """A value as its type stores it: numbers as num and den, text with its NUL."""
    den = F.when(dtype.isin("RATIONAL", "SRATIONAL"), F.lit(limit)).otherwise(F.lit(1)).cast("long")
    num = F.when(dtype.isin(*FRACTIONS[:2]), F.floor(number * float(limit) + 0.5)).otherwise(F.floor(number)).cast("long")
    return F.struct(
        F.when(dtype != "ASCII", num).alias("num"),
        F.when(dtype != "ASCII", den).alias("den"),
        F.when(dtype == "ASCII", text).alias("text"),
        F.when(dtype == "ASCII", F.octet_length(text) + 1).otherwise(F.lit(1)).alias("count"),
    )


def validate(tags: DataFrame, reg: DataFrame) -> DataFrame:
    """Tags with a problem: unknown name, wrong type, count or place.

    ``tags`` has image_id, ifd (0 is the first), name, dtype, count and, where it is
    known, kinds: what the tag's IFD is (of ifd0, raw and exif, several at once for a
    first IFD that holds the raw image). Without that column only the first IFD is
    told from others, and tags of raw or EXIF directories are not judged by place."""
    r = F.broadcast(reg)
    joined = tags.join(r, "name", "left")
    fits = F.exists("types", lambda t: (t == F.col("dtype")) | compatible(t, F.col("dtype")))
    if "kinds" in tags.columns:
        misplaced = (F.col("place") != "any") & ~F.array_contains("kinds", F.col("place"))
    else:
        misplaced = (F.col("place") == "ifd0") & (F.col("ifd") != 0)
    issue = (
        F.when(F.col("code").isNull(), F.lit("unknown tag"))
        .when(~fits, F.lit("wrong type"))
        .when((F.col("need") > 0) & (F.col("count") != F.col("need")), F.lit("wrong count"))
        .when(misplaced, F.concat(F.lit("belongs in "), F.col("place")))
    )
    return joined.withColumn("issue", issue).where("issue is not null").select("image_id", "ifd", "name", "issue")


def flatten_exif(images: DataFrame, exif: str = "exif") -> DataFrame:
    """Entries of a map of tags as rows; ExifVersion is left out."""
    return images.select("image_id", F.explode(exif).alias("name", "value")).where("name <> 'ExifVersion'")


def curve_points_to_xmp(values: Column) -> Column:
    """Curve points of [0, 1] as the packet writes them, "x, y" of 0 to 255."""
    n = lambda v: F.floor(v * 255 + 0.5).cast("int")
    return F.transform(values, lambda p: F.concat_ws(", ", n(p["x"]), n(p["y"])))


def curve_points_from_xmp(items: Column) -> Column:
    def one(s: Column) -> Column:
        parts = F.split(s, r"\s*,\s*")
        return F.struct((F.get(parts, F.lit(0)).cast("double") / 255).alias("x"), (F.get(parts, F.lit(1)).cast("double") / 255).alias("y"))

    return F.transform(items, one)


def xmp_packet(values: Column) -> Column:
    """A map of namespaced keys to values as a packet."""
    entry = lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escape(e["value"]), F.lit('"'))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(values)), entry), "")
    return F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description'), body, F.lit("/></rdf:RDF></x:xmpmeta>"))


# The namespaces of a packet's own elements and of the prefixes that are known.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NAMESPACES = {
    "avm": "http://www.communicatingastronomy.org/avm/1.0/",
    "crs": "http://ns.adobe.com/camera-raw-settings/1.0/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "exif": "http://ns.adobe.com/exif/1.0/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "tiff": "http://ns.adobe.com/tiff/1.0/",
    "xmp": "http://ns.adobe.com/xap/1.0/",
}


def xmp_document(values: Column) -> Column:
    """A map of namespaced keys to lists of texts as a packet: single texts as attributes,
    longer lists as elements with an ``rdf:Seq``; empty lists are left out."""
    entries = F.filter(F.array_sort(F.map_entries(values)), lambda e: F.size(e["value"]) > 0)
    one = lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escape(F.get(e["value"], F.lit(0))), F.lit('"'))
    item = lambda v: F.concat(F.lit("<rdf:li>"), _escape(v), F.lit("</rdf:li>"))
    many = lambda e: F.concat(F.lit("<"), e["key"], F.lit("><rdf:Seq>"), F.array_join(F.transform(e["value"], item), ""), F.lit("</rdf:Seq></"), e["key"], F.lit(">"))
    attributes = lambda es: F.array_join(F.transform(F.filter(es, lambda e: F.size(e["value"]) == 1), one), "")
    elements = lambda es: F.array_join(F.transform(F.filter(es, lambda e: F.size(e["value"]) > 1), many), "")
    spaces = "".join(f' xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    start = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}"><rdf:Description rdf:about=""{spaces}'
    return points.let(entries, lambda es: F.concat(F.lit(start), attributes(es), F.lit(">"), elements(es), F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>")))


def xmp_lists(packet: Column) -> Column:
    """The keys of all descriptions of a packet and their lists of texts: attributes and
    plain elements of one, and the items of Seq, Bag and Alt elements. Namespaces and
    structure's own attributes are left out; of repeated keys the last counts."""
    name = r"((?!rdf:|xmlns:|xml:|x:)[A-Za-z][\w.-]*:[\w.-]+)"
    attribute = r"""(?<=\s)""" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    element = r"(?s)<" + name + r"(?:\s[^>]*)?(?<!/)>(.*?)</\1\s*>"
    groups = lambda text, pattern, *names: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)])
    head = lambda p: F.array_join(F.regexp_extract_all(p, F.lit(r"<rdf:Description([^>]*)>"), F.lit(1)), " ")
    texts = lambda p: points.let(head(p), lambda h: F.transform(groups(h, attribute, "k", "a", "b"), lambda z: F.struct(z["k"].alias("key"), F.array(_plain(F.concat(z["a"], z["b"]))).alias("value"))))
    items = lambda body: F.regexp_extract_all(body, F.lit(r"(?s)<rdf:li(?:\s[^>]*)?(?<!/)>(.*?)</rdf:li\s*>"), F.lit(1))
    whole = lambda body: F.when(F.rlike(body, F.lit(r"<rdf:(?:Seq|Bag|Alt)\b")), items(body)).otherwise(F.array(F.regexp_replace(body, r"^\s+|\s+$", "")))
    lists = lambda p: F.transform(groups(p, element, "k", "v"), lambda z: F.struct(z["k"].alias("key"), F.transform(whole(z["v"]), _plain).alias("value")))
    # a key's last place among the keys is that of the entry that counts
    last = lambda found, keys: F.filter(found, lambda e, i: F.size(keys) - F.array_position(keys, e["key"]) == i)
    found = points.let(packet, lambda p: F.concat(texts(p), lists(p)))
    return points.let(found, lambda e: F.map_from_entries(points.let(F.reverse(e["key"]), lambda keys: last(e, keys))))


# Characters that attributes write as entities; "&" comes first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _escape(v: Column) -> Column:
    for a, b in ESCAPES:
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def _plain(v: Column) -> Column:
    for a, b in reversed(ESCAPES):
        v = F.replace(v, F.lit(b), F.lit(a))
    return v


def xmp_values(packet: Column) -> Column:
    """The keys and values of a packet's description."""
    pattern = r'([A-Za-z][\w.-]*:[\w.-]+)="([^"]*)"'
    inside = F.regexp_extract(packet, r"<rdf:Description([^>]*)>", 1)
    plain = F.transform(F.regexp_extract_all(inside, F.lit(pattern), F.lit(2)), _plain)
    return F.map_from_arrays(F.regexp_extract_all(inside, F.lit(pattern), F.lit(1)), plain)
