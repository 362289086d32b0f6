"""FITS files: headers of all units, and the primary image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroom.sources.files import by_bytes
from sparkroom.sources.tiff import tile_edge

BLOCK, CARD = 2880, 80
# Pixel types by BITPIX, big-endian.
PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}


def _value(text: str) -> str:
    text = text.strip()
    if text.startswith("'"):
        return text[1:].split("'")[0].rstrip()
    return text.split("/")[0].strip()


def _units(raw: bytes) -> Iterator[tuple[dict[str, str], int]]:
    at = 0
    while at + BLOCK <= len(raw):
        cards: dict[str, str] = {}
        ended = False
        while not ended and at + BLOCK <= len(raw):
            for i in range(0, BLOCK, CARD):
                card = raw[at + i : at + i + CARD].decode("ascii", "replace")
                key = card[:8].strip()
                if key == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    cards[key] = _value(card[10:])
            at += BLOCK
        if not ended or not ({"SIMPLE", "XTENSION"} & cards.keys()):
            raise ValueError("not a FITS unit")
        yield cards, at
        axes = [int(cards.get(f"NAXIS{i + 1}", 0)) for i in range(int(cards.get("NAXIS", 0)))]
        size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod(axes)) if axes else 0
        at += -(-size // BLOCK) * BLOCK


def units(raw: bytes) -> list[tuple[dict[str, str], int]]:
    """Header and place of the data of every unit."""
    out = list(_units(raw))
    if not out:
        raise ValueError("not a FITS file")
    return out


def primary(raw: bytes) -> tuple[dict[str, str], int]:
    """The first unit, whatever the others are."""
    for unit in _units(raw):
        return unit
    raise ValueError("not a FITS file")


def image(raw: bytes) -> np.ndarray:
    """The primary image: BZERO and BSCALE applied, 64-bit floats narrowed, two axes only.
    Images with a scale become floats."""
    head, at = primary(raw)
    if head.get("NAXIS") != "2":
        raise ValueError("not two axes")
    w, h, kind = int(head["NAXIS1"]), int(head["NAXIS2"]), int(head["BITPIX"])
    a = np.frombuffer(raw, PIXELS[kind], w * h, at).reshape(h, w)
    zero, scale = float(head.get("BZERO", 0)), float(head.get("BSCALE", 1))
    if scale != 1 or (kind < 0 and zero):
        return (a.astype(np.float64) * scale + zero).astype(np.float32)
    if kind in (16, 32):
        if zero != 2 ** (kind - 1):
            raise ValueError("signed pixels are not taken")
        return (a.astype(np.int64) + int(zero)).astype(np.uint16 if kind == 16 else np.uint32)
    return a.astype(np.float32 if kind < 0 else np.uint8)


def build(a: np.ndarray, header: dict[str, object]) -> bytes:
    """A file of one unit with an unsigned or floating image."""
    kind = {"u1": 8, "u2": 16, "u4": 32, "f4": -32, "f8": -64}[a.dtype.str[1:]]
    cards = {"SIMPLE": "T", "BITPIX": kind, "NAXIS": 2, "NAXIS1": a.shape[1], "NAXIS2": a.shape[0]}
    if kind in (16, 32):
        cards["BZERO"] = 2 ** (kind - 1)
    text = "".join(f"{k:<8}= {(chr(39) + v + chr(39)) if isinstance(v, str) and v != 'T' else v!s:>20}".ljust(CARD)[:CARD] for k, v in (cards | header).items()) + "END".ljust(CARD)
    data = (a.astype(np.int64) - (2 ** (kind - 1) if kind in (16, 32) else 0)).astype(PIXELS[kind]).tobytes() if kind > 0 else a.astype(PIXELS[kind]).tobytes()
    pad = lambda b, c: b + c * (-len(b) % BLOCK)
    return pad(text.encode("ascii"), b" ") + pad(data, b"\0")


def headers_of(files: DataFrame) -> DataFrame:
    """path, hdu, header map, status and error of rows of path and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf.path, pdf.content):
                try:
                    out += [(path, i, head, "ok", None) for i, (head, _) in enumerate(units(bytes(raw)))]
                except (ValueError, KeyError) as e:
                    out.append((path, 0, {}, "errored", str(e)))
            yield pd.DataFrame(out, columns=["path", "hdu", "header", "status", "error"])

    return by_bytes(files).mapInPandas(run, "path string, hdu int, header map<string,string>, status string, error string")


def pixels_of(files: DataFrame) -> DataFrame:
    """path, y, x and v of each primary image, or one row with status and error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf.path, pdf.content):
                try:
                    a = image(bytes(raw))
                    y, x = np.indices(a.shape).reshape(2, -1)
                    yield pd.DataFrame({"path": path, "y": y, "x": x, "v": a.reshape(-1).astype(float), "status": "ok", "error": None})
                except (ValueError, KeyError) as e:
                    yield pd.DataFrame({"path": [path], "y": [None], "x": [None], "v": [None], "status": ["errored"], "error": [str(e)]}).astype({"y": "Int64", "x": "Int64", "v": "Float64"})

    return by_bytes(files).mapInPandas(run, "path string, y long, x long, v double, status string, error string")


def read_headers(spark: SparkSession, path: str, glob: str = "*.fit*") -> DataFrame:
    return headers_of(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))


#: Bins of a frame's histogram at most, and the white level where a header gives none.
MAX_BINS, WHITE = 10_000, 65_535
SCAN = "path string, header map<string,string>, white double, bins int, hist array<struct<bin:int,n:long>>, error string"


def _white(head: dict[str, str]) -> int:
    try:
        return int(float(head["CWHITE"]))
    except (KeyError, ValueError, OverflowError):
        return WHITE


def scan(files: DataFrame) -> DataFrame:
    """A row for each file: the primary header, the histogram of its image on [0, white]
    (white by the header, or 65535), and what keeps it from being read."""

    def one(raw: bytes) -> tuple:
        head: dict[str, str] = {}
        try:
            head, _ = primary(raw)
            white = _white(head)
            bins = max(1, min(white, MAX_BINS))
            if head.get("NAXIS") != "2":
                return head, float(white), bins, [], None
            a = image(raw)
            v = a[(a >= 0) & (a <= white)].astype(float)
            at = np.minimum(np.floor(v / max(white, 1) * bins), bins - 1).astype(np.int64)
            n = np.bincount(at, minlength=1)
            return head, float(white), bins, [{"bin": int(i), "n": int(n[i])} for i in np.flatnonzero(n)], None
        except (ValueError, KeyError, TypeError, OverflowError) as e:
            return head, None, None, [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, *one(bytes(raw))) for path, raw in zip(pdf.path, pdf.content)]
            yield pd.DataFrame(rows, columns=["path", "header", "white", "bins", "hist", "error"]).astype({"white": "Float64", "bins": "Int32"})

    return by_bytes(files.select("path", "content")).mapInPandas(run, SCAN)


#: Types that an image's samples may have, by place in this list.
STORED = ("<u1", "<u2", "<u4", "<f4")


def tiles_of(files: DataFrame, tile: int = 256) -> DataFrame:
    """Packed tiles of each file's primary image as ``tiff.containers`` takes them; files
    that cannot be read give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf.path, pdf.content):
                try:
                    a = image(bytes(raw))
                except (ValueError, KeyError, TypeError, OverflowError):
                    continue
                spec = STORED.index(np.dtype(a.dtype.newbyteorder("<")).str.replace("|", "<"))
                h, w = a.shape
                for ty in range(-(-h // tile)):
                    rows = []
                    for tx in range(-(-w // tile)):
                        part = a[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
                        full = np.zeros([tile_edge(n, tile) for n in part.shape], STORED[spec])
                        full[: part.shape[0], : part.shape[1]] = part
                        rows.append((path, 0, spec, ty, tx, ty * tile + part.shape[0], tx * tile + part.shape[1], full.tobytes()))
                    yield pd.DataFrame(rows, columns=["image_id", "page", "spec", "ty", "tx", "h", "w", "blob"])

    return by_bytes(files.select("path", "content")).mapInPandas(run, "image_id string, page int, spec int, ty int, tx int, h long, w long, blob binary")


def encode_frames(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """path and content of a file for each image: ``pixels`` are rows (image_id, y, x, v)
    of whole numbers of 16 bits, ``headers`` rows (image_id, path, header), a map of
    keywords to texts. Lines are packed each in a group of its own, without Python."""
    text = lambda n: F.lpad(F.hex(n), 4, "0")
    # stored numbers are signed around the zero point of 2^15
    word = text(F.pmod(F.col("v").cast("int") - 32768, F.lit(65536)))
    lines = pixels.groupBy("image_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), word.alias("t")))), lambda p: p["t"]), "").alias("line"), F.count("*").alias("w"))
    data = lines.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("y").cast("long").alias("y"), "line"))), lambda p: p["line"]), "").alias("hex"), F.max("w").alias("w"), F.count("*").alias("h"))
    number = lambda k, v: F.concat(F.rpad(F.lit(k), 8, " "), F.lit("= "), F.lpad(v.cast("string"), 20, " "))
    card = lambda c: F.rpad(c, CARD, " ")
    fixed = [number("SIMPLE", F.lit("T")), number("BITPIX", F.lit(16)), number("NAXIS", F.lit(2)), number("NAXIS1", F.col("w")), number("NAXIS2", F.col("h")), number("BZERO", F.lit(32768))]
    own = F.transform(F.map_entries("header"), lambda e: card(F.concat(F.rpad(e["key"], 8, " "), F.lit("= '"), e["value"], F.lit("'"))))
    cards = F.concat(F.array(*[card(c) for c in fixed]), F.array_sort(own), F.array(F.lit("END".ljust(CARD))))
    head = F.array_join(cards, "")
    filled = lambda size: F.pmod(-size, F.lit(BLOCK)).cast("int")
    padded = F.concat(head, F.repeat(F.lit(" "), filled(F.length(head))))
    body = F.concat("hex", F.repeat(F.lit("00"), filled((F.length("hex") / 2).cast("int"))))
    joined = data.join(headers.select("image_id", "path", "header"), "image_id")
    return joined.select("path", F.concat(F.encode(padded, "US-ASCII"), F.unhex(body)).alias("content"))
