"""TIFF and DNG containers: parse and build, uncompressed pages only.

Small helpers over one file's bytes; Spark reads the files (``binaryFile``),
spreads them over tasks, and keeps a damaged file's error in its row. A page's EXIF
and GPS directories are read and written with it; rows of tags say in ``place`` which
directory (ifd, exif or gps) a tag stands in."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroom.sources import opcode_lists
from sparkroom.sources.files import by_bytes

# Sizes and struct letters of TIFF types, by code.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}
# Codes of the tags that describe a page, and photometric kinds.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, SUBIFDS, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SUBTYPE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 330, 322, 323, 324, 325, 339, 254
CFA, LINEAR_RAW, RGB_KIND, GRAY = 32803, 34892, 2, 1

# Tags that point to a page's own further directories, and the packet of XMP.
PLACES = {34665: "exif", 34853: "gps"}
XMP = 700
#: Tags that say how and where a page is stored; a copy has its own.
STRUCTURE = (WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, SUBIFDS, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SUBTYPE, *PLACES, 284, 317)

#: What reading a damaged file may raise; the file's row then has the error.
BROKEN = (ValueError, struct.error, IndexError, TypeError, KeyError, ZeroDivisionError, OverflowError, MemoryError)

TAG_ROWS = "path string, ifd int, place string, code int, dtype int, count long, value array<double>, text string, raw binary, error string"


@dataclass
class Page:
    tags: dict[int, tuple[int, tuple]] = field(default_factory=dict)
    order: str = "<"
    places: dict[str, dict[int, tuple[int, tuple]]] = field(default_factory=dict)

    def first(self, code: int, default=None):
        return self.tags[code][1][0] if code in self.tags and len(self.tags[code][1]) else default

    def all(self, code: int) -> tuple:
        return self.tags[code][1] if code in self.tags else ()


def pages(raw) -> list[Page]:
    """All pages: the chain of IFDs, each followed by its sub-IFDs. ``raw`` is bytes, or
    gives bytes for slices."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF container")
    out: list[Page] = []
    seen: set[int] = set()

    def unpack(form: str, at: int) -> tuple:
        return struct.unpack(order + form, raw[at : at + struct.calcsize(order + form)])

    def directory(at: int) -> tuple[dict[int, tuple[int, tuple]], int]:
        """Tags of the directory there, and where its list of entries ends."""
        (n,) = unpack("H", at)
        tags: dict[int, tuple[int, tuple]] = {}
        for i in range(n):
            code, kind, count, _ = unpack("HHII", at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            size, letter = TYPES[kind]
            where = at + 2 + 12 * i + 8
            if size * count > 4:
                (where,) = unpack("I", where)
            if kind == 2:
                tags[code] = (kind, (raw[where : where + count].split(b"\0")[0].decode("utf-8", "replace"),))
            else:
                values = unpack(f"{count}s" if letter == "s" else f"{count * len(letter)}{letter[0]}", where)
                tags[code] = (kind, tuple(zip(values[::2], values[1::2])) if kind in (5, 10) else values)
        return tags, at + 2 + 12 * n

    def walk(at: int) -> None:
        while at and at not in seen:
            seen.add(at)
            tags, end = directory(at)
            page = Page(tags, order)
            page.places = {name: directory(page.first(code))[0] for code, name in PLACES.items() if page.first(code)}
            out.append(page)
            for sub in page.all(SUBIFDS):
                walk(sub)
            (at,) = unpack("I", end)

    walk(unpack("I", 4)[0])
    return out


def extent(page: Page, i: int) -> tuple[int, int]:
    """Where the bytes of a strip or tile begin and end."""
    tiled = TILES in page.tags
    at = page.all(TILES if tiled else STRIPS)[i]
    return at, at + page.all(TILE_BYTES if tiled else STRIP_BYTES)[i]


def decoded(data: bytes, page: Page, rows: int, cols: int) -> np.ndarray:
    """(rows, cols, samples) of the bytes of an uncompressed strip or tile."""
    s, bits = page.first(SAMPLES, 1), page.first(BITS, 8)
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (16, 3): "f2", (32, 3): "f4"}.get((bits, page.first(FORMAT, 1)))
    if kind is None:
        return unpack_bits(data, rows, cols * s, bits).reshape(rows, cols, s)
    return np.frombuffer(data, np.dtype(kind).newbyteorder(page.order), rows * cols * s).reshape(rows, cols, s)


def blocks(page: Page) -> list[tuple[int, int, int, int]]:
    """Each strip or tile of a page in order: its first row and column, and the rows and
    columns that it stores; a tile's may reach beyond the page."""
    h, w = page.first(HEIGHT), page.first(WIDTH)
    if TILES in page.tags:
        th, tw = page.first(TILE_H), page.first(TILE_W)
        return [(y, x, th, tw) for y in range(0, h, th) for x in range(0, w, tw)]
    step = min(page.first(ROWS, h), h)
    return [(y, 0, min(step, h - y), w) for y in range(0, h, step)]


def pixels(raw: bytes, page: Page) -> np.ndarray:
    """(height, width, samples) of an uncompressed page, in strips or tiles."""
    if page.first(COMPRESSION, 1) != 1:
        raise ValueError("compressed pages need a codec that is not here")
    h, w, s = page.first(HEIGHT), page.first(WIDTH), page.first(SAMPLES, 1)
    tiled = TILES in page.tags
    block = lambda i, rows, cols: decoded(raw[slice(*extent(page, i))], page, rows, cols)
    if not tiled:
        step = page.first(ROWS, h)
        return np.concatenate([block(i, min(step, h - i * step), w) for i in range(-(-h // step))])
    th, tw = page.first(TILE_H), page.first(TILE_W)
    across = -(-w // tw)
    lines = [np.concatenate([block(j * across + i, th, tw) for i in range(across)], 1) for j in range(-(-h // th))]
    return np.concatenate(lines)[:h, :w]


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Rows of n-bit numbers, highest bit first, each row padded to a byte."""
    rows = values.reshape(len(values), -1).astype(np.uint32)
    planes = (rows[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(planes.reshape(len(rows), -1).astype(np.uint8), axis=1).tobytes()


def unpack_bits(data: bytes, rows: int, cols: int, bits: int) -> np.ndarray:
    width = -(-cols * bits // 8)
    flat = np.unpackbits(np.frombuffer(data, np.uint8, rows * width).reshape(rows, width), axis=1)[:, : cols * bits]
    return (flat.reshape(rows, cols, bits).astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(2).astype(np.uint32)


def _blocks(a: np.ndarray, bits: int | None, order: str, tile: int | None) -> list[bytes]:
    """The bytes of one strip, or of padded square tiles, row by row."""
    parts = [a]
    if tile:
        h, w = (-(-n // tile) * tile for n in a.shape[:2])
        full = np.pad(a, ((0, h - a.shape[0]), (0, w - a.shape[1]), (0, 0)), mode="edge")
        parts = [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    if bits and bits not in (8, 16, 32):
        return [pack_bits(p, bits) for p in parts]
    return [p.astype(p.dtype.newbyteorder(order)).tobytes() for p in parts]


@dataclass
class Encoded:
    """A page as bytes: its shape, the bits of a sample, whether samples are floats, its
    own tags, those of its further directories, and the bytes of its strip or tiles (of
    so many rows and columns)."""

    height: int
    width: int
    samples: int
    depth: int
    floating: bool
    blobs: list[bytes]
    tags: dict[int, tuple[int, tuple]] = field(default_factory=dict)
    tile: tuple[int, int] | None = None
    places: dict[str, dict[int, tuple[int, tuple]]] = field(default_factory=dict)

    def described(self) -> dict[int, tuple[int, tuple]]:
        sizes = (4, tuple(map(len, self.blobs)))
        out = {WIDTH: (4, (self.width,)), HEIGHT: (4, (self.height,)), BITS: (3, (self.depth,)), COMPRESSION: (3, (1,)), SAMPLES: (3, (self.samples,)), FORMAT: (3, (3 if self.floating else 1,)), PHOTOMETRIC: (3, (GRAY if self.samples == 1 else RGB_KIND,))}
        zeros = (4, (0,) * len(self.blobs))
        out |= {TILE_W: (4, (self.tile[1],)), TILE_H: (4, (self.tile[0],)), TILES: zeros, TILE_BYTES: sizes} if self.tile else {ROWS: (4, (self.height,)), STRIPS: zeros, STRIP_BYTES: sizes}
        return out | self.tags


def container(made: list[Encoded], order: str = "<") -> bytes:
    """A container of one main IFD and sub-IFDs for the other pages."""
    at = 8
    dirs = [page.described() for page in made]
    if len(dirs) > 1:
        dirs[0][SUBIFDS] = (4, (0,) * (len(dirs) - 1))
    # the pages' further directories come behind all pages
    further = [(k, code, page.places[name]) for k, page in enumerate(made) for code, name in PLACES.items() if page.places.get(name)]
    for k, code, _ in further:
        dirs[k][code] = (4, (0,))
    own = [*dirs, *[tags for _, _, tags in further]]

    def encoded(kind: int, values: tuple) -> tuple[int, bytes]:
        if kind == 2:
            text = values[0].encode() + b"\0"
            return len(text), text
        flat = [x for v in values for x in v] if kind in (5, 10) else list(values)
        return len(values), struct.pack(order + TYPES[kind][1] * len(values), *flat)

    def layout(starts: list[int], places: list[int]) -> list[bytes]:
        out = []
        for k, tags in enumerate(own):
            tags = dict(tags)
            if k < len(made):
                ends = np.cumsum([0, *map(len, made[k].blobs)])[:-1]
                tags[TILES if made[k].tile else STRIPS] = (4, tuple(int(places[k] + e) for e in ends))
                if k == 0 and len(dirs) > 1:
                    tags[SUBIFDS] = (4, tuple(starts[1 : len(dirs)]))
                for n, (page, code, _) in enumerate(further):
                    if page == k:
                        tags[code] = (4, (starts[len(dirs) + n],))
            entries, extra, where = [], b"", starts[k] + 2 + 12 * len(tags) + 4
            for code in sorted(tags):
                kind, values = tags[code]
                count, data = encoded(kind, values)
                if len(data) <= 4:
                    cell = data.ljust(4, b"\0")
                else:
                    cell = struct.pack(order + "I", where + len(extra))
                    extra += data + b"\0" * (len(data) % 2)
                entries.append(struct.pack(order + "HHI", code, kind, count) + cell)
            out.append(struct.pack(order + "H", len(tags)) + b"".join(entries) + struct.pack(order + "I", 0) + extra)
        return out

    zero = [0] * len(own)
    sizes = [len(d) for d in layout(zero, zero)]
    starts = [at + sum(sizes[:k]) for k in range(len(own))]
    totals = [sum(map(len, page.blobs)) for page in made]
    places = [at + sum(sizes) + sum(totals[:k]) for k in range(len(made))]
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    return b"".join([head, *layout(starts, places), *[blob for page in made for blob in page.blobs]])


def build(images: list[tuple[np.ndarray, dict[int, tuple[int, tuple]]]], bits: int | None = None, order: str = "<", tile: int | None = None) -> bytes:
    """A container of arrays and their own tags, in strips or tiles of ``tile`` pixels."""
    made = []
    for array, own in images:
        a = array if array.ndim == 3 else array[:, :, None]
        made.append(Encoded(*a.shape, bits or a.dtype.itemsize * 8, a.dtype.kind == "f", _blocks(a, bits, order, tile), own, (tile, tile) if tile else None))
    return container(made, order)


def read_tags(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A row for each tag of each page of the files under ``path``; a file that
    cannot be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return tags_of(files)


def problem(raw: bytes, page: Page) -> str | None:
    """Why a page's pixels cannot be read, as far as its tags and the file's size tell."""
    try:
        if page.first(COMPRESSION, 1) != 1:
            return "compressed pages need a codec that is not here"
        h, w, s, bits = page.first(HEIGHT), page.first(WIDTH), page.first(SAMPLES, 1), page.first(BITS, 8)
        tiled = TILES in page.tags
        th, tw = (page.first(TILE_H), page.first(TILE_W)) if tiled else (min(page.first(ROWS, h), h), w)
        offsets, sizes = page.all(TILES if tiled else STRIPS), page.all(TILE_BYTES if tiled else STRIP_BYTES)
        down, across = -(-h // th), -(-w // tw)
        if min(len(offsets), len(sizes)) < down * across:
            return f"{min(len(offsets), len(sizes))} of {down * across} blocks of pixels are there"
        for i in range(down * across):
            rows = th if tiled else min(th, h - i * th)
            if min(sizes[i], len(raw) - offsets[i]) < rows * (-(-tw * s * bits // 8)):
                return f"block {i} of the pixels ends early"
    except BROKEN as e:
        return f"{type(e).__name__}: {e}"
    return None


# Tags that hold opcode lists.
OPCODE_LISTS = (51009, 51022)


def tags_of(files: DataFrame, check: bool = False) -> DataFrame:
    """``read_tags`` of rows of path and content; with ``check``, opcode lists are parsed
    into a further column ``ops``, and pages whose pixels or opcodes cannot be read have
    a row with the reason."""

    def rows(path: str, ifd: int, place: str, tags: dict[int, tuple[int, tuple]]) -> Iterator[tuple]:
        for code, (kind, values) in tags.items():
            numbers = [v[0] / v[1] if v[1] else float("nan") for v in values] if kind in (5, 10) else [] if kind == 2 else [float(v) for v in values]
            raw = bytes(values) if kind in (1, 7) else None
            row = (path, ifd, place, code, kind, len(values[0].encode()) + 1 if kind == 2 else len(values), numbers, values[0] if kind == 2 else None, raw, None)
            yield row if not check else (*row, opcode_lists.parse(raw) if code in OPCODE_LISTS and raw else None)

    more = [None] if check else []
    schema = TAG_ROWS + (f", ops {opcode_lists.LIST}" if check else "")
    names = [*[c.split()[0] for c in TAG_ROWS.split(", ")], *(["ops"] if check else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf.path, pdf.content):
                try:
                    own: list[tuple] = []
                    for ifd, page in enumerate(pages(bytes(raw))):
                        for place, tags in {"ifd": page.tags, **page.places}.items():
                            own += rows(path, ifd, place, tags)
                        if check and (why := problem(bytes(raw), page)):
                            own.append((path, ifd, *[None] * 7, why, *more))
                    out += own
                except BROKEN as e:
                    out.append((path, *[None] * 8, f"{type(e).__name__}: {e}", *more))
            yield pd.DataFrame(out, columns=names).astype({"ifd": "Int32", "code": "Int32", "dtype": "Int32", "count": "Int64"})

    return by_bytes(files.select("path", "content")).mapInPandas(run, schema)


def pixels_of(files: DataFrame, ifd: int = 0) -> DataFrame:
    """path, y, x, c, v, status and error of a page of each file: the page ``ifd``,
    or that of the column ``ifd``. Files are read one by one; one that cannot be
    read is a row with status "errored" and no pixel."""
    chosen = files if "ifd" in files.columns else files.withColumn("ifd", F.lit(ifd))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw, page in zip(pdf.path, pdf.content, pdf.ifd):
                try:
                    raw = bytes(raw)
                    a = pixels(raw, pages(raw)[int(page)])
                    y, x, c = np.indices(a.shape).reshape(3, -1)
                    yield pd.DataFrame({"path": path, "y": y, "x": x, "c": c.astype(np.int32), "v": a.reshape(-1).astype(float), "status": "ok", "error": None})
                except BROKEN as e:
                    yield pd.DataFrame({"path": [path], "y": [None], "x": [None], "c": [None], "v": [None], "status": ["errored"], "error": [f"{type(e).__name__}: {e}"]}).astype({"y": "Int64", "x": "Int64", "c": "Int32", "v": "Float64"})

    return by_bytes(chosen.select("path", "content", "ifd")).mapInPandas(run, "path string, y long, x long, c int, v double, status string, error string")


#: Rows of pixels that reading hands on at once.
LINES = 256


def samples_of(files: DataFrame) -> DataFrame:
    """path, ifd, y, x and up to three samples a, b and c of the page ``ifd`` of each
    file, one row a pixel; a page that cannot be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw, ifd in zip(pdf.path, pdf.content, pdf.ifd):
                try:
                    raw = bytes(raw)
                    a = pixels(raw, pages(raw)[int(ifd)])
                except BROKEN as e:
                    yield pd.DataFrame({"path": [path], "ifd": [int(ifd)], "y": [None], "x": [None], "a": [None], "b": [None], "c": [None], "error": [f"{type(e).__name__}: {e}"]}).astype({"y": "Int64", "x": "Int64", "a": "Float64", "b": "Float64", "c": "Float64"})
                    continue
                for top in range(0, a.shape[0], LINES):
                    part = a[top : top + LINES].astype(float)
                    y, x = np.indices(part.shape[:2]).reshape(2, -1)
                    planes = {n: part[:, :, i].reshape(-1) if i < part.shape[2] else None for i, n in enumerate("abc")}
                    yield pd.DataFrame({"path": path, "ifd": int(ifd), "y": y + top, "x": x, **planes, "error": None})

    return by_bytes(files.select("path", "content", "ifd")).mapInPandas(run, "path string, ifd int, y long, x long, a double, b double, c double, error string")


def main_pages(tags: DataFrame) -> DataFrame:
    """path and ifd of each file's main page: sub-file type 0, the largest."""
    wide = tags.groupBy("path", "ifd").agg(*[F.max(F.when(F.col("code") == code, F.element_at("value", 1))).alias(name) for name, code in (("subtype", SUBTYPE), ("w", WIDTH), ("h", HEIGHT))])
    return wide.where("coalesce(subtype, 0) = 0").groupBy("path").agg(F.max_by("ifd", F.col("w") * F.col("h")).alias("ifd"))


@dataclass
class PageRows:
    """Pixel rows (image_id, y, x and the channels, whole numbers) of one page of
    each image, their type, and what tags they all get."""

    df: DataFrame
    channels: tuple[str, ...] = ("v",)
    dtype: str = "u2"
    bits: int | None = None
    tags: dict[int, tuple[int, tuple]] = field(default_factory=dict)


#: The format wants edges of tiles in multiples of this.
EDGE = 16


def tile_edge(n: int, tile: int) -> int:
    """Rows or columns to store of a tile of which ``n`` are in use."""
    return min(tile, -(-n // EDGE) * EDGE)


def _grown(blob: bytes, have: tuple[int, int], want: tuple[int, int], bits: int) -> bytes:
    """A packed tile with zeros to more rows and columns; ``bits`` are those of a pixel."""
    if have == want:
        return blob
    width, wide = (-(-n * bits // 8) for n in (have[1], want[1]))
    lines = np.frombuffer(blob, np.uint8).reshape(have[0], width)
    return np.pad(lines, ((0, want[0] - have[0]), (0, wide - width))).tobytes()


def _tile_packer(no: int, channels: tuple[str, ...], dtype: str, bits: int | None, tile: int):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        a = np.zeros((tile_edge(int((y % tile).max()) + 1, tile), tile_edge(int((x % tile).max()) + 1, tile), len(channels)), dtype)
        a[y % tile, x % tile] = pdf[list(channels)].to_numpy()
        return pd.DataFrame({"image_id": [key[0]], "page": [no], "ty": [key[1]], "tx": [key[2]], "h": [int(y.max()) + 1], "w": [int(x.max()) + 1], "blob": [_blocks(a, bits, "<", None)[0]]})

    return pack


#: Rows of tags to be written: where they go, their type, and numbers or a text.
NEW_TAGS = ("image_id", "page", "place", "code", "dtype", "value", "text")
#: Denominators of fractions are no larger.
DENOMINATOR = 1_000_000


def stored(dtype: int, value: list[float] | None, text: str | None) -> tuple[int, tuple]:
    """A row's tag as a directory holds it."""
    if dtype == 2:
        return dtype, (text or "",)
    if dtype in (5, 10):
        parts = [Fraction(float(v)).limit_denominator(DENOMINATOR) for v in value]
        return dtype, tuple((f.numerator, f.denominator) for f in parts)
    if dtype in (1, 7) and value is None:
        return dtype, tuple((text or "").encode())
    return dtype, tuple(float(v) if dtype in (11, 12) else int(v) for v in value)


def encode_pages(made: list[PageRows], tile: int = 256, tags: DataFrame | None = None) -> DataFrame:
    """image_id and content of a container for each image, a page of each member of
    ``made``, the first as the main one.

    Tiles are packed each in a group of its own; a file's header and directories are
    then built from the tiles' sizes. ``tags`` has rows (``NEW_TAGS``) of tags that
    images have of their own; they go over those that a page's images share."""
    kind = made[0].df.schema["image_id"].dataType.simpleString()
    parts = []
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    for no, page in enumerate(made):
        dealt = page.df.select("image_id", "y", "x", *page.channels, at("y").alias("ty"), at("x").alias("tx"))
        pack = _tile_packer(no, page.channels, page.dtype, page.bits, tile)
        parts.append(dealt.groupBy("image_id", "ty", "tx").applyInPandas(pack, f"image_id {kind}, page int, ty int, tx int, h long, w long, blob binary"))
    tiles = parts[0]
    for p in parts[1:]:
        tiles = tiles.union(p)
    specs = [(len(p.channels), np.dtype(p.dtype).str, p.bits, p.tags) for p in made]
    described = tiles.withColumn("spec", F.col("page"))
    return containers(described, specs, tile, tags)


def containers(tiles: DataFrame, specs: list[tuple[int, str, int | None, dict]], tile: int, tags: DataFrame | None = None) -> DataFrame:
    """Containers of packed tiles (image_id, page, spec, ty, tx, h, w, blob): ``spec`` is
    a place in ``specs`` (samples, type, bits and tags of the page), h and w are the
    image's edge so far as the tile knows it, and a blob stores its tile up to there
    (``tile_edge``). Pages smaller than a tile have a tile that is no larger than they ask."""
    cells = F.sort_array(F.collect_list(F.struct("page", "ty", "tx", "h", "w", "spec", "blob")))
    whole = tiles.groupBy("image_id").agg(cells.alias("cells"))
    if tags is None:
        whole = whole.withColumn("tags", F.array().cast("array<struct<page:int,place:string,code:int,dtype:int,value:array<double>,text:string>>"))
    else:
        own = tags.groupBy("image_id").agg(F.collect_list(F.struct(*NEW_TAGS[1:])).alias("tags"))
        whole = whole.join(own, "image_id", "left")

    def build_all(column: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for cells_, tags_ in zip(column, given):
            made: list[Encoded] = []
            for no in sorted({c["page"] for c in cells_}):
                some = [c for c in cells_ if c["page"] == no]
                samples, dtype, bits, shared = specs[some[0]["spec"]]
                dtype = np.dtype(dtype)
                places: dict[str, dict] = {"ifd": dict(shared)}
                for t in [] if tags_ is None else tags_:
                    if t["page"] == no:
                        places.setdefault(t["place"], {})[t["code"]] = stored(t["dtype"], t["value"], t["text"])
                top = places.pop("ifd")
                h, w, depth = max(c["h"] for c in some), max(c["w"] for c in some), bits or dtype.itemsize * 8
                edges = tile_edge(h, tile), tile_edge(w, tile)
                own = lambda c: (tile_edge(c["h"] - c["ty"] * tile, tile), tile_edge(c["w"] - c["tx"] * tile, tile))
                made.append(Encoded(h, w, samples, depth, dtype.kind == "f", [_grown(bytes(c["blob"]), own(c), edges, samples * depth) for c in some], top, edges, places))
            out.append(container(made))
        return pd.Series(out)

    return by_bytes(whole).select("image_id", F.pandas_udf(build_all, "binary")("cells", "tags").alias("content"))


def encode_images(df: DataFrame, bits: int | None = None, dtype: str = "u2", tile: int = 256) -> DataFrame:
    """image_id and content of a one-page container for each image of (image_id, y, x, v)."""
    return encode_pages([PageRows(df, ("v",), dtype, bits)], tile)
