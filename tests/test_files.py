"""File jobs: previews, linear pages, rendering, copies, and batches with broken files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkroom.functions import colour
from sparkroom.operators import tags
from sparkroom.plans import convert, frames
from sparkroom.sources import fits, opcode_lists, tiff

RAW = {tiff.PHOTOMETRIC: (3, (tiff.CFA,)), convert.CFA_PATTERN: (1, (0, 1, 1, 2)), convert.BLACK: (3, (64,)), convert.WHITE: (3, (1023,))}
PREVIEW = {tiff.SUBTYPE: (4, (1,))}


def files(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).select("path", "content")


def name(path):
    return path.rsplit("/", 1)[1]


def image(df, path_end):
    rows = df.where(F.endswith("path", F.lit(path_end))).collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1, 3), np.nan)
    for r in rows:
        out[r.y, r.x] = r.r, r.g, r.b
    return out


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    flat = np.full((6, 8), 64 + 480, np.uint16)
    small = rng.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    linear = rng.integers(0, 65536, (8, 12, 3)).astype(np.uint16)
    (tmp_path / "raw.dng").write_bytes(tiff.build([(flat, RAW), (small, PREVIEW)]))
    (tmp_path / "turned.dng").write_bytes(tiff.build([(flat, RAW | {convert.ORIENTATION: (3, (6,)), convert.CROP_AT: (4, (1, 1)), convert.CROP_SIZE: (4, (5, 4)), convert.EXPOSURE: (10, ((1, 1),))})]))
    (tmp_path / "linear.dng").write_bytes(tiff.build([(linear, {tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,))})], order=">"))
    (tmp_path / "plain.tif").write_bytes(tiff.build([(small, {})]))
    (tmp_path / "broken.dng").write_bytes(b"II*\0nothing")
    return tmp_path, small, linear


def test_previews_and_linear_pages(spark, folder):
    path, small, linear = folder
    px, status = convert.preview_rgb(files(spark, path))
    assert np.allclose(image(px, "raw.dng"), small / 255) and np.allclose(image(px, "plain.tif"), small / 255)
    assert {name(r.path): r.error for r in status.collect() if r.status == "errored" and "broken" not in r.path} == {"turned.dng": "no preview page", "linear.dng": "no preview page"}
    px, status = convert.linear_raw(files(spark, path))
    assert np.allclose(image(px, "linear.dng"), linear / 65535)
    assert {name(r.path) for r in status.collect() if r.status == "ok"} == {"linear.dng"}


def test_mosaics(spark, folder):
    path, _, _ = folder
    px, status = convert.mosaics(files(spark, path), "raw")
    rows = px.where(F.endswith("path", F.lit("raw.dng"))).collect()
    assert len(rows) == 48 and {(r.v, r.pattern) for r in rows} == {(544.0, "RGGB")}
    px, _ = convert.mosaics(files(spark, path))
    assert {round(r.v, 9) for r in px.collect()} == {round(480 / 959, 9)}
    assert {name(r.path) for r in status.collect() if r.status == "ok"} == {"raw.dng", "turned.dng"}


def displayed(rgb, exposure=0.0, matrix=None):
    """Camera values by the order of the rendering document, with no shadows and a straight
    curve: ProPhoto, exposure, and the display's gamut last."""
    out = colour.prophoto_to_srgb()
    work = rgb @ (np.linalg.inv(out) if matrix is None else matrix).T
    final = ((work * 2.0 ** max(exposure, 0)).clip(0, 1) @ out.T).clip(0, 1)
    return np.where(final <= 0.0031308, final * 12.92, final ** (1 / 2.4) * 1.055 - 0.055)


def test_render_of_files(spark, folder):
    path, small, linear = folder
    own = files(spark, path)
    settings = own.where(F.endswith("path", F.lit("linear.dng"))).select("path", F.lit(1.0).alias("Exposure2012"), F.lit(3).alias("orientation"))
    px, status = convert.render_files(own, settings, shadows=0.0, curve=None)
    assert np.allclose(image(px, "raw.dng"), displayed(np.full((6, 8, 3), 480 / 959)))
    assert np.allclose(image(px, "turned.dng"), displayed(np.full((5, 4, 3), 480 / 959), 1.0))  # one stop brighter, cropped and turned
    assert np.allclose(image(px, "linear.dng"), displayed(linear / 65535, 1.0)[::-1, ::-1], atol=1e-6)
    assert np.allclose(image(px, "plain.tif"), small / 255)
    assert {name(r.path): r.status for r in status.collect()} == {"raw.dng": "ok", "turned.dng": "ok", "linear.dng": "ok", "plain.tif": "ok", "broken.dng": "errored"}


def test_colour_of_files(spark, tmp_path):
    matrix = [0.9, -0.3, -0.1, -0.4, 1.2, 0.2, -0.05, 0.2, 0.6]
    fractions = lambda values: tuple((round(v * 10000), 10000) for v in values)
    tags = {tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,)), convert.COLOUR1: (10, fractions(matrix)), convert.NEUTRAL: (5, fractions((0.6, 1.0, 0.7))), convert.ILLUMINANT1: (3, (21,))}
    (tmp_path / "c.dng").write_bytes(tiff.build([(np.full((2, 2, 3), (6000, 10000, 7000), np.uint16), tags)]))
    settings = spark.createDataFrame([("c.dng", 3200.0, 10.0), ("other.dng", 9000.0, None)], "filename string, Temperature double, Tint double")
    px, _ = convert.render_files(files(spark, tmp_path), settings, shadows=0.0, curve=None)
    white = colour.xy_of_uv(*colour.uv_of_temperature(3200.0, 10.0))
    camera = np.array((6000, 10000, 7000)) / 65535
    want = displayed(camera, matrix=colour.working_matrix(matrix, None, (21, 21), (0.6, 1.0, 0.7), white=white))
    assert np.allclose(image(px, "c.dng")[0, 0], want, atol=1e-6)
    px, _ = convert.render_files(files(spark, tmp_path), shadows=0.0, curve=None)
    got = image(px, "c.dng")[0, 0]
    assert np.allclose(got, displayed(camera, matrix=colour.working_matrix(matrix, None, (21, 21), (0.6, 1.0, 0.7))), atol=1e-6) and np.ptp(got) < 0.005  # the neutral is grey


def test_copies_with_levels_and_preview(spark, folder):
    path, _, linear = folder
    made = convert.copy_pages(files(spark, path).where(F.endswith("path", F.lit("linear.dng"))), levels=3, least=2, source=4).first().content
    pages = tiff.pages(bytes(made))
    assert [(p.first(tiff.HEIGHT), p.first(tiff.WIDTH), p.first(tiff.SUBTYPE, 0), p.first(tiff.BITS)) for p in pages] == [(8, 12, 0, 16), (4, 6, 1, 16), (2, 3, 1, 16), (2, 3, 1, 8)]
    assert np.array_equal(tiff.pixels(bytes(made), pages[0]), linear)
    small = convert.copy_pages(files(spark, path).where(F.endswith("path", F.lit("linear.dng"))), levels=3).first().content
    assert [(p.first(tiff.HEIGHT), p.first(tiff.SUBTYPE, 0)) for p in tiff.pages(bytes(small))] == [(8, 0), (8, 1)]  # too small for a pyramid
    half = linear.reshape(4, 2, 6, 2, 3).mean((1, 3))
    assert np.abs(tiff.pixels(bytes(made), pages[1]).astype(float) - half).max() <= 0.5


def test_batch_with_broken_and_existing_files(spark, folder, tmp_path_factory):
    path, small, _ = folder
    out = tmp_path_factory.mktemp("out")
    own = files(spark, path)
    result = {name(r.path): r for r in convert.convert(own, f"file://{out}").collect()}
    assert {k: r.status for k, r in result.items()} == {"raw.dng": "written", "turned.dng": "written", "linear.dng": "written", "plain.tif": "written", "broken.dng": "errored"}
    assert result["broken.dng"].error and result["raw.dng"].error is None
    raw = (out / "plain.tif").read_bytes()
    assert np.array_equal(tiff.pixels(raw, tiff.pages(raw)[0]), small) and sorted(p.name for p in out.iterdir()) == ["linear.tif", "plain.tif", "raw.tif", "turned.tif"]
    there = spark.createDataFrame([("raw.tif",), ("plain.tif",)], "name string")
    again = {name(r.path): r.status for r in convert.convert(own, f"file://{out}", existing=there).collect()}
    assert again["raw.dng"] == again["plain.tif"] == "skipped" and again["linear.dng"] == "written" and again["broken.dng"] == "errored"


def test_tiles_of_many_images(spark):
    rng = np.random.default_rng(2)
    images = {i: rng.integers(0, 1024, (5 + i, 9)) for i in range(3)}
    rows = [(i, y, x, int(a[y, x])) for i, a in images.items() for y in range(a.shape[0]) for x in range(9)]
    made = tiff.encode_images(spark.createDataFrame(rows, "image_id int, y long, x long, v long"), bits=10, tile=4).collect()
    for r in made:
        raw = bytes(r.content)
        assert np.array_equal(tiff.pixels(raw, tiff.pages(raw)[0])[:, :, 0], images[r.image_id])


def test_many_levels_are_one_plan(spark, tmp_path):
    """Two hundred files with black levels of their own: one reading of the contents."""
    for i in range(200):
        (tmp_path / f"{i}.dng").write_bytes(tiff.build([(np.full((2, 2), 300 + i, np.uint16), RAW | {convert.BLACK: (3, (i,))})]))
    px, status = convert.render_files(files(spark, tmp_path), shadows=0.0, curve=None)
    plan = px._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1 and plan.count("MapInPandas") == 1
    rows = {(name(r.path), round(r.r, 6)) for r in px.collect()}
    assert rows == {(f"{i}.dng", round(displayed(np.full(3, 300 / (1023 - i)))[0], 6)) for i in range(200)}
    assert {r.status for r in status.collect()} == {"ok"}


def test_unreadable_pages_have_their_error(spark, tmp_path):
    whole = tiff.build([(np.full((6, 8), 500, np.uint16), RAW)])
    (tmp_path / "short.dng").write_bytes(whole[:-40])
    (tmp_path / "packed.dng").write_bytes(tiff.build([(np.full((6, 8), 500, np.uint16), RAW | {tiff.COMPRESSION: (3, (7,))})]))
    (tmp_path / "opcode.dng").write_bytes(tiff.build([(np.full((6, 8), 500, np.uint16), RAW | {convert.OPCODES3: (7, tuple(opcode_lists.build([{"id": 14}])))})]))
    (tmp_path / "optional.dng").write_bytes(tiff.build([(np.full((6, 8), 500, np.uint16), RAW | {convert.OPCODES3: (7, tuple(opcode_lists.build([{"id": 14, "optional": True}])))})]))
    (tmp_path / "damaged.dng").write_bytes(tiff.build([(np.full((6, 8), 500, np.uint16), RAW | {convert.OPCODES2: (7, (0, 0, 0, 9, 1))})]))
    out = tmp_path / "out"
    got = {name(r.path): (r.status, r.error) for r in convert.convert(files(spark, tmp_path), f"file://{out}").collect()}
    assert got["optional.dng"] == ("written", None) and sorted(p.name for p in out.iterdir()) == ["optional.tif"]
    assert got["short.dng"] == ("errored", "block 0 of the pixels ends early") and "codec" in got["packed.dng"][1]
    assert got["opcode.dng"] == ("errored", "opcodes not taken: 14") and got["damaged.dng"][0] == "errored" and got["damaged.dng"][1]


def test_names_of_outputs(spark):
    names = lambda paths, **k: {r.path: r["name"] for r in convert.output_names(spark.createDataFrame([(p,) for p in paths], "path string"), ".tif", **k).collect()}
    assert names(["f:/in/a/x.dng", "f:/in/b/x.dng"]) == {"f:/in/a/x.dng": "a/x.tif", "f:/in/b/x.dng": "b/x.tif"}
    assert names(["/in/x.dng", "/in/x.raw", "/in/y.dng"]) == {"/in/x.dng": "x.dng.tif", "/in/x.raw": "x.raw.tif", "/in/y.dng": "y.tif"}
    assert names(["/in/x.dng", "/in/x.dng"]) == {"/in/x.dng": None}
    assert names(["/in/s/x.dng"], root="/in") == {"/in/s/x.dng": "s/x.tif"} and names([]) == {}


def test_levels_by_row_column_and_table(spark, tmp_path):
    """Black with a repeating block and deltas after a table, white by sample; without a
    block's size only the first of several levels counts."""
    a = np.arange(24, dtype=np.uint16).reshape(4, 6)
    table = tuple(v * 10 for v in range(20))
    own = RAW | {convert.TABLE: (3, table), convert.BLACK_DIM: (3, (2, 2)), convert.BLACK: (3, (1, 2, 3, 4)), convert.DELTA_H: (10, tuple((i, 2) for i in range(6))), convert.DELTA_V: (10, tuple((i, 4) for i in range(4))), convert.WHITE: (3, (200,))}
    (tmp_path / "a.dng").write_bytes(tiff.build([(a, own)]))
    (tmp_path / "b.dng").write_bytes(tiff.build([(a, RAW | {convert.BLACK: (3, (1, 2, 3, 4)), convert.WHITE: (3, (23,))})]))
    px, _ = convert.mosaics(files(spark, tmp_path))
    y, x = np.indices(a.shape)
    black = np.array([[1, 2], [3, 4]])[y % 2, x % 2] + x / 2 + y / 4
    want = {"a.dng": ((np.array(table)[np.minimum(a, 19)] - black) / (200 - black)).clip(0, 1), "b.dng": ((a.astype(float) - 1) / 22).clip(0, 1)}
    for r in px.collect():
        assert abs(r.v - want[name(r.path)][r.y, r.x]) < 1e-12


def test_further_directories_in_both_byte_orders(spark, tmp_path):
    a = np.arange(12, dtype=np.uint16).reshape(3, 4)
    places = {"exif": {34855: (3, (400,)), 36867: (2, ("2024:01:02 03:04:05",))}, "gps": {1: (2, ("N",)), 2: (5, ((52, 1), (30, 1), (0, 1)))}}
    for order, stem in (("<", "little"), (">", "big")):
        made = [tiff.Encoded(3, 4, 1, 16, False, tiff._blocks(a[:, :, None], None, order, None), {271: (2, ("maker",))}, None, places), tiff.Encoded(3, 4, 1, 16, False, tiff._blocks(a[:, :, None], None, order, None), {}, None, {"exif": {34855: (3, (7,))}})]
        (tmp_path / f"{stem}.dng").write_bytes(tiff.container(made, order))
    rows = tiff.read_tags(spark, str(tmp_path)).where("place <> 'ifd'").collect()
    for stem in ("little", "big"):
        own = {(r.ifd, r.place, r.code): (r.text or tuple(r.value)) for r in rows if name(r.path) == f"{stem}.dng"}
        assert own == {(0, "exif", 34855): (400.0,), (0, "exif", 36867): "2024:01:02 03:04:05", (0, "gps", 1): "N", (0, "gps", 2): (52.0, 30.0, 0.0), (1, "exif", 34855): (7.0,)}
    px = tiff.pixels_of(files(spark, tmp_path)).where("v is not null").collect()
    assert len(px) == 24 and all(r.v == a[r.y, r.x] for r in px)


def test_outputs_keep_tags(spark, tmp_path):
    a = np.full((4, 4), 500, np.uint16)
    made = tiff.Encoded(4, 4, 1, 16, False, tiff._blocks(a[:, :, None], None, "<", None), RAW | {271: (2, ("maker",)), convert.ORIENTATION: (3, (3,))}, None, {"exif": {33434: (5, ((1, 8),))}})
    (tmp_path / "a.dng").write_bytes(tiff.container([made]))
    out = tmp_path / "out"
    convert.convert(files(spark, tmp_path), f"file://{out}").collect()
    page = tiff.pages((out / "a.tif").read_bytes())[0]
    assert page.first(271) == "maker" and page.places["exif"][33434] == (5, ((1, 8),))
    assert not {convert.ORIENTATION, convert.CFA_PATTERN, convert.BLACK, convert.WHITE} & page.tags.keys()


def test_copies_of_mixed_sizes_render_like_their_sources(spark, tmp_path):
    """Linear files and a mosaic of different sizes and colours, copied in one job."""
    rng = np.random.default_rng(5)
    colour_tags = {convert.COLOUR1: (10, tuple((round(v * 10000), 10000) for v in (0.9, -0.3, -0.1, -0.4, 1.2, 0.2, -0.05, 0.2, 0.6))), convert.NEUTRAL: (5, ((6, 10), (1, 1), (7, 10))), convert.ILLUMINANT1: (3, (21,)), convert.ORIENTATION: (3, (6,)), convert.EXPOSURE: (10, ((-1, 2),))}
    sizes = {"a.dng": (8, 12), "b.dng": (16, 10)}
    for stem, (h, w) in sizes.items():
        levels = {convert.BLACK: (3, (100,)), convert.WHITE: (4, (60_000,))}
        (tmp_path / stem).write_bytes(tiff.build([(rng.integers(0, 65536, (h, w, 3)).astype(np.uint16), {tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,))} | colour_tags | levels)]))
    (tmp_path / "m.dng").write_bytes(tiff.build([(rng.integers(64, 1024, (10, 10)).astype(np.uint16), RAW | colour_tags)]))
    own = files(spark, tmp_path)
    made = convert.copy_pages(own, levels=1, least=4, source=8, demosaic="bilinear")
    copies = {name(r.path): tiff.pages(bytes(r.content)) for r in made.collect()}
    shapes = {k: [(p.first(tiff.HEIGHT), p.first(tiff.WIDTH), p.first(tiff.SUBTYPE, 0)) for p in v] for k, v in copies.items()}
    assert shapes == {"a.dng": [(8, 12, 0), (4, 6, 1), (4, 6, 1)], "b.dng": [(16, 10, 0), (8, 5, 1), (8, 5, 1)], "m.dng": [(10, 10, 0), (5, 5, 1), (5, 5, 1)]}
    before, after = (convert.render_files(f)[0].withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1)).select("path", "y", "x", *[F.col(c).alias(f"{c}{n}") for c in "rgb"]) for n, f in enumerate((own, made)))
    joined = before.join(after, ["path", "y", "x"]).collect()
    assert len(joined) == 96 + 160 + 100
    assert max(abs(r[f"{c}0"] - r[f"{c}1"]) for r in joined for c in "rgb") < 2e-3


def test_frames_to_dng(spark, tmp_path):
    """Frames of several types, by hand-set exposure, with stripped and extra tags."""
    (tmp_path / "u8.fits").write_bytes(fits.build(np.arange(60, dtype=np.uint8).reshape(6, 10), {"INSTRUME": "cam", "GAIN": 7.9}))
    (tmp_path / "f8.fit").write_bytes(fits.build(np.linspace(0, 1, 60).reshape(6, 10), {"OBJECT": "M 1", "DATE-OBS": "2024-01-02T03:04:05"}))
    (tmp_path / "u4.fits").write_bytes(fits.build(np.full((3, 300), 2**31 + 5, np.uint32), {}))
    raw = fits.build(np.arange(20, dtype=np.uint16).reshape(4, 5), {"BSCALE": 0.5})
    (tmp_path / "scaled.fits").write_bytes(raw)
    (tmp_path / "no.fits").write_bytes(b"nothing")
    (tmp_path / "later.fits").write_bytes(fits.build(np.ones((2, 2), np.uint8), {}) + b"x" * 2880)
    out = tmp_path / "out"
    got = {name(r.path): (r.status, r.error) for r in frames.convert_frames(files(spark, tmp_path), f"file://{out}", exposure=1.5, linear=True, white_xy=(0.31, 0.33), strip=["Software", "UniqueCameraModel"], extra={"Make": ["me"]}).collect()}
    assert got.pop("no.fits")[0] == "errored" and set(got.values()) == {("written", None)}
    pages = {p.name: tiff.pages(p.read_bytes())[0] for p in out.iterdir()}
    image_of = lambda n: tiff.pixels((out / n).read_bytes(), pages[n])[:, :, 0]
    assert np.array_equal(image_of("u8.dng"), np.arange(60).reshape(6, 10)) and np.allclose(image_of("f8.dng"), np.linspace(0, 1, 60).reshape(6, 10))
    assert np.array_equal(image_of("u4.dng"), np.full((3, 300), 2**31 + 5)) and np.array_equal(image_of("scaled.dng"), np.arange(20).reshape(4, 5) * 0.5 + 2**14)  # stored around 2^15
    p = pages["u8.dng"]
    assert p.first(271) == "me" and 50708 not in p.tags and p.first(convert.EXPOSURE) == (3, 2) and p.all(convert.TONE) == (0.0, 0.0, 1.0, 1.0)
    assert p.all(convert.WHITE_XY) == ((31, 100), (33, 100)) and p.first(tiff.PHOTOMETRIC) == tiff.LINEAR_RAW and p.places["exif"][34855] == (3, (7,))
    assert pages["f8.dng"].places["exif"][36867][1] == ("2024:01:02 03:04:05",) and b"avm:Subject.Name=\"M 1\"" in bytes(pages["f8.dng"].all(tiff.XMP))
    there = spark.createDataFrame([("u8.dng",)], "name string")
    again = {name(r.path): r.status for r in frames.convert_frames(files(spark, tmp_path), f"file://{out}", existing=there).collect()}
    assert again["u8.fits"] == "skipped" and again["f8.fit"] == "written" and again["no.fits"] == "errored"


def test_packets_of_other_writers(spark):
    packet = """<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r"><rdf:Description rdf:about="" xmlns:dc="d" dc:format='image/"x"' crs:Exposure2012 = "+0.50">
      <dc:title><rdf:Alt><rdf:li xml:lang="x-default">A &amp; B</rdf:li></rdf:Alt></dc:title><crs:Crop>True</crs:Crop></rdf:Description>
      <rdf:Description crs:Exposure2012="+1.00"/></rdf:RDF></x:xmpmeta>"""
    df = spark.createDataFrame([(packet,), ("",), (None,)], "p string")
    got = [r.m for r in df.select(tags.xmp_lists(F.col("p")).alias("m")).collect()]
    assert got[0] == {"dc:format": ['image/"x"'], "crs:Exposure2012": ["+1.00"], "dc:title": ["A & B"], "crs:Crop": ["True"]}
    assert not got[1] and not got[2]
