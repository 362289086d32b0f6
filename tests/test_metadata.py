"""Tags, times, files and streams."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkroom.operators import batch, fits as fits_ops, tags, times
from sparkroom.operators.sequence import number_rows
from sparkroom.sources import files, fits, tiff
from sparkroom.streaming import frames


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_shift_parser(spark):
    cases = {"+1:30": 5400, "-2 04:00:00": -187200, " 00:00:01 ": 1, "1:2": 3720, "178:00": 640800, "5": 18000, "1 2": 93600, "": 0, "x": None, "1:2:3:4": None, "+": None, "1:": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", times.shift_seconds(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases


def test_fits_dates(spark):
    texts = ["2024-01-02T03:04:05.123456", "2024-01-02T03:04:05.5", "2024-01-02T03:04:05", "2024-01-02", "2024-13-02", "soon", None]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", times.fits_datetime(F.col("t")).alias("d")).orderBy("i").collect()]
    d = datetime.datetime
    assert got == [d(2024, 1, 2, 3, 4, 5, 123456), d(2024, 1, 2, 3, 4, 5, 500000), d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2), None, None, None]


def test_gain_and_scale(spark):
    row = one(spark, fits_ops.iso_of_gain(F.lit(0.0)), fits_ops.iso_of_gain(F.lit(50.0)), fits_ops.iso_of_gain(F.lit(999.0)), fits_ops.balance_ratio(F.lit(100.0)), fits_ops.spatial_scale(F.lit(0.001)), fits_ops.spatial_scale(F.lit(3.6)))
    assert list(row)[:3] == [100, 169, 849]  and row[3] == 1.0
    assert row[4] == [-0.001, 0.001] and row[5] == pytest.approx([-0.001, 0.001])


def test_merge_and_difference(spark):
    a = spark.createDataFrame([(1, 0, "A", "1"), (1, 0, "B", "2")], "image_id int, ifd int, name string, value string")
    b = spark.createDataFrame([(1, 0, "B", None), (1, 0, "C", "3")], "image_id int, ifd int, name string, value string")
    assert {r.name: r.value for r in tags.merge(a, b).collect()} == {"A": "1", "B": None, "C": "3"}
    assert {(r.name, r.side) for r in tags.difference(a, b).collect()} == {("A", "missing"), ("C", "extra")}
    assert [r.name for r in tags.compare(a, b).collect()] == ["B"]
    assert tags.merge(a, b.limit(0)).count() == 2
    assert [r.name for r in tags.strip(a, b).collect()] == ["A"]


def test_registry_rules(spark):
    assert one(spark, tags.infer_type(F.array(F.lit("SHORT")), F.lit("float")), tags.infer_type(F.array(F.lit("SHORT"), F.lit("LONG")), F.lit("float")), tags.infer_type(F.array(F.lit("SHORT"), F.lit("LONG")), F.lit("int")))[:] == ("SHORT", "RATIONAL", "LONG")
    row = one(spark, tags.encode(F.lit("ASCII"), F.lit(0.0), F.lit("Hello")).alias("a"), tags.encode(F.lit("RATIONAL"), F.lit(0.5), F.lit("")).alias("r"))
    assert row.a["count"] == 6 and row.r["num"] / row.r["den"] == 0.5


def test_xmp(spark):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.25, 0.1), (0.5, 0.5), (0.75, 0.9), (1.0, 1.0))])
    row = one(spark, tags.curve_points_to_xmp(pts).alias("p"), tags.xmp_values(tags.xmp_packet(F.create_map(F.lit("a:b"), F.lit('x<&">'), F.lit("c:d"), F.lit("2")))).alias("m"))
    assert row.p == ["0, 0", "64, 26", "128, 128", "191, 230", "255, 255"]
    assert row.m == {"a:b": 'x<&">', "c:d": "2"}


@pytest.mark.parametrize("order", "<>")
def test_tiff_pages(order):
    main, small = np.arange(12, dtype=np.uint16).reshape(3, 4), np.ones((2, 2, 3), np.uint8)
    raw = tiff.build([(main, {271: (2, ("maker",)), 33434: (5, ((1, 50),))}), (small, {254: (4, (1,))})], order=order)
    pages = tiff.pages(raw)
    assert [p.first(tiff.WIDTH) for p in pages] == [4, 2] and pages[0].first(271) == "maker" and pages[0].first(33434) == (1, 50)
    assert np.array_equal(tiff.pixels(raw, pages[0])[:, :, 0], main) and np.array_equal(tiff.pixels(raw, pages[1]), small)
    with pytest.raises(ValueError):
        tiff.pages(b"nothing here")


@pytest.mark.parametrize("tile, bits, shape", [(4, None, (9, 6, 1)), (8, None, (5, 5, 3)), (4, 10, (7, 10, 1)), (None, 12, (3, 5, 1))])
def test_tiff_tiles(tile, bits, shape):
    a = np.random.default_rng(2).integers(0, 2 ** (bits or 16), shape).astype(np.uint16)
    raw = tiff.build([(a, {}), (a[:2], {})], bits=bits, tile=tile)
    for page, want in zip(tiff.pages(raw), (a, a[:2])):
        assert np.array_equal(tiff.pixels(raw, page), want)


@pytest.mark.parametrize("bits", [3, 10, 12])
def test_bit_packing(bits):
    a = np.random.default_rng(1).integers(0, 2**bits, (5, 7)).astype(np.uint16)
    packed = tiff.pack_bits(a, bits)
    assert len(packed) == 5 * -(-7 * bits // 8)
    assert np.array_equal(tiff.unpack_bits(packed, 5, 7, bits), a)


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "f4", "f8"])
def test_fits_files(kind):
    a = (np.arange(12).reshape(3, 4) * 7).astype(kind)
    got = fits.image(fits.build(a, {"OBJECT": "M 31", "GAIN": 100}))
    assert np.array_equal(got, a) and got.dtype.itemsize <= 4
    assert fits.units(fits.build(a, {"OBJECT": "M 31", "GAIN": 100}))[0][0]["OBJECT"] == "M 31"


def test_files_and_errors(spark, tmp_path):
    a = np.arange(6, dtype=np.uint16).reshape(2, 3)
    (tmp_path / "b.dng").write_bytes(tiff.build([(a, {})]))
    (tmp_path / "a.DNG").write_bytes(b"broken")
    (tmp_path / "s.csv").write_text("filename,Temperature,Tint,Exposure2012,orientation\nb.dng,5500,10,0.5,6\n")
    listed = [r.path.rsplit("/", 1)[1] for r in files.folder(spark, str(tmp_path), (".dng",)).collect()]
    assert listed == ["a.DNG", "b.dng"]
    (tmp_path / "c.dng").write_bytes(tiff.build([(a, {})])[:40])
    both = spark.read.format("binaryFile").option("pathGlobFilter", "*.{dng,DNG}").load(str(tmp_path)).select("path", "content")
    px = tiff.pixels_of(both)
    assert sorted((r.path.rsplit("/", 1)[1], r.status) for r in px.select("path", "status").distinct().collect()) == [("a.DNG", "errored"), ("b.dng", "ok"), ("c.dng", "errored")]
    assert px.where("status = 'ok'").count() == 6 and px.where("error is null").count() == 6
    (tmp_path / "c.dng").unlink()
    t = tiff.read_tags(spark, str(tmp_path), "*.{dng,DNG}")
    assert t.where("error is not null").count() == 1 and t.where("code = 256").first()["value"] == [3.0]
    assert tiff.main_pages(t.where("error is null")).first().ifd == 0
    s = files.settings(spark, str(tmp_path / "s.csv")).first()
    assert (s.Temperature, s.orientation) == (5500.0, 6)


def test_sequence_and_batch(spark, sf):
    names = spark.createDataFrame([(f"f{i % 40:02}", i) for i in range(100)], "name string, i int")
    got = number_rows(names, ["name", "i"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(100)) and [(r.name, r.i) for r in got] == sorted((f"f{i % 40:02}", i) for i in range(100))
    left = batch.select_inputs(names, names.where("i < 10").select("name"))
    assert left.count() == 100 - sum(1 for i in range(100) if i % 40 < 10)


def test_headers_to_tags(spark):
    head = {"INSTRUME": " ZWO ASI676MC", "GAIN": "0", "WB_RED": "40", "WB_BLUE": "100", "DATE-OBS": "2024-01-31T23:59:59", "PEDESTAL": "12", "EXPTIME": "0.5", "BAYERPAT": " rggb "}
    rows = [(1, head, 5, 1.5), (2, {"GAIN": "7.9", "PEDESTAL": ""}, 5, None), (3, {}, None, None)]
    df = spark.createDataFrame(rows, "image_id int, header map<string,string>, black long, exposure double")
    got = {(r.image_id, r.name): r.value for r in fits_ops.dng_tags(df, seconds=F.lit(2), zone="+01:00").collect()}
    own = {n: v for (i, n), v in got.items() if i == 1}
    assert own["ISOSpeedRatings"] == ["100"] and own["AnalogBalance"] == ["0.5", "1.0", "1.0"] and own["DateTimeOriginal"] == ["2024:02:01 00:00:01"]
    assert own["BlackLevel"] == ["12"] and own["CFAPattern"] == ["RGGB"] and own["BaselineExposure"] == ["1.5"] and own["OffsetTime"] == ["+01:00"]
    assert got[2, "ISOSpeedRatings"] == ["7"] and got[2, "BlackLevel"] == ["5"] and (2, "DateTimeOriginal") not in got
    assert {n for i, n in got if i == 3} == {"OffsetTimeOriginal", "OffsetTimeDigitized", "OffsetTime"}
    m = spark.createDataFrame([(1, {"OBJCTRA": "05 30 00", "OBJCTDEC": "-10 30 00", "CROTA1": "0", "CROTA2": "4"}), (2, {"RA": "x", "DEC": "5"}), (3, {"RA": "1", "DEC": "91"})], "i int, h map<string,string>").select("i", fits_ops.avm(F.col("h")).alias("m")).orderBy("i").collect()
    assert [float(v) for v in m[0].m["Spatial.ReferenceValue"]] == [82.5, -10.5] and m[0].m["Spatial.Rotation"] == ["4.0"] and m[0].m["Spatial.CoordinateFrame"] == ["ICRS"]
    assert set(m[1].m) == set(m[2].m) == {"Type", "MetadataVersion"}


def test_operations_on_tag_sets(spark):
    t = spark.createDataFrame([(1, 0, "A", "1"), (1, 0, "B", "2"), (2, 0, "B", "3")], "image_id int, ifd int, name string, value string")
    ops = [{"type": "set", "name": "A", "value": "x"}, {"type": "strip", "name": "A"}, {"type": "strip", "name": "B"}, {"type": "shift-time", "value": "1:00"}]
    assert sorted(map(tuple, tags.apply_ops(t, ops).collect())) == [(1, 0, "A", "x"), (2, 0, "A", "x")]
    assert tags.apply_ops(t, []).count() == 3 and tags.apply_ops(t.limit(0), ops).count() == 0


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    q = frames.run_once(frames.arriving(spark, src, events.schema).select("event_id", "value"), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    w = frames.windowed_levels(frames.arriving(spark, src, events.schema))
    assert w.isStreaming and w.columns == ["start", "n", "mean", "low", "high"]
