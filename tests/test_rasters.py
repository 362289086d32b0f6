"""Literal vectors and metamorphic properties of raster operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkroom.functions import colour, points
from sparkroom.operators import geometry, opcodes, statistics, stencil, tiles
from sparkroom.operators.raster import RGB, Raster


def raster(spark, a):
    a = np.asarray(a, float)
    rows = [(0, int(y), int(x), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return Raster(spark.createDataFrame(rows, "image_id int, y long, x long, v double"), *a.shape)


def array(r, c="v"):
    out = np.full((r.height, r.width), np.nan)
    for row in r.df.select("y", "x", c).collect():
        out[row.y, row.x] = row[c]
    return out


def test_span_and_crops(spark):
    r = (geometry.crop(raster(spark, np.arange(1, 10).reshape(3, 3)) - 1, 1, 1, 2, 2)) * 2
    assert array(r).tolist() == [[8, 10], [14, 16]]
    ramp = raster(spark, np.add.outer(10 * np.arange(8), np.arange(8)))
    r = geometry.crop(geometry.crop(ramp, 1, 1, 6, 6) - 1, 1, 1, 4, 4) - 2
    a = array(r)
    assert (a[0, 0], a[0, 3], a[3, 0], a[3, 3]) == (19, 22, 49, 52)
    r = geometry.crop(raster(spark, np.zeros((5, 7))), 1, 2, 3, 2)
    assert (r.y0, r.x0) == (2, 1)
    assert (geometry.crop(r, 1, 0, 2, 1).y0, geometry.crop(r, 1, 0, 2, 1).x0) == (2, 2)
    assert geometry.crop(r, 1, 0, 2, 1, reset_origin=True).x0 == 0
    with pytest.raises(ValueError, match="out of bounds"):
        geometry.crop(ramp, 5, 5, 9, 1)


def test_argument_checks(spark):
    r = raster(spark, np.zeros((2, 2)))
    with pytest.raises(TypeError):
        r + r
    with pytest.raises(TypeError, match="unknown attrs"):
        r.map(lambda v: v, gain=2)
    with pytest.raises(ValueError, match="expected 3 channels"):
        r.map_rgb(lambda a, b, c: (a, b, c))
    with pytest.raises(TypeError):
        stencil.demosaic(r, "RGGB", "other")
    with pytest.raises(ValueError):
        stencil.demosaic(r, "RRGB")
    with pytest.raises(ValueError, match="UNKNOWN_OP"):
        opcodes.apply_opcodes(r, [{"type": "nothing"}])


ORIENTED = {1: lambda a: a, 2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.T, 6: lambda a: a.T[:, ::-1], 7: lambda a: a.T[::-1, ::-1], 8: lambda a: a.T[::-1]}


@pytest.mark.parametrize("code", range(1, 9))
def test_orientation(spark, code):
    a = np.arange(35.0).reshape(5, 7)
    r = geometry.orient(raster(spark, a), code)
    assert np.array_equal(array(r), ORIENTED[code](a))
    assert np.array_equal(array(geometry.orient(r, geometry.INVERSE[code])), a)


def test_edge_aware_vectors(spark):
    r = stencil.demosaic(raster(spark, [[0.2, 0.4], [0.6, 0.8]]), "RGGB", "ea")
    got = np.stack([array(r, c) for c in RGB], -1)
    want = [[(0.2, 0.5, 0.8), (0.1, 0.4, 0.7)], [(0.3, 0.6, 0.9), (0.2, 0.5, 0.8)]]
    assert np.allclose(got, want)
    a = np.full((5, 5), 0.5)
    a[1, 2], a[3, 2], a[2, 1], a[2, 3], a[2, 0], a[2, 4] = 0.1, 0.9, 0.2, 0.2, 0, 0
    assert array(stencil.demosaic(raster(spark, a), "RGGB", "ea"), "g")[2, 2] == pytest.approx(0.5)
    assert array(stencil.demosaic(raster(spark, a), "RGGB", "ea_fast"), "g")[2, 2] == pytest.approx(0.2)


@pytest.mark.parametrize("algorithm", stencil.ALGORITHMS)
def test_shifted_mosaics_agree_inside(spark, algorithm):
    rng = np.random.default_rng(0)
    a = rng.random((10, 12))
    full = array(stencil.demosaic(raster(spark, a), "RGGB", algorithm), "r")
    for (dy, dx), pattern in (((0, 1), "GRBG"), ((1, 0), "GBRG"), ((1, 1), "BGGR")):
        part = array(stencil.demosaic(raster(spark, a[dy:, dx:]), pattern, algorithm), "r")
        assert np.allclose(part[3:-3, 3:-3], full[dy:, dx:][3:-3, 3:-3])


def test_crop_after_demosaic_and_tiles(spark):
    a = np.random.default_rng(0).random((17, 19))
    r = raster(spark, a)
    full = array(stencil.demosaic(r, "RGGB", "ea"), "g")
    part = array(geometry.crop(stencil.demosaic(r, "RGGB", "ea"), 3, 2, 11, 13), "g")
    assert np.array_equal(part, full[2:15, 3:14])
    one, many = tiles.demosaic_vng(r, tile=64), tiles.demosaic_vng(r, tile=4)
    for c in RGB:
        assert np.allclose(array(one, c), array(many, c))


def test_identities(spark):
    a = np.full((4, 4), 0.5)
    r = opcodes.apply_opcodes(raster(spark, a), [{"type": "fix_vignette", "k": (0, 0, 0, 0, 0)}, {"type": "map_polynomial", "coefficients": (0, 1)}, {"type": "gain_map", "grid": [[1.0]]}, {"type": "warp_rectilinear", "k": (1.0,)}])
    assert np.allclose(array(r), 0.5)
    row = spark.range(1).select(points.lut(F.lit(0.5), [0, 1]).alias("a"), points.curve(F.lit(0.3), [(0, 0), (1, 1)]).alias("b"), *[c.alias(n) for c, n in zip(points.hue_tone(F.lit(0.2), F.lit(0.5), F.lit(0.8), lambda v: v), RGB)]).first()
    assert [round(v, 9) for v in row] == [0.5, 0.3, 0.2, 0.5, 0.8]
    hsv = points.hsv(F.lit(0.2), F.lit(0.5), F.lit(0.8))
    assert [round(v, 9) for v in spark.range(1).select(*points.rgb_of_hsv(*hsv)).first()] == [0.2, 0.5, 0.8]


def test_colour_science():
    assert np.array_equal(colour.bradford(colour.D50_XY, colour.D50_XY), np.eye(3))
    for kelvin in range(2000, 15001, 500):
        for tint in (-80, -20, 0, 35, 80):
            k, t = colour.temperature_of_uv(*colour.uv_of_temperature(kelvin, tint))
            assert abs(k - kelvin) < 0.2 and abs(t - tint) < 0.002
    x, y = colour.xy_of_uv(*colour.uv_of_xy(0.3127, 0.329))
    assert (round(x, 9), round(y, 9)) == (0.3127, 0.329)
    assert np.allclose(colour.prophoto_to_srgb() @ [1, 1, 1], [1, 1, 1], atol=2e-3)


def test_matrices_of_files():
    neutral, m = (0.6, 1.0, 0.7), np.array([[0.9, -0.3, -0.1], [-0.4, 1.2, 0.2], [-0.05, 0.2, 0.6]])
    # the neutral is white in PCS, by either path
    white = colour.xyz_of_xy(colour.D50_XY)
    assert np.allclose(colour.camera_to_pcs(neutral, m) @ neutral, white)
    forward = np.diag(white)
    assert np.allclose(colour.camera_to_pcs(neutral, m, forward, (0.9, 1.0, 1.1)) @ neutral, white)
    two = colour.interpolate_illuminants(4000.0, (2856.0, m), (6504.0, 2 * m))
    at = lambda k: colour.interpolate_illuminants(k, (2856.0, m), (6504.0, m * [[1.0], [1.1], [0.9]]))
    xy = colour.white_of_neutral(at(5000.0) @ colour.xyz_of_xy((0.35, 0.36)) / 1.0, at)
    k, _ = colour.temperature_of_uv(*colour.uv_of_xy(*xy))
    assert np.allclose(np.cross(at(k) @ colour.xyz_of_xy(xy), at(5000.0) @ colour.xyz_of_xy((0.35, 0.36))), 0, atol=1e-6)
    assert np.allclose(two, m * (1 + 1 - colour.mired_weight(4000.0, 2856.0, 6504.0)))
    assert np.array_equal(colour.camera_to_srgb(None), np.eye(3))
    assert np.allclose(colour.camera_to_srgb(m.reshape(-1), None, (23, 21), neutral) @ neutral, 1, atol=3e-3)


def test_warp_of_channels(spark):
    a = np.random.default_rng(3).random((6, 7, 3))
    rows = [(0, y, x, *map(float, a[y, x])) for y in range(6) for x in range(7)]
    r = Raster(spark.createDataFrame(rows, "image_id int, y long, x long, r double, g double, b double"), 6, 7, RGB)
    for bicubic in (False, True):
        same = opcodes.apply_opcodes(r, [{"type": "warp_rectilinear", "k": (1.0,), "use_bicubic": bicubic}])
        half = geometry.warp(r, F.col("y") + 0.0, F.col("x") + 0.5, bicubic)
        for i, c in enumerate(RGB):
            assert np.allclose(array(same, c), a[:, :, i])
            want = (a[:, 2:3, i] + a[:, 3:4, i]) / 2 if not bicubic else (-a[:, 1:2, i] + 9 * a[:, 2:3, i] + 9 * a[:, 3:4, i] - a[:, 4:5, i]) / 16
            assert np.allclose(array(half, c)[:, 2:3], want)


@pytest.mark.parametrize("algorithm", stencil.ALGORITHMS)
def test_bands_change_nothing(spark, monkeypatch, algorithm):
    r = raster(spark, np.random.default_rng(4).random((23, 6)))
    whole = [array(stencil.demosaic(r, "GRBG", algorithm), c) for c in RGB]
    monkeypatch.setattr(stencil, "BAND", 5)
    assert all(np.array_equal(array(stencil.demosaic(r, "GRBG", algorithm), c), w) for c, w in zip(RGB, whole))


def test_exact_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), float(v)) for c in range(3) for v in np.concatenate((rng.random(97), np.repeat(rng.random(), 60), [50.0] * c))] + [(9, 4.0), (9, None)]
    df = spark.createDataFrame(rows, "c int, v double")
    for p in (0.0, 0.37, 0.5, 0.99, 1.0):
        got = {r.c: r["at"] for r in statistics.exact_percentile(df, "v", p, "c").collect()}
        for c in (0, 1, 2, 9, None):
            assert got[c] == pytest.approx(np.quantile([v for k, v in rows if v is not None and c in (k, None)], p))
    assert statistics.exact_percentile(df.limit(0), "v", 0.5, "c").count() == 0


def test_levels_and_scales():
    assert geometry.levels(1024, 768, 5) == [1, 2]
    assert geometry.levels(255, 900, 3) == []
    assert geometry.pick_level([(100, 100), (50, 50), (25, 25)], 0.5) == 1
    assert [geometry.preview_scale(n, 999) for n in (200, 256, 512)] == ["FULL", "HALF", "QUARTER"]


def test_scaled_images(spark):
    flat = raster(spark, np.full((16, 24), 0.3))
    for part, size in ((1.0, (16, 24)), (0.5, (8, 12)), (0.3, (5, 7)), (0.125, (2, 3))):
        r = geometry.scale(flat, part)
        assert (r.height, r.width) == size and array(r).shape == size and np.allclose(array(r), 0.3)
    cut = geometry.crop_fraction(raster(spark, np.arange(40.0).reshape(5, 8)), 0.25, 0.2, 0.75, 1.0)
    assert np.array_equal(array(cut), np.arange(40.0).reshape(5, 8)[1:, 2:6])


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1, v) for v in (-1.0, 0.0, 5.0, 9.99, 10.0, 11.0)], "image_id int, v double")
    got = {r.bin: r.n for r in statistics.histogram(df, 10.0, 10).collect()}
    assert got == {0: 1, 5: 1, 9: 2}
    dark = statistics.histogram(spark.createDataFrame([(1, 50.0)] * 10, "image_id int, v double"), 100.0, 100)
    row = statistics.auto_exposure(dark, 100.0, 100).first()
    assert (row.black, row.median, row.clipped, row.exposure) == (50, 50, False, pytest.approx(np.log2(6 / 50)))
    assert statistics.auto_exposure(dark.withColumn("p", F.lit(7)), 100.0, 100, "p").first().black == 7
    assert statistics.auto_exposure(dark.withColumn("bin", F.lit(99)), 100.0, 100).first().exposure is None
    assert [statistics.clip_bin(w, int(w)) for w in (255.0, 4095.0, 1000.0)] == [249, 3993, 975]


def test_resampling_and_nodes(spark):
    from sparkroom.plans.render import apply_nodes

    flat = raster(spark, np.full((6, 8), 0.4))
    for kind in geometry.FILTERS:
        assert np.allclose(array(geometry.resize(flat, 9, 4, kind)), 0.4)
        assert np.allclose(array(geometry.resize(raster(spark, np.arange(12.0).reshape(3, 4)), 3, 4, kind)), np.arange(12).reshape(3, 4))
    assert np.allclose(array(apply_nodes(flat, [{"op": "sub_scalar", "k": 0.1}, {"op": "mul_scalar", "k": 2}])), 0.6)
    with pytest.raises(ValueError, match="UNKNOWN_OP"):
        apply_nodes(flat, [{"op": "nothing"}])
    t = colour.default_tone()
    assert t[0] == 0 and abs(t[-1] - 1) < 1e-12 and all(a < b for a, b in zip(t, t[1:]))
    assert np.allclose(colour.neutral_of_white(colour.D65_XY, np.eye(3)).max(), 1)
