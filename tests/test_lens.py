"""Lens warps tile by tile against plain arrays, and in files' opcode lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkroom.operators import lens
from sparkroom.operators.raster import RGB, Raster
from sparkroom.plans import convert
from sparkroom.sources import opcode_lists, tiff


def plain(a, sets, centre, bicubic=False, edge=False):
    """Pixel by pixel; NaN where a pixel is left out."""
    h, w, n = a.shape
    cx, cy = centre[0] * (w - 1), centre[1] * (h - 1)
    radius = max(np.hypot(x - cx, y - cy) for x in (0, w - 1) for y in (0, h - 1)) or 1.0
    out = np.full(a.shape, np.nan)
    cubic = lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
    for y in range(h):
        for x in range(w):
            for c in range(n):
                k = sets[c if len(sets) > 1 else 0]
                dx, dy = (x - cx) / radius, (y - cy) / radius
                r2 = dx * dx + dy * dy
                f = sum(v * r2**i for i, v in enumerate(k[:-2]))
                sx = (dx * f + k[-2] * 2 * dx * dy + k[-1] * (r2 + 2 * dx * dx)) * radius + cx
                sy = (dy * f + k[-1] * 2 * dx * dy + k[-2] * (r2 + 2 * dy * dy)) * radius + cy
                if edge:
                    sx, sy = min(max(sx, 0), w - 1), min(max(sy, 0), h - 1)
                elif not (-1e-12 <= sx <= w - 1 + 1e-12 and -1e-12 <= sy <= h - 1 + 1e-12):
                    continue
                iy, ix = max(min(int(np.floor(sy)), h - 2), 0), max(min(int(np.floor(sx)), w - 2), 0)
                reach = range(-1, 3) if bicubic else range(2)
                weight = (lambda d: cubic(abs(d))) if bicubic else (lambda d: max(1 - abs(d), 0))
                out[y, x, c] = sum(a[min(max(iy + j, 0), h - 1), min(max(ix + i, 0), w - 1), c] * weight(sy - iy - j) * weight(sx - ix - i) for j in reach for i in reach)
    out[np.isnan(out).any(2)] = np.nan
    return out


def pixels(spark, *images):
    rows = [(i, y, x, *map(float, a[y, x])) for i, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id int, y long, x long, r double, g double, b double")


def array(df, image, shape):
    out = np.full(shape, np.nan)
    for r in df.where(f"image_id = {image}").collect():
        out[r.y, r.x] = r.r, r.g, r.b
    return out


THREE = [(0.95, 0.04, -0.01, 0.0, 0.003, -0.002), (0.97, 0.02, 0.0, 0.0, 0.0, 0.0), (1.02, -0.05, 0.01, 0.0, 0.001, 0.004)]


@pytest.mark.parametrize("sets,bicubic,edge", [(THREE, False, False), (THREE, True, True), (THREE[:1], True, False), ([(3.0, 0.0, 0.0)], False, True), ([(0.0, 0.0, 0.0)], False, False), ([(-1.0, 0.0, 0.0)], False, False)])
def test_tiles_equal_the_whole(spark, sets, bicubic, edge):
    a = np.random.default_rng(5).random((21, 19, 3))
    r = lens.warp_lens(Raster(pixels(spark, a), 21, 19, RGB), sets, (0.4, 0.6), bicubic, edge, tile=8)
    want = plain(a, sets, (0.4, 0.6), bicubic, edge)
    # places on a border itself are left to rounding
    got = array(r.df, 0, a.shape)
    both = ~np.isnan(got) & ~np.isnan(want)
    assert np.allclose(got[both], want[both]) and (np.isnan(got) != np.isnan(want)).sum() <= 3
    assert r.df.count() == r.df.select("y", "x").distinct().count()


def test_images_of_their_own_and_edges(spark):
    rng = np.random.default_rng(6)
    a, b, one = rng.random((9, 33, 3)), rng.random((17, 5, 3)), rng.random((1, 1, 3))
    b[3, 2, 1] = np.nan
    px = pixels(spark, a, b, one).withColumn("k", F.lit("extra"))
    flat = lambda sets: [float(v) for s in sets for v in s]
    lenses = spark.createDataFrame(
        [(0, 9, 33, 3, flat(THREE), [0.5, 0.5]), (1, 17, 5, 1, flat(THREE[1:2]), [0.5, 0.5]), (2, 1, 1, 1, [1.0, 0.0, 0.0], [0.5, 0.5]), (7, 4, 4, 1, [1.0, 0.0, 0.0], [0.5, 0.5]), (8, 4, 4, 1, [float("nan"), 0.0, 0.0], [0.5, 0.5])],
        "image_id int, height int, width int, sets int, k array<double>, centre array<double>",
    )
    got = lens.warp_by(px, lenses, RGB, edge=True, tile=8).cache()
    assert got.columns == ["image_id", "y", "x", "r", "g", "b"]
    assert np.allclose(array(got, 0, a.shape), plain(a, THREE, (0.5, 0.5), edge=True))
    assert np.allclose(array(got, 2, one.shape), one)
    # a missing pixel makes those that take it null, in its channel alone
    made, want = array(got, 1, b.shape), plain(np.nan_to_num(b), THREE[1:2], (0.5, 0.5), edge=True)
    gone = np.isnan(made)
    assert gone[:, :, 1].any() and not gone[:, :, [0, 2]].any() and np.allclose(made[~gone], want[~gone])
    # a lens without pixels gives pixels that are null; one that is not finite gives none
    assert got.where("image_id = 7 and r is null").count() == 16 and got.where("image_id = 8").count() == 0
    assert lens.warp_by(px.where("false"), lenses.where("false"), RGB).count() == 0


def test_a_lens_that_shrinks_is_split(spark):
    row = spark.createDataFrame([(0, 2000, 2000, 1, [20.0, 0.0, 0.0], [0.5, 0.5])], "image_id int, height int, width int, sets int, k array<double>, centre array<double>")
    asked = lens.asked_parts(row, False, True, tile=64).selectExpr("top", "left", "side", "(y1 - y0 + 1) * (x1 - x0 + 1) as box").distinct().collect()
    assert min(r.side for r in asked) == 16 and all(r.box <= lens.WIDE * 64 * 64 or r.side == lens.LEAST for r in asked)
    # targets cover each pixel once
    seen = np.zeros((2000, 2000), int)
    for r in asked:
        seen[r.top : r.top + r.side, r.left : r.left + r.side] += 1
    assert (seen == 1).all()


def test_sets_must_fit(spark):
    r = Raster(pixels(spark, np.zeros((2, 2, 3))), 2, 2, RGB)
    for sets in (THREE[:2], [(1.0, 0.0, 0.0), (1.0, 0.0), (1.0, 0.0)], [(1.0, 0.0)]):
        with pytest.raises(ValueError):
            lens.warp_lens(r, sets)


def test_warps_in_opcode_lists(spark, tmp_path):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 65536, (20, 24, 3), dtype=np.uint16)
    warp = lambda k: {"id": opcode_lists.WARP, "grid": [len(k)], "k": [v for s in k for v in s], "centre": [0.5, 0.5]}
    half = {"id": opcode_lists.POLYNOMIAL, "area": [0, 0, 99, 99, 0, 3, 1, 1], "k": [0.0, 0.5]}
    lists = {"none": [], "one": [half, warp(THREE)], "two": [warp(THREE[1:2]), half, warp(THREE), half], "odd": [warp(THREE[:2])]}
    for name, ops in lists.items():
        own = {convert.OPCODES3: (7, tuple(opcode_lists.build(ops)))} if ops else {}
        (tmp_path / f"{name}.dng").write_bytes(tiff.build([(a, {tiff.PHOTOMETRIC: (3, (tiff.LINEAR_RAW,))} | own)]))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "content")
    px, status = convert.camera_images(files)
    told = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in status.collect()}
    assert told == {"none.dng": ("ok", None), "one.dng": ("ok", None), "two.dng": ("ok", None), "odd.dng": ("errored", "opcodes not taken: 1")}
    v = a / 65535
    centre = (0.5, 0.5)
    clamp = lambda p: np.clip(p, 0, 1)
    want = {"none": v, "one": plain(v / 2, THREE, centre, edge=True), "two": plain(clamp(plain(v, THREE[1:2], centre, edge=True)) / 2, THREE, centre, edge=True) / 2}
    got = {k: np.full(a.shape, np.nan) for k in want}
    for r in px.collect():
        got[r.path.rsplit("/", 1)[1][:-4]][r.y, r.x] = r.r, r.g, r.b
    for k in want:
        assert np.allclose(got[k], want[k]), k
    # a copy keeps the list, so that it renders like its source
    copied = convert.copy_pages(files.where("path like '%/one.dng'"), preview=False)
    back, _ = convert.camera_images(copied)
    assert np.allclose(sum(r.r for r in back.collect()), got["one"][:, :, 0].sum(), rtol=1e-4)
