"""The data source of TIFF files: byte ranges, pages, and writing in two phases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkroom.sources import tiff, tiff_source

RNG = np.random.default_rng(9)
FIRST, SECOND = RNG.integers(0, 1000, (70, 45, 3), dtype=np.uint16), RNG.random((33, 20, 1)).astype(np.float32)


@pytest.fixture
def folder(spark, tmp_path):
    tiff_source.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tif").write_bytes(tiff.build([(FIRST, {}), (SECOND, {})], tile=16))
    (tmp_path / "sub" / "b.DNG").write_bytes(tiff.build([(SECOND, {})], order=">"))
    whole = tiff.build([(FIRST, {})])
    (tmp_path / "cut.tif").write_bytes(whole[: len(whole) - 300])
    (tmp_path / "no.tif").write_bytes(b"nothing")
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    return f"file://{tmp_path}"


def image(rows, path, ifd, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        if r.path.endswith(path) and r.ifd == ifd:
            assert np.isnan(out[r.y, r.x, 0]) and r.error is None
            out[r.y, r.x] = [r.a, r.b, r.c][: shape[2]]
    return out


@pytest.mark.parametrize("split", [500, 1 << 26])
def test_pixels_by_ranges(spark, folder, split):
    df = spark.read.format("tiff").option("splitBytes", split).load(folder)
    assert (df.rdd.getNumPartitions() > 20) == (split == 500)
    rows = df.collect()
    assert np.array_equal(image(rows, "/a.tif", 0, FIRST.shape), FIRST)
    assert np.array_equal(image(rows, "/a.tif", 1, SECOND.shape), SECOND)
    assert np.array_equal(image(rows, "/sub/b.DNG", 0, SECOND.shape), SECOND)
    wrong = {r.path.rsplit("/", 1)[1]: r for r in rows if r.error}
    assert set(wrong) == {"cut.tif", "no.tif", "empty.tif"} and wrong["cut.tif"].ifd == 0
    assert sum(r.path.endswith("cut.tif") for r in rows) == 1


def test_pages_are_pruned(spark, folder):
    some = spark.read.format("tiff").option("pages", "1").load(folder).where("error is null")
    assert {(r.path.rsplit("/", 1)[1], r.ifd) for r in some.select("path", "ifd").distinct().collect()} == {("a.tif", 1)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("tiff").option("pushdown", "true").load(folder).where("ifd = 1")
        assert pushed.count() == SECOND.size
        reader = tiff_source.PruningReader({"path": folder})
        from pyspark.sql.datasource import EqualTo, In

        list(reader.pushFilters([EqualTo(("ifd",), 1), In(("ifd",), (1, 2))]))
        assert reader.pages == {1}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_files_in_two_phases(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    save = lambda df, mode="append": df.write.format("tiff").mode(mode).save(f"file://{out}")
    rows = lambda *some: spark.createDataFrame(some, "name string, content binary").repartition(3)
    save(rows(("x/1.tif", b"one"), ("y/1.tif", b"two"), ("2.tif", b"")))
    assert files_below(out) == ["2.tif", "x/1.tif", "y/1.tif"] and (out / "y" / "1.tif").read_bytes() == b"two"
    # equal names, a file that is there, a name outside, a task that fails: nothing is left
    fails = rows(("4.tif", b"a"), ("5.tif", b"b")).withColumn("content", F.when(F.col("name") == "5.tif", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")))
    for df in (rows(("3.tif", b"a"), ("3.tif", b"b")), rows(("3.tif", b"a"), ("2.tif", b"b")), rows(("3.tif", b"a"), ("../3.tif", b"b")), rows(("3.tif", b"a"), (None, b"b")), fails, rows(("3.tif", b"a")).withColumnRenamed("content", "c")):
        with pytest.raises(Exception):
            save(df)
        assert files_below(out) == ["2.tif", "x/1.tif", "y/1.tif"] and (out / "2.tif").read_bytes() == b""
        assert not [d for d in os.listdir(out) if d.startswith("_temporary")]
    save(rows(("2.tif", b"new")), "overwrite")
    assert files_below(out) == ["2.tif", "x/1.tif", "y/1.tif"] and (out / "2.tif").read_bytes() == b"new"
    save(rows(("n", b"")).where("false"))
    assert len(files_below(out)) == 3
