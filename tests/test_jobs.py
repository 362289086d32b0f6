"""Jobs on arriving files: each file once, whatever stops the job."""

import pytest
from pyspark.sql import functions as F

from sparkroom.streaming import jobs


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    return tmp_path, {k: f"file://{tmp_path}/{k}" for k in ("in", "out", "manifest", "state")}


def sizes(calls):
    """A job that tells a file's size as its error, and writes nothing."""

    def job(files, folder, names):
        calls.append(sorted(r.name for r in names.collect()))
        return files.select("path", F.lit("written").alias("status"), F.length("content").cast("string").alias("error"))

    return job


def test_each_file_once(spark, place):
    root, at = place
    calls = []
    run = lambda: jobs.convert_arriving(spark, at["in"], at["out"], at["manifest"], at["state"], glob="*.dng", job=sizes(calls)).awaitTermination()
    (root / "in" / "a" / "x.dng").write_bytes(b"123")
    (root / "in" / "x.dng").write_bytes(b"12")
    (root / "in" / "x.txt").write_bytes(b"1")
    run()
    run()
    (root / "in" / "y.dng").write_bytes(b"1")
    run()
    assert calls == [["a/x.dng.tif", "x.dng.tif"], ["y.dng.tif"]]
    rows = jobs.manifest_of(spark, at["manifest"]).collect()
    assert sorted((r.path.rsplit("/in/", 1)[1], r.error, r.batch) for r in rows) == [("a/x.dng", "3", 0), ("x.dng", "2", 0), ("y.dng", "1", 1)]


def test_a_batch_asked_for_again(spark, place):
    _, at = place
    calls = []
    batch = spark.createDataFrame([(f"{at['in']}/x.dng", b"1")], "path string, content binary")
    one = jobs.batch_of(at["in"], at["out"], at["manifest"], sizes(calls))
    one(batch, 4)
    one(batch, 4)
    assert len(calls) == 1
    # an interrupted one left no mark of success: it is done again, and stands once
    (place[0] / "manifest" / "batch=4" / "_SUCCESS").unlink()
    one(batch, 4)
    assert len(calls) == 2 and jobs.manifest_of(spark, at["manifest"]).count() == 1

    def broken(files, folder, names):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        jobs.batch_of(at["in"], at["out"], at["manifest"], broken)(batch, 5)
    assert jobs.manifest_of(spark, at["manifest"]).count() == 1


def test_names_depend_on_no_other_file(spark):
    paths = ["file:/in/a/x.dng", "file:///in/b/x.dng", "file:/elsewhere/x.dng", "file:/input/x.tif"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.name for r in jobs.fixed_names(files, "file:///in/").collect()}
    assert got == dict(zip(paths, ["a/x.dng.tif", "b/x.dng.tif", "x.dng.tif", "x.tif.tif"]))
