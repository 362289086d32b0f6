"""Many small files are few tasks of the data source."""

import numpy as np

from sparkroom.sources import tiff, tiff_source


def test_small_files_share_tasks(spark, tmp_path):
    tiff_source.register(spark)
    for i in range(450):
        (tmp_path / f"{i}.tif").write_bytes(tiff.build([(np.full((4, 5), i, np.uint16), {})]))
    df = spark.read.format("tiff").option("splitBytes", 100).load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() <= tiff_source.TASKS
    rows = df.groupBy("path").agg({"a": "sum", "y": "count"}).collect()
    assert sorted((r["sum(a)"], r["count(y)"]) for r in rows) == [(20 * i, 20) for i in range(450)]


def test_tasks_of_large_folders(tmp_path):
    """Every range is in one task, and none is far beyond its share."""
    reader = tiff_source.Reader({"path": f"file://{tmp_path}"})
    parts = [tiff_source.Part("p", "p", i, i + (1 << 26)) for i in range(500)]
    reader.ranges = lambda: parts
    tasks = reader.partitions()
    assert [p for t in tasks for p in t.parts] == parts and 250 < len(tasks) <= 501
