"""Sizes of encoded tiles, and of what Python gets at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkroom.sources import fits, tiff
from sparkroom.sources.files import BATCH_BYTES


@pytest.mark.parametrize("bits", [None, 10])
def test_a_small_image_has_a_small_tile(spark, bits):
    """Ten rows of a hundred are no tile of 256 by 256; tiles of larger images are whole."""
    rng = np.random.default_rng(3)
    made = {0: rng.integers(0, 1000, (10, 100)), 1: rng.integers(0, 1000, (40, 70))}
    rows = [(k, y, x, int(v)) for k, a in made.items() for (y, x), v in np.ndenumerate(a)]
    px = spark.createDataFrame(rows, "image_id int, y long, x long, v long")
    for tile, edges in ((256, {0: (16, 112), 1: (48, 80)}), (32, {0: (16, 32), 1: (32, 32)})):
        for r in tiff.encode_images(px, bits, tile=tile).collect():
            page = tiff.pages(bytes(r.content))[0]
            assert (page.first(tiff.TILE_H), page.first(tiff.TILE_W)) == edges[r.image_id]
            assert not tiff.problem(bytes(r.content), page)
            assert (tiff.pixels(bytes(r.content), page)[:, :, 0] == made[r.image_id]).all()
            assert len(r.content) < 16_000


def test_python_gets_files_by_bytes(spark):
    """Forty files of 2 MB are no single batch, for table functions and columns."""
    files = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("path"), F.expr("cast(repeat('x', 2000000) as binary)").alias("content"))
    tiff.tags_of(files)

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [sum(map(len, pdf.content))]})

    assert max(r.n for r in files.mapInPandas(sizes, "n long").collect()) <= BATCH_BYTES + 2_000_000
    one = F.pandas_udf(lambda c: pd.Series([sum(map(len, c))] * len(c)), "long")
    assert max(r.n for r in files.select(one("content").alias("n")).collect()) <= BATCH_BYTES + 2_000_000
    assert fits.headers_of(files).count() == 40 and tiff.tags_of(files).count() == 40
