"""Matrices, temperatures and world coordinates on columns, against plain numbers."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkroom.functions import colour, colour_columns
from sparkroom.operators import fits


def test_matrices(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in m.reshape(-1)]) for i, m in enumerate(rng.standard_normal((50, 3, 3)))] + [(50, [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0]), (51, None)]
    df = spark.createDataFrame(rows, "i int, m array<double>").withColumn("n", F.reverse("m"))
    got = {r.i: r for r in df.select("i", colour_columns.inverse("m").alias("inv"), colour_columns.product("m", "n").alias("p")).collect()}
    for i, m in rows[:50]:
        a = np.reshape(m, (3, 3))
        assert np.allclose(np.reshape(got[i].inv, (3, 3)), np.linalg.inv(a))
        assert np.allclose(np.reshape(got[i].p, (3, 3)), a @ np.reshape(m[::-1], (3, 3)))
    assert got[50].inv is None and got[51].inv is None


def test_temperatures(spark):
    """Both ways as on the driver, also beyond all lines."""
    rows = [(float(k), float(t)) for k in (1500, 1700, 2000, 2856, 5003, 6504, 15000, 90000, 2e6) for t in (-80, 0, 55)]
    df = spark.createDataFrame(rows, "kelvin double, tint double").withColumn("p", colour_columns.uv_of_temperature("kelvin", "tint")).select("*", "p.u", "p.v").withColumn("t", colour_columns.temperature_of_uv("u", "v"))
    for r in df.collect():
        assert np.allclose((r.u, r.v), colour.uv_of_temperature(r.kelvin, r.tint), atol=1e-12)
        k, t = colour.temperature_of_uv(r.u, r.v)
        assert math.isclose(r.t.kelvin, k, rel_tol=1e-9) and abs(r.t.tint - t) < 1e-6
        if 2000 <= r.kelvin <= 15000:
            assert abs(r.t.kelvin - r.kelvin) < 0.2 and abs(r.t.tint - r.tint) < 0.002


def test_world_coordinates(spark):
    base = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": "10.5", "CRVAL2": "-20.25", "CRPIX1": "100", "CRPIX2": "50"}
    heads = [
        base | {"CDELT1": "-0.001", "CDELT2": "0.001"},
        base | {"CDELT1": "0.001", "CDELT2": "0.002", "CROTA2": "90"},
        base | {"CD1_1": "-0.001"},  # not invertible
        base | {"CD1_1": "-0.001", "CD2_2": "0.001", "CDELT1": "5", "CDELT2": "5"},
        {k: v for k, v in base.items() if k != "CRPIX2"} | {"CDELT1": "-0.001", "CDELT2": "0.001", "SCALE": "1.8"},
        base | {"CTYPE2": "DEC--SIN", "CDELT1": "-0.001", "CDELT2": "0.001"},
        {},
    ]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h map<string,string>")
    w = fits.wcs(F.col("h"))
    got = {r.i: r for r in df.select("i", w.alias("w"), fits.wcs_scale(w).alias("s"), fits.wcs_rotation(w).alias("r"), fits.sky_of_pixel(w, F.lit(100.0), F.lit(50.0)).alias("at"), fits.sky_of_pixel(w, F.lit(100.0), F.lit(150.0)).alias("up"), fits.avm(F.col("h")).alias("m")).collect()}
    assert [i for i in got if got[i].w is not None] == [0, 1, 3]
    assert np.allclose(got[0].s, (-0.001, 0.001)) and got[0].r == 0.0 and np.allclose((got[0].at.ra, got[0].at.dec), (10.5, -20.25)) and np.allclose((got[0].up.ra, got[0].up.dec), (10.5, -20.15), atol=1e-6)
    assert np.allclose(got[1].s, (0.001, 0.002)) and np.allclose(abs(got[1].r), 90.0)
    assert np.allclose(got[3].s, (-0.001, 0.001)) and got[3].m["Spatial.ReferencePixel"] == ["100.0", "50.0"]
    assert [float(v) for v in got[4].m["Spatial.Scale"]] == [-0.0005, 0.0005]
