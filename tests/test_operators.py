"""Field operators on small inputs: missing values, NaN, edges, unknown options."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import colormap, geodesy as G
from gridspark.functions.scalar import wrap_span
from gridspark.operators import field as O
from gridspark.operators import render as R

NAN, INF = float("nan"), float("inf")


def long(spark, rows):
    return spark.createDataFrame(rows, "j int, i int, value double")


def test_combine_missing_and_not_finite(spark):
    a = long(spark, [(0, 0, 1.0), (0, 1, None), (0, 2, 3.0), (0, 3, INF)])
    b = long(spark, [(0, 0, 0.0), (0, 1, 1.0), (0, 3, 1.0)])
    got = {r.i: r.value for r in O.combine(a, b, "ratio").collect()}
    assert got == {0: None, 1: None, 2: None, 3: None}
    assert {r.i: r.value for r in O.combine(a, b, "mean").collect()}[0] == 0.5
    with pytest.raises(ValueError):
        O.combine(a, b, "power")


def test_range_ignores_nan_and_infinity(spark):
    r = O.value_range(long(spark, [(0, 0, NAN), (0, 1, INF), (0, 2, 2.0), (0, 3, None)])).first()
    assert (r.lo, r.hi) == (2.0, 2.0)


def test_geometry_nan_never_matches(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, NAN, 1.0), (3, 1.0, 2.0)], "pair int, x double, y double")
    got = {r.pair: r.same_grid for r in O.same_geometry(a, a, ["x", "y"]).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_cf_nan_survives_range_and_sentinel(spark):
    d = spark.createDataFrame([(0, NAN), (1, 5.0), (2, 99.0), (3, None), (4, -9.0)], "k int, v double")
    got = {r.k: r.x for r in d.select("k", O.cf_unpack(F.col("v"), 2.0, 1.0, (0.0, 50.0), [-9.0, NAN]).alias("x")).collect()}
    assert math.isnan(got[0]) and got[1] == 11.0 and got[2] is got[3] is got[4] is None


def test_dense_and_back(spark):
    d = spark.createDataFrame([("a", 3, [1.0, None, 3.0, 4.0, 5.0, 6.0])], "id string, ni int, values array<double>")
    assert O.to_dense(O.to_long(d).select("id", "j", "i", "value"), "id").first()["values"] == [1.0, None, 3.0, 4.0, 5.0, 6.0]


def test_seam_ties_keep_their_side(spark):
    d = spark.createDataFrame([(v,) for v in (180.0, -180.0, 190.0, 540.0, -540.0, 0.0)], "v double")
    assert [r[0] for r in d.select(wrap_span(F.col("v"), 180.0)).collect()] == [180.0, -180.0, -170.0, 180.0, -180.0, 0.0]


@pytest.mark.parametrize("target", [G.Equirect(41, 31), G.WebMercator(41, 31, -70.0, 70.0), G.Orthographic(41, 41, 30.0, 10.0), G.Polar(41, 41, True, 5.0), G.Mollweide(60, 30, 15.0), G.Robinson(60, 30, 15.0), G.EqualEarth(60, 30, 15.0)])
def test_pixels_come_back(spark, target):
    p = R.pixels(spark, target.w, target.h)
    lat, lon = target.lonlat(F.col("px"), F.col("py"))
    p = p.withColumns({"lat": lat, "lon": lon}).where("lat is not null and abs(lat) < 89.99")
    x, y = target.pixel(F.col("lat"), F.col("lon"))
    r = p.withColumns({"x": x, "y": y}).agg(F.count("*").alias("n"), F.max(F.abs(F.col("y") - F.col("py"))).alias("dy"), F.percentile_approx(F.abs(F.col("x") - F.col("px")), 0.9).alias("dx")).first()
    assert r.n > 100 and r.dy < 1e-6 and r.dx < 1e-6


def test_bilinear_needs_all_corners(spark):
    f = long(spark, [(j, i, float(10 * j + i)) for j in range(3) for i in range(4) if (j, i) != (1, 1)])
    g = G.LatLon(4, 3, 20.0, 0.0, 0.0, 30.0)
    t = G.Equirect(3, 3, 5.0, 15.0, 5.0, 25.0)
    got = {(r.px, r.py): r.value for r in R.warp(f, g, t, "bilinear").collect()}
    assert got[(0, 0)] is None and got[(2, 1)] is not None
    with pytest.raises(ValueError):
        R.warp(f, g, t, "cubic")


def test_contour_saddle_and_missing_corner(spark):
    f = long(spark, [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0), (0, 2, None), (1, 2, 3.0)])
    segs = R.contours(f, spark.createDataFrame([(0.5,)], "level double")).collect()
    assert len(segs) == 2 and {s.i for s in segs} == {0}


def test_levels():
    assert R.nice_levels(0.0, 10.0) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    assert R.nice_levels(1.0, 1.0) == [] and R.nice_levels(NAN, 1.0) == []
    assert R.interval_levels(0.0, 1.0, 0.25) == [0.25, 0.5, 0.75]
    assert len(R.interval_levels(0.0, 1e9, 1.0)) <= 2001


def test_colormaps():
    assert len(colormap.REGISTRY) == 8
    for c in colormap.REGISTRY.values():
        t = c.lut()
        assert len(t) == 256 and t == c.lut(True)[::-1]
    assert colormap.get("viridis").entry(0) == (68, 1, 84)
    with pytest.raises(ValueError):
        colormap.get("nope")


def test_paint_transparent(spark):
    r = spark.createDataFrame([(0, 0, None), (1, 0, NAN), (2, 0, -1.0), (3, 0, 10.0)], "px int, py int, value double")
    got = {x.px: x.a for x in R.paint(r, 1.0, 100.0, scale="log10").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 255}


def test_spectral_closed_forms(spark):
    lats, lons = [60.0, 0.0, -30.0], [0.0, 90.0]
    c = spark.createDataFrame([(0, 0, 3.0, 0.0), (0, 1, 2.0, 0.0)], "m int, n int, re double, im double")
    got = {(r.j, r.i): r.value for r in R.synthesize(c, 3, lats, lons).collect()}
    for j, la in enumerate(lats):
        assert got[(j, 0)] == pytest.approx(3 + 2 * math.sqrt(3) * math.sin(math.radians(la)))
    c = spark.createDataFrame([(1, 1, 1.0, 0.0)], "m int, n int, re double, im double")
    got = {(r.j, r.i): r.value for r in R.synthesize(c, 2, [0.0], lons).collect()}
    assert got[(0, 0)] == pytest.approx(2 * math.sqrt(1.5)) and got[(0, 1)] == pytest.approx(0, abs=1e-12)


def test_gaussian_latitudes():
    r = np.array(G.gaussian_latitudes(16))
    x, _ = np.polynomial.legendre.leggauss(32)
    assert np.allclose(r, np.degrees(np.arcsin(np.sort(x)[::-1])), atol=1e-10)


def test_graticule_limits(spark):
    with pytest.raises(ValueError):
        R.graticule(spark, 0.0)
    g = R.graticule(spark, 45.0)
    assert g.where("abs(lat) = 90 and ring >= 8").count() == 0 and g.agg(F.max("lon")).first()[0] == 180.0
