"""Bi-Fourier, spectral and matrix decoders, extents, pictures, slices."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.codec import bits, grib1, grib2, png, synth
from gridspark.functions import geodesy as G
from gridspark.operators import render as R

RNG = np.random.default_rng(5)


@pytest.mark.parametrize(("kind", "reach"), [(77, [3, 3, 3]), (88, [3, 2, 0]), (99, [3, 2, 0])])
def test_bifourier(kind, reach):
    order = [(j, i) for j, r in enumerate(reach) for i in range(r + 1)]
    inner = [(j, i) for j, i in order if i <= 1 and j <= 1 and (kind == 77 or i + j <= 1)]
    raw, x = RNG.normal(size=(len(inner), 4)), RNG.integers(0, 200, (len(order) - len(inner), 4))
    p = 0.5
    drs = synth.red(-1.0, -3, 0, 8) + bytes([kind, 0]) + synth._sm(round(p * 1e6), 4) + struct.pack(">HH", 1, 1) + struct.pack(">I", 0) + bytes([2])
    grid = bytes([kind]) + struct.pack(">II", 3, 2)
    b = synth.grib2(1, 1, 53, drs, raw.astype(">f8").tobytes() + bits.pack(x.ravel(), 8), n_values=4 * len(order), grid=grid, grid_template=61)
    m = next(grib2.messages(b))
    got = grib2.bifourier(m, b)
    assert [c[:2] for c in got] == order
    packed = iter(x)
    plain = iter(raw)
    for j, i, *c in got:
        want = next(plain) if (j, i) in inner else (-1 + next(packed) / 8) / (i * i + j * j) ** p
        assert c == pytest.approx(list(want))


def test_spectral_complex_edition_1():
    t, ks, p = 3, 1, 500
    order = [(m, n) for m in range(t + 1) for n in range(m, t + 1)]
    inner = [c for c in order if c[1] <= ks]
    raw = [0.5, 0.0, 2.0, 0.25, -1.0, 4.0]
    x = RNG.integers(0, 100, 2 * (len(order) - len(inner)))
    body = struct.pack(">H", 0) + synth._sm(p, 2) + bytes([ks] * 3) + b"".join(bits.ibm_bytes(v) for v in raw) + bits.pack(x, 8)
    b = synth.bds(0xC0, -2, -1.0, 8, body)
    m = {"packing": grib1.packing(b), "grid": {"j": t}, "data_range": (0, len(b)), "decimal": 0}
    got = {c[:2]: c[2:] for c in grib1.coefficients(m, b)}
    assert got[0, 0] == (0.5, 0.0) and got[0, 1] == pytest.approx((2.0 / 2**0.5, 0.25 / 2**0.5)) and got[1, 1] == pytest.approx((-1.0 / 2**0.5, 4.0 / 2**0.5))
    outer = [c for c in order if c[1] > ks]
    for k, (mm, n) in enumerate(outer):
        f = (n * (n + 1)) ** -0.5
        assert got[mm, n][0] == pytest.approx((-1 + x[2 * k] / 4) * f) and got[mm, n][1] == pytest.approx(0 if mm == 0 else (-1 + x[2 * k + 1] / 4) * f)


def test_matrix_edition_1():
    second = RNG.integers(0, 2, 4 * 6)
    x = RNG.integers(0, 256, second.sum())
    head = struct.pack(">H", 4) + bytes([0x60]) + struct.pack(">HH", 2, 3) + bytes([0, 0, 0, 0, 0, 0])
    b = synth.grib1(2, 2, synth.bds(0x10, 0, 0.0, 8, head + bits.pack(second, 1) + bits.pack(x, 8)))
    v = grib1.matrix(next(grib1.messages(b)), b)
    assert v.shape == (4, 2, 3) and np.array_equal(v.mask.ravel(), second == 0) and np.array_equal(v.compressed(), x)


def test_bounding_boxes(spark):
    box = lambda g: tuple(R.bounding_box(spark, g).first())
    assert box(G.LatLon(144, 73, 90.0, 0.0, -90.0, 357.5)) == (-90.0, 90.0, 0.0, 360.0)
    assert box(G.LatLon(11, 6, 50.0, 170.0, 40.0, -170.0)) == pytest.approx((40.0, 50.0, 170.0, 190.0)) or box(G.LatLon(11, 6, 50.0, 170.0, 40.0, -170.0)) == pytest.approx((40.0, 50.0, -190.0, -170.0))
    lam = box(G.Lambert(93, 65, 12.19, -133.459, -95.0, 81270.5, 81270.5, 6_371_200.0, 25.0, 25.0, 25.0))
    assert lam[0] == pytest.approx(12.19, abs=0.01) and 57 < lam[1] < 62 and -155 < lam[2] < -150 and -50 < lam[3] < -45
    polar = box(G.PolarStereo(65, 65, -20.8, -125.0, -80.0, 381000.0, 381000.0))
    assert polar[1:] == (90.0, -180.0, 180.0)


def test_picture_and_slice(spark):
    rows = [(t, y, x, float(10 * y + x) if (y, x) != (1, 1) else None) for t in range(2) for y in range(3) for x in range(4)]
    v = spark.createDataFrame(rows, "t int, y int, x int, value double")
    g = G.LatLon(4, 3, 20.0, 0.0, 0.0, 30.0)
    painted = R.render_slice(v, {"t": 1}, "y", "x", g, unpack=lambda c: c * 2.0)
    got = {(r.px, r.py): (r.r, r.g, r.b, r.a) for r in painted.collect()}
    assert len(got) == 12 and got[1, 1] == (0, 0, 0, 0) and got[0, 0] == (68, 1, 84, 255)
    data = R.png_images(painted.withColumn("name", F.lit("p")), 4, 3, "name").first()
    pixels, per = png.decode(bytes(data.png))
    assert data["name"] == "p" and per == 32 and {(x, y): tuple(pixels[y, 4 * x : 4 * x + 4]) for x in range(4) for y in range(3)} == got
