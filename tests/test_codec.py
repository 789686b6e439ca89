"""Bytes: what the writers write, the readers read; broken bytes are refused."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.codec import aec, bits, grib1, grib2, hdf5, netcdf3, png, synth, synth_sections

NI, NJ = 20, 11
RNG = np.random.default_rng(1)
X = np.cumsum(RNG.integers(-9, 10, NI * NJ)) + 900
WANT = -1 + X / 1024


def read2(b):
    m = next(grib2.messages(b))
    return m, grib2.decode(m, b)


@pytest.mark.parametrize("order", [0, 1, 2])
def test_complex_packing(order):
    _, v = read2(synth.complex2(X, NI, NJ, order))
    assert np.array_equal(v, WANT)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_second_order(order):
    assert np.array_equal(read2(synth.second_order2(X, NI, NJ, order))[1], WANT)
    b = synth.second_order1(X, NI, NJ, order)
    m = next(grib1.messages(b))
    assert np.array_equal(grib1.decode(m, b), WANT)


def test_odd_rows_turned():
    assert np.array_equal(read2(synth.second_order2(X, NI, NJ, 2, turned=True))[1], WANT)


def test_bitmap_places_values():
    m = RNG.integers(0, 2, NI * NJ)
    _, v = read2(synth.simple2(X[m == 1], NI, NJ, bitmap=m))
    assert np.array_equal(v.mask, m == 0) and np.array_equal(v.compressed(), WANT[m == 1])


def test_run_length_level_zero_is_missing():
    lv = np.repeat(RNG.integers(0, 4, 60), RNG.integers(1, 30, 60))[: NI * NJ]
    _, v = read2(synth.run_length2(lv, NI, NJ))
    assert np.array_equal(v.mask, lv == 0) and np.array_equal(v.filled(0), np.array([0, 1, 2, 3.0])[lv])


def test_ramp_of_first_differences():
    ramp = np.arange(29040)
    b = synth.second_order1(ramp, 240, 121, 1, 250, 0.0, 0, 0)
    v = grib1.decode(next(grib1.messages(b)), b)
    assert v[0] == 0 and v[-1] == 29039 and v.mean() == 14519.5


def test_metadata():
    m, _ = read2(synth.simple2(X, NI, NJ))
    assert (m["reference_time"], m["surface_value"], m["grid"]["grid_type"], m["packing"]) == ("2024-03-14T15:09:26Z", 50000.0, "latlon", "grid_simple")


def test_several_messages_and_noise_between():
    b = b"xxGRIB" + synth.simple2(X, NI, NJ) + b"noise" + synth.complex2(X, NI, NJ)
    assert [m["packing"] for m in grib2.messages(b)] == ["grid_simple", "grid_complex"]


@pytest.mark.parametrize("cut", [5, 30, 60])
def test_cut_messages_are_not_found(cut):
    assert list(grib2.messages(synth.simple2(X, NI, NJ)[:-cut])) == []


def test_short_data_refused():
    b = bytearray(synth.complex2(X, NI, NJ))
    m = next(grib2.messages(bytes(b)))
    m["data_range"] = (m["data_range"][0], 10)
    with pytest.raises(bits.FormatError):
        grib2.decode(m, bytes(b))


def test_png_samples():
    rows = (X.reshape(NJ, NI).astype(">u2")).view(np.uint8).reshape(NJ, 2 * NI)
    body = png.encode(rows, 16)
    b = synth.grib2(NI, NJ, 41, synth.red(-1.0, -10, 0, 16) + b"\0", body, None, len(X))
    assert np.array_equal(read2(b)[1], WANT)


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    import struct
    import zlib

    rows = RNG.integers(0, 256, (6, 9)).astype(np.uint8)
    raw, up = b"", np.zeros(9, int)
    for r in rows.astype(int):
        left, corner = np.r_[0, r[:-1]], np.r_[0, up[:-1]]
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0, left, up, (left + up) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))][kind]
        raw += bytes([kind]) + ((r - guess) % 256).astype(np.uint8).tobytes()
        up = r
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    data = png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(png.decode(data)[0], rows)


def _aec_plain(x, n_bits):
    """Uncompressed blocks of 8, with preprocessing of nothing."""
    out = []
    for i in range(0, len(x), 8):
        out += [1] * (3 if n_bits <= 8 else 4)
        for v in x[i : i + 8]:
            out += [int(v) >> k & 1 for k in range(n_bits - 1, -1, -1)]
    return np.packbits(out).tobytes()


def _aec_split(x, k, n_bits):
    """Blocks of 8 mapped differences split at k bits, a reference sample first."""
    out, top = [], (1 << n_bits) - 1
    prev = int(x[0])
    for b in range(0, len(x), 8):
        own = []
        for i in range(b, b + 8):
            if i == 0:
                continue
            v, t = int(x[i]), min(prev, top - prev)
            d = v - prev
            own.append(2 * d if 0 <= d <= t else -2 * d - 1 if -t <= d < 0 else t + abs(d))
            prev = v
        out += [int(c) for c in format(k + 1, "03b")]
        if b == 0:
            out += [int(x[0]) >> j & 1 for j in range(n_bits - 1, -1, -1)]
        for d in own:
            out += [0] * (d >> k) + [1]
        for d in own:
            out += [d >> j & 1 for j in range(k - 1, -1, -1)]
    return np.packbits(out).tobytes()


@pytest.mark.parametrize(("bits", "block", "rsi"), [(5, 8, 8), (12, 16, 4), (8, 8, 128), (16, 32, 2), (20, 8, 70)])
def test_entropy_coder_round_trip(bits, block, rsi):
    """Noise, sparse values, a walk and long flat runs: every option, pairs and zero blocks up to whole segments."""
    rng = np.random.default_rng(1)
    for size in (1, 7, 64, 1000, 9000):
        walk = np.cumsum(rng.integers(-1, 2, size)) % (1 << bits)
        flat = np.repeat(rng.integers(0, 1 << bits, size // 600 + 1), 600)[:size]
        for x in (rng.integers(0, 1 << bits, size), (rng.random(size) < 0.02).astype(int), walk, flat):
            assert np.array_equal(aec.decode(synth_sections.entropy_coded(x, bits, block, rsi), size, bits, block, rsi, 8), x)


def test_entropy_coder():
    x = RNG.integers(0, 200, 64)
    assert np.array_equal(aec.decode(_aec_plain(x, 8), 64, 8, 8, 128, 0), x)
    walk = np.clip(np.cumsum(RNG.integers(-6, 7, 64)) + 100, 0, 255)
    for k in (0, 2, 4):
        assert np.array_equal(aec.decode(_aec_split(walk, k, 8), 64, 8, 8, 128, aec.PREPROCESS), walk)
    zero = np.packbits([0, 0, 0, 0, 0, 0, 0, 1]).tobytes()  # three identifier bits, zero-block, then four blocks
    assert not aec.decode(zero, 32, 8, 8, 128, 0).any()


@given(st.lists(st.integers(-500, 500), min_size=4, max_size=40), st.integers(0, 3), st.integers(-9, 9))
@settings(max_examples=60, deadline=None)
def test_differences_undone(v, order, bias):
    x = np.array(v)
    d = np.r_[x[:order], np.diff(x, n=order) - bias] if order else x
    assert np.array_equal(bits.undo_differences(d, order, bias), x)


@given(st.floats(-1e20, 1e20).filter(lambda v: v == 0 or abs(v) > 1e-20))
@settings(max_examples=60, deadline=None)
def test_ibm_floats(v):
    back = bits.ibm_float(int.from_bytes(bits.ibm_bytes(v), "big"))
    assert back == pytest.approx(v, rel=1e-6)


@pytest.mark.parametrize("version", [1, 2, 5])
def test_netcdf_classic(version):
    a, t = np.arange(12, dtype=np.int16).reshape(3, 4), np.arange(6, dtype=np.float32).reshape(2, 3)
    b = synth.netcdf3({"y": 3, "x": 4, "time": 0}, {"v": (["y", "x"], a, {"_FillValue": np.int16(5)}), "r": (["time", "y"], t, {}), "q": (["time"], np.array([1.5, 2.5]), {})}, {"title": "hi"}, version)
    d = netcdf3.header(b)
    assert d.attrs == {"title": "hi"} and d.records == 2
    assert netcdf3.values(b, d, "v").mask.sum() == 1 and np.array_equal(netcdf3.values(b, d, "r"), t) and np.array_equal(netcdf3.values(b, d, "q"), [1.5, 2.5])
    with pytest.raises(bits.FormatError):
        netcdf3.header(b[:40])


@pytest.mark.parametrize("chunk", [None, (2, 3), (5, 7)])
def test_hdf5(chunk):
    a = np.arange(35, dtype=np.int16).reshape(5, 7)
    b = synth.hdf5({"t": (a, {"units": "K", "_FillValue": np.int16(3)}), "lat": (np.linspace(0, 1, 5), {"CLASS": "DIMENSION_SCALE"})}, chunk)
    v = hdf5.values(b, "t")
    assert np.array_equal(v.data, a) and v.mask.sum() == 1
    assert [x[0] for x in hdf5.variables(b)] == ["lat", "t"]
    with pytest.raises(bits.FormatError):
        hdf5.variables(b[:60])


def test_reduced_rows_widen():
    v = np.ma.masked_array([1.0, 2, 3, 4, 5, 6])
    width, pl = 4, [2, 4]
    want = [v[(k * n + width // 2) // width % n + at] for n, at in zip(pl, (0, 2), strict=True) for k in range(width)]
    assert grib1.expand_reduced(v, pl).tolist() == want


def test_p1_edited_in_place():
    b = synth.simple1(X, NI, NJ)
    assert next(grib1.messages(grib1.set_p1(b, 0, 42)))["p1"] == 42


@pytest.mark.parametrize("axis", [0, 1])
@pytest.mark.parametrize("n", [1, 2, 3, 9, 33, 130])
def test_extensible_array_index(axis, n):
    """Chunks along an unlimited dimension, through direct elements, data blocks, secondary blocks and pages."""
    shape, chunk = ((2 * n - 1, 5), (2, 3)) if axis == 0 else ((5, 2 * n - 1), (3, 2))
    a = np.arange(1, 1 + 5 * (2 * n - 1), dtype=np.int16).reshape(shape)
    skip = set(range(40, 60)) | {5, 100, 101}
    v = hdf5.values(synth.hdf5({"t": (a, {})}, chunk, axis, tuple(skip)), "t")
    want = a.astype(float)
    for number in skip:  # two chunks lie side by side across the fixed dimension
        i, k = divmod(number, 2)
        own = (slice(2 * i, 2 * i + 2), slice(3 * k, 3 * k + 3))
        want[own if axis == 0 else own[::-1]] = 0
    assert np.array_equal(np.ma.getdata(v), want)


def test_extensible_array_that_is_broken():
    b = synth.hdf5({"t": (np.arange(90, dtype=np.int16).reshape(45, 2), {})}, (2, 2), 0)
    for mark in (b"EAHD", b"EAIB", b"EASB", b"EADB"):
        assert mark in b
        with pytest.raises(bits.FormatError):
            hdf5.values(b.replace(mark, b"XXXX"), "t")
