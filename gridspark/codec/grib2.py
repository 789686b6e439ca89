"""GRIB edition 2: message scan, section templates and value decoding (numpy, no Spark)."""

from __future__ import annotations

import struct

import numpy as np

from . import aec, png
from .bits import SLAB, FormatError, Stream, Unsupported, place, rows_turned, signed, undo_differences, unsigned

MAX_POINTS = 200_000_000
# Grid template numbers and earth shapes (code table 3.2), radii in metres.
GRID_NAMES = {0: "latlon", 1: "rotated_latlon", 10: "mercator", 20: "polar_stereographic", 30: "lambert", 40: "gaussian", 50: "spherical_harmonic", 61: "bifourier", 62: "bifourier", 63: "bifourier", 90: "space_view"}
EARTH = {0: (6_367_470.0, 6_367_470.0), 2: (6_378_160.0, 6_356_775.0), 4: (6_378_137.0, 6_356_752.314), 5: (6_378_137.0, 6_356_752.314245), 6: (6_371_229.0, 6_371_229.0), 8: (6_371_200.0, 6_371_200.0), 9: (6_377_563.396, 6_356_256.909)}
PACKINGS = {0: "grid_simple", 1: "grid_simple_matrix", 2: "grid_complex", 3: "grid_complex_spatial_differencing", 4: "grid_ieee", 40: "grid_jpeg", 40000: "grid_jpeg", 41: "grid_png", 40010: "grid_png", 42: "grid_ccsds", 50: "spectral_simple", 51: "spectral_complex", 53: "bifourier_complex", 61: "grid_simple_log_preprocessing", 200: "grid_run_length", 50001: "grid_second_order", 50002: "grid_second_order_boustrophedonic"}


def _scaled(p: bytes, at: int, n: int) -> float:
    return unsigned(p, at + 1, n) * 10.0 ** -signed(p, at, 1)


def earth(p: bytes) -> tuple[float, float] | None:
    """(semi-major, semi-minor) axis in metres."""
    code = p[0]
    if code in EARTH:
        return EARTH[code]
    if code == 1:
        r = _scaled(p, 1, 4)
        return r, r
    if code in (3, 7):
        k = 1000.0 if code == 3 else 1.0
        return _scaled(p, 6, 4) * k, _scaled(p, 11, 4) * k
    return None


def _deg(p: bytes, at: int, sm: bool = True) -> float:
    return (signed if sm else unsigned)(p, at, 4) / 1e6


def grid(template: int, p: bytes) -> dict:
    """Geometry of a section 3 payload; keys that do not apply are absent."""
    g: dict = {"grid_type": GRID_NAMES.get(template, f"unsupported_{template}"), "grid_template": template}
    if template not in GRID_NAMES:
        return g
    if template in (50, 61, 62, 63):
        if template == 50:
            return g | {"j": unsigned(p, 0, 4), "k": unsigned(p, 4, 4), "m": unsigned(p, 8, 4)}
        return g | {"n": unsigned(p, 1, 4), "m": unsigned(p, 5, 4), "truncation_type": p[0]}
    if (e := earth(p)) is not None:
        g |= {"earth_major": e[0], "earth_minor": e[1], "earth_radius": (2 * e[0] + e[1]) / 3}
    ni, nj = unsigned(p, 16, 4), unsigned(p, 20, 4)
    g |= {"ni": None if ni == 0xFFFFFFFF else ni, "nj": nj}
    if template in (0, 1, 40):
        g |= {"lat_first": _deg(p, 32), "lon_first": _deg(p, 36, False), "lat_last": _deg(p, 41), "lon_last": _deg(p, 45, False), "scan": p[57]}
        g["n_parallels" if template == 40 else "dj"] = unsigned(p, 53, 4) if template == 40 else unsigned(p, 53, 4) / 1e6
        if template == 1:
            g |= {"pole_lat": _deg(p, 58), "pole_lon": _deg(p, 62, False), "angle": struct.unpack(">f", p[66:70])[0]}
    elif template == 10:
        g |= {"lat_first": _deg(p, 24), "lon_first": _deg(p, 28), "lad": _deg(p, 33), "lat_last": _deg(p, 37), "lon_last": _deg(p, 41), "scan": p[45], "dx": unsigned(p, 50, 4) / 1e3, "dy": unsigned(p, 54, 4) / 1e3}
    elif template in (20, 30):
        g |= {"lat_first": _deg(p, 24), "lon_first": _deg(p, 28, False), "lad": _deg(p, 33), "lov": _deg(p, 37, template == 20), "dx": unsigned(p, 41, 4) / 1e3, "dy": unsigned(p, 45, 4) / 1e3, "south": bool(p[49] & 0x80), "scan": p[50]}
        if template == 30:
            g |= {"latin1": _deg(p, 51), "latin2": _deg(p, 55)}
    else:
        g |= {"sub_lat": _deg(p, 24), "sub_lon": _deg(p, 28), "dx": unsigned(p, 33, 4), "dy": unsigned(p, 37, 4), "xp": unsigned(p, 41, 4) / 1e3, "yp": unsigned(p, 45, 4) / 1e3, "scan": p[49], "nr": unsigned(p, 54, 4) / 1e6, "xo": unsigned(p, 58, 4), "yo": unsigned(p, 62, 4)}
    return g


def product(template: int, p: bytes) -> dict:
    """Parameter, level and forecast of a section 4 payload (4.0, 4.8, 4.11)."""
    out: dict = {"product_template": template}
    if template not in (0, 8, 11):
        return out
    surface = lambda at: None if p[at] == 255 or p[at + 1] == 255 or unsigned(p, at + 2, 4) == 0xFFFFFFFF else signed(p, at + 2, 4) * 10.0 ** -signed(p, at + 1, 1)
    return out | {"category": p[0], "number": p[1], "time_unit": p[8], "forecast_time": signed(p, 9, 4), "surface_type": p[13], "surface_value": surface(13), "surface2_type": p[19], "surface2_value": surface(19)}


def _timestamp(p: bytes, at: int) -> str:
    return "%04d-%02d-%02dT%02d:%02d:%02dZ" % (unsigned(p, at, 2), *p[at + 2 : at + 7])


def messages(data: bytes):
    """Metadata and section ranges of each message; nothing is decoded.  Only its first field is read."""
    at = index = 0
    while True:
        at = data.find(b"GRIB", at)
        if at < 0 or at + 16 > len(data):
            return
        if data[at + 7] != 2:
            at += 4
            continue
        total = unsigned(data, at + 8, 8)
        if total < 20 or at + total > len(data) or data[at + total - 4 : at + total] != b"7777":
            at += 4
            continue
        m = {"message_index": index, "byte_offset": at, "byte_length": total, "edition": 2, "discipline": data[at + 6]}
        pos, seen = at + 16, {}
        while pos < at + total - 4:
            n, number = unsigned(data, pos, 4), data[pos + 4]
            if n < 5 or pos + n > at + total - 4 or not 1 <= number <= 7:
                raise FormatError(f"section {number} of message {index} is broken")
            if number not in seen:
                seen[number] = (pos, n)
            if number == 7:
                break
            pos += n
        sec = {k: data[a : a + n] for k, (a, n) in seen.items() if k != 7}
        if not {1, 3, 4, 5, 7} <= set(seen):
            raise FormatError(f"message {index} lacks a section")
        s1 = sec[1]
        m |= {"centre": unsigned(s1, 5, 2), "sub_centre": unsigned(s1, 7, 2), "significance": s1[11], "reference_time": _timestamp(s1, 12), "production_status": s1[19], "data_type": s1[20]}
        m |= {"n_points": unsigned(sec[3], 6, 4), "grid": grid(unsigned(sec[3], 12, 2), sec[3][14:]), "list_octets": sec[3][10]}
        m |= product(unsigned(sec[4], 7, 2), sec[4][9:])
        t = unsigned(sec[5], 9, 2)
        m |= {"n_values": unsigned(sec[5], 5, 4), "drs_template": t, "packing": PACKINGS.get(t, f"unsupported_{t}"), "drs": sec[5][11:], "bitmap_section": sec.get(6, b"")[5:], "data_range": (seen[7][0] + 5, seen[7][1] - 5)}
        yield m
        index += 1
        at += total


def bitmap(section: bytes, count: int) -> np.ndarray | None:
    if not section or section[0] == 255:
        return None
    if section[0]:
        raise Unsupported(f"bitmap indicator {section[0]}")
    b = np.unpackbits(np.frombuffer(section[1:], np.uint8))
    if len(b) < count:
        raise FormatError("the bitmap is shorter than the grid")
    return b[:count]


def _red(d: bytes) -> tuple[float, float, float]:
    return struct.unpack(">f", d[:4])[0], 2.0 ** signed(d, 4, 2), 10.0 ** -signed(d, 6, 2)


def _apply(x: np.ndarray, d: bytes) -> np.ndarray:
    r, e, s = _red(d)
    return (r + x * e) * s


def _groups(d: bytes, s: Stream, n: int) -> np.ma.MaskedArray:
    """Group expansion of complex packing: integers, inline missing ones masked."""
    if d[10] > 1 or d[11] > 2:
        raise Unsupported("this group splitting or missing-value management")
    g, bits = unsigned(d, 20, 4), d[8]
    if g > n:
        raise FormatError("more groups than values")
    refs = s.take(g, bits)
    s.align()
    widths = s.take(g, d[25]) + d[24]
    s.align()
    lengths = s.take(g, d[35]) * d[30] + unsigned(d, 26, 4)
    lengths[-1] = unsigned(d, 31, 4)
    s.align()
    if int(lengths.sum()) != n:
        raise FormatError(f"group lengths add up to {int(lengths.sum())}, {n} values are needed")
    x = s.take_runs(lengths, widths)
    w, r = np.repeat(widths, lengths), np.repeat(refs, lengths)
    out = np.ma.masked_array(r + x, mask=np.zeros(n, bool))
    if d[11]:
        top = np.where(w == 0, (1 << bits) - 1, (1 << w) - 1)
        own = np.where(w == 0, r, x)
        out.mask = (own == top) | ((own == top - 1) if d[11] == 2 else False)
    return out


def _complex(d: bytes, data: bytes, n: int, differencing: bool) -> np.ndarray:
    if unsigned(d, 20, 4) == 0:
        return np.full(n, struct.unpack(">f", d[:4])[0])
    s = Stream(data)
    if not differencing:
        return _apply(_groups(d, s, n).astype(np.float64), d)
    order, octets = d[36], d[37]
    if order not in (1, 2):
        raise Unsupported(f"spatial differencing of order {order}")
    extra = [unsigned(data, k * octets, octets) for k in range(order)] if octets else [0] * order
    low = signed(data, order * octets, octets) if octets else 0
    s.at = 8 * octets * (order + 1)
    x = _groups(d, s, n)
    own = x.compressed()  # the recurrence passes over missing points
    own[:order] = extra[: len(own)]
    x[~np.ma.getmaskarray(x)] = undo_differences(own, order, low)[: len(own)] if len(own) >= order else own
    return _apply(x.astype(np.float64), d)


def _second_order(d: bytes, data: bytes, n: int, template: int) -> np.ndarray:
    g = unsigned(d, 10, 4)
    if g == 0:
        return np.full(n, struct.unpack(">f", d[:4])[0] * 10.0 ** -signed(d, 6, 2))
    at = 20 + (template == 50002)
    order, width = d[at], (d[at + 1] if d[at] else 0)
    seeds, bias = [], 0
    if order:
        s = Stream(d, at + 2)
        seeds = s.take(order, width).tolist()
        v = int(s.take(1, width)[0])
        bias = -(v & ((1 << (width - 1)) - 1)) if v >> (width - 1) else v
    s = Stream(data)
    widths = s.take(g, d[18])
    s.align()
    lengths = s.take(g, d[19])
    s.align()
    first = s.take(g, d[9])
    s.align()
    if int(lengths.sum()) + order != n:
        raise FormatError("group lengths and seeds give another number of values")
    x = np.concatenate([np.array(seeds, np.int64), s.take_runs(lengths, widths) + np.repeat(first, lengths)])
    return _apply(undo_differences(x, order, bias), d)


def _run_length(d: bytes, data: bytes, n: int) -> np.ndarray:
    bits, top, levels = d[0], unsigned(d, 1, 2), unsigned(d, 3, 2)
    if top == 0 or not data:
        return np.ma.masked_all(n)
    table = np.ma.masked_array(np.r_[0.0, [unsigned(d, 6 + 2 * k, 2) for k in range(levels)]] * 10.0 ** -signed(d, 5, 1))
    table[0] = np.ma.masked
    base = (1 << bits) - 1 - top
    if base <= 0:
        raise FormatError("no room for run digits")
    codes = Stream(data).take(8 * len(data) // bits, bits)
    start = np.flatnonzero(codes <= top)
    if not len(start) or start[0]:
        raise FormatError("run-length data begin inside a run")
    run = np.cumsum(codes <= top) - 1
    digit = np.arange(len(codes)) - start[run] - 1
    add = np.where(codes > top, (codes - top - 1) * float(base) ** np.maximum(digit, 0), 0.0)
    length = (np.bincount(run, add) + 1).astype(np.int64)
    # codes of the padding after the last run are not data
    ends = np.cumsum(length)
    k = int(np.searchsorted(ends, n)) + 1
    if k > len(ends) or ends[k - 1] != n or codes[start[:k]].max() > levels:
        raise FormatError("runs do not fill the grid")
    return np.ma.repeat(table[codes[start[:k]]], length[:k]) if hasattr(np.ma, "repeat") else table[np.repeat(codes[start[:k]], length[:k])]


def _samples(d: bytes, data: bytes, n: int) -> np.ndarray:
    rows, per = png.decode(data)
    if per % 8:
        return Stream(rows.tobytes()).take(n, per)
    k = per // 8
    b = rows.reshape(-1)[: n * k].reshape(n, k).astype(np.int64)
    return b @ (1 << (8 * np.arange(k - 1, -1, -1)))


def matrix(d: bytes, data: bytes, bits: np.ndarray | None, points: int) -> np.ndarray:
    """True matrices of values: (point, NR, NC), masked where a secondary bitmap has no value."""
    nr, nc = unsigned(d, 14, 2), unsigned(d, 16, 2)
    present = points if bits is None else int(bits.sum())
    s = Stream(data)
    second = s.take(present * nr * nc, 1)
    s.align()
    v = _apply(s.take(int(second.sum()), d[8]) if d[8] else np.zeros(int(second.sum()), np.int64), d)
    own = place(v, second, present * nr * nc).reshape(present, nr * nc)
    out = np.ma.masked_all((points, nr * nc))
    out[np.ones(points, bool) if bits is None else bits.astype(bool)] = own
    return out.reshape(points, nr, nc)


PLAIN = (0, 4, 61)  # templates whose values stand one after another


def _plain(t: int, d: bytes, s: Stream, k: int) -> np.ndarray:
    """The next k values of a stream: simple packing, IEEE numbers or logarithms."""
    if t == 4:
        kind = {1: ">f4", 2: ">f8"}.get(d[0])
        if kind is None:
            raise Unsupported(f"IEEE precision {d[0]}")
        at = s.at // 8
        s.at += 8 * k * int(kind[2])
        if s.at > 8 * len(s.data):
            raise FormatError("a packed section ends before its numbers do")
        return s.data[at : s.at // 8].view(kind).astype(np.float64)
    v = _apply(s.take(k, d[8]) if d[8] else np.zeros(k, np.int64), d)
    return np.exp(v) - struct.unpack(">f", d[9:13])[0] if t == 61 else v


def slabs(m: dict, data: bytes):
    """(first, values) of at most SLAB values each: ``decode`` in pieces, never all values at once where they stand one after another."""
    n, t, d = m["n_points"], m["drs_template"], m["drs"]
    if t not in PLAIN or n > MAX_POINTS or m["grid"].get("scan", 0) & 0x30 == 0x10:
        v = decode(m, data)
        yield from ((k, v[k : k + SLAB]) for k in range(0, len(v), SLAB))
        return
    a, size = m["data_range"]
    bits, s = bitmap(m["bitmap_section"], n), Stream(memoryview(data)[a : a + size])
    for first in range(0, n, SLAB):
        count = min(SLAB, n - first)
        own = None if bits is None else bits[first : first + count]
        yield first, place(_plain(t, d, s, count if own is None else int(own.sum())), own, count)


def decode(m: dict, data: bytes) -> np.ma.MaskedArray:
    """Values of a message in storage order, masked where missing."""
    n = m["n_points"]
    if n > MAX_POINTS:
        raise FormatError("more points than the engine decodes")
    t, d = m["drs_template"], m["drs"]
    a, size = m["data_range"]
    body = data[a : a + size]
    bits = bitmap(m["bitmap_section"], n)
    k = n if bits is None else int(bits.sum())
    if t in PLAIN:
        v = _plain(t, d, Stream(body), k)
    elif t == 1:
        if d[9]:
            raise Unsupported("a matrix at each point has no single field; use matrix()")
        v = _simple(d, body, k)
    elif t in (2, 3):
        v = _complex(d, body, k, t == 3)
    elif t in (41, 40010):
        v = _apply(_samples(d, body, k) if d[8] else np.zeros(k, np.int64), d)
    elif t == 42:
        v = _apply(aec.decode(body, k, d[8], d[11], unsigned(d, 12, 2), d[10]) if d[8] else np.zeros(k, np.int64), d)
    elif t == 200:
        v = _run_length(d, body, k)
    elif t in (50001, 50002):
        v = _second_order(d, body, k, t)
    elif t in PACKINGS:
        raise Unsupported(f"values packed as {PACKINGS[t]} are not decoded to a grid")
    else:
        raise Unsupported(f"data representation template 5.{t}")
    out = place(v, bits, n)
    g = m["grid"]
    if t == 50002 and d[20] & 0x80 or g.get("scan", 0) & 0x30 == 0x10:
        out = rows_turned(out, g["ni"])
    return out


def coefficients(m: dict, data: bytes) -> list[tuple[int, int, float, float]]:
    """(m, n, re, im) of a spectral message (5.50 simple, 5.51 complex)."""
    t, d = m["drs_template"], m["drs"]
    a, size = m["data_range"]
    body, big = data[a : a + size], m["grid"]["j"]
    order = [(k, n) for k in range(big + 1) for n in range(k, big + 1)]
    if t == 50:
        v = np.r_[struct.unpack(">f", d[9:13])[0], 0.0, _apply(Stream(body).take(2 * len(order) - 2, d[8]), d)]
        return [(k, n, float(v[2 * i]), 0.0 if k == 0 else float(v[2 * i + 1])) for i, (k, n) in enumerate(order)]
    if t != 51:
        raise Unsupported(f"template 5.{t} has no spherical-harmonic coefficients")
    p, sub = signed(d, 9, 4) / 1e6, unsigned(d, 13, 2)
    kind = {1: ">f4", 2: ">f8"}.get(d[23])
    if kind is None:
        raise Unsupported(f"precision {d[23]} of the unpacked subset")
    inner = [(k, n) for k, n in order if n <= sub]
    raw = np.frombuffer(body, kind, 2 * len(inner)).astype(np.float64)
    outer = [(k, n) for k, n in order if n > sub]
    x = Stream(body, raw.size * int(kind[2])).take(2 * len(outer), d[8]).astype(np.float64)
    packed = _apply(x, d)
    found = {c: (raw[2 * i], raw[2 * i + 1]) for i, c in enumerate(inner)}
    for i, (k, n) in enumerate(outer):
        f = float(n * (n + 1)) ** -p
        found[k, n] = packed[2 * i] * f, packed[2 * i + 1] * f
    return [(k, n, float(found[k, n][0]), 0.0 if k == 0 else float(found[k, n][1])) for k, n in order]


def _reach(kind: int, ni: int, nj: int) -> np.ndarray:
    """Largest i kept for each j of a truncation: 77 rectangle, 88 ellipse, 99 diamond."""
    j = np.arange(nj + 1)
    if kind == 77:
        return np.full(nj + 1, ni)
    if kind == 88:
        return (ni / nj * np.sqrt(np.maximum(nj * nj - j * j, 0)) + 1e-10).astype(np.int64) if nj else np.array([ni])
    if kind == 99:
        return ni - j * ni // nj if nj else np.array([-1])
    raise Unsupported(f"bi-Fourier truncation {kind}")


def bifourier(m: dict, data: bytes) -> list[tuple[int, int, float, float, float, float]]:
    """(j, i, four coefficients) of a bi-Fourier message (5.53), j outermost."""
    if m["drs_template"] != 53:
        raise Unsupported("not a bi-Fourier message")
    d, g = m["drs"], m["grid"]
    a, size = m["data_range"]
    body = data[a : a + size]
    kind = {1: ">f4", 2: ">f8"}.get(d[23])
    if kind is None:
        raise Unsupported(f"precision {d[23]} of the unpacked subset")
    p, sub_i, sub_j = signed(d, 11, 4) / 1e6, unsigned(d, 15, 2), unsigned(d, 17, 2)
    reach = _reach(g["truncation_type"], g["n"], g["m"])
    j = np.repeat(np.arange(g["m"] + 1), np.maximum(reach + 1, 0))
    i = np.concatenate([np.arange(max(r + 1, 0)) for r in reach.tolist()])
    by_j, by_i = _reach(d[9], sub_i, sub_j), _reach(d[9], sub_j, sub_i)
    inner = (i <= sub_i) & (j <= sub_j) & (i <= by_j[np.minimum(j, sub_j)]) & (j <= by_i[np.minimum(i, sub_i)])
    if d[10]:
        inner |= (i == 0) | (j == 0)
    if 4 * len(i) != m["n_values"]:
        raise FormatError("the truncation gives another number of coefficients")
    out = np.empty((len(i), 4))
    n = int(inner.sum())
    out[inner] = np.frombuffer(body, kind, 4 * n).astype(np.float64).reshape(n, 4)
    scale = (i[~inner] ** 2 + j[~inner] ** 2).astype(np.float64) ** p
    if (scale == 0).any():
        raise FormatError("the Laplacian of a packed coefficient is zero")
    x = Stream(body, 4 * n * int(kind[2])).take(4 * int((~inner).sum()), d[8])
    out[~inner] = _apply(x, d).reshape(-1, 4) / scale[:, None]
    return [(int(b), int(a), *map(float, c)) for a, b, c in zip(i, j, out, strict=True)]
