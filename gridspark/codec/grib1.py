"""GRIB edition 1: message scan, product and grid sections, value decoding (numpy, no Spark)."""

from __future__ import annotations

import numpy as np

from .bits import FormatError, Stream, Unsupported, ibm_float, place, rows_turned, signed, undo_differences, unsigned

MAX_POINTS = 64 * 1024 * 1024
# Data representation types (table 6) and the predefined grids used without a grid section.
GRID_NAMES = {0: "latlon", 1: "mercator", 3: "lambert", 4: "gaussian", 5: "polar_stereographic", 10: "rotated_latlon", 50: "spherical_harmonic", 90: "space_view"}
PREDEFINED = {2: (144, 73, 90.0, 0.0, -90.0, 357.5, 2.5), 3: (360, 181, 90.0, 0.0, -90.0, 359.0, 1.0), 4: (720, 361, 90.0, 0.0, -90.0, 359.5, 0.5)}


def _deg(p: bytes, at: int) -> float:
    return signed(p, at, 3) / 1e3


def grid(p: bytes) -> dict:
    """Geometry of a grid description section."""
    kind = p[5]
    g: dict = {"grid_type": GRID_NAMES.get(kind, f"unsupported_{kind}")}
    if kind == 50:
        return g | {"j": unsigned(p, 6, 2), "k": unsigned(p, 8, 2), "m": unsigned(p, 10, 2)}
    if kind not in GRID_NAMES:
        return g
    ni, nj = unsigned(p, 6, 2), unsigned(p, 8, 2)
    g |= {"ni": None if ni == 0xFFFF else ni, "nj": nj, "lat_first": _deg(p, 10), "lon_first": _deg(p, 13), "scan": p[27]}
    if kind in (0, 4, 10):
        g |= {"lat_last": _deg(p, 17), "lon_last": _deg(p, 20)}
        g["n_parallels" if kind == 4 else "dj"] = unsigned(p, 25, 2) if kind == 4 else unsigned(p, 25, 2) / 1e3
        if kind == 10:
            g |= {"pole_lat": _deg(p, 32), "pole_lon": _deg(p, 35), "angle": ibm_float(unsigned(p, 38, 4))}
    elif kind == 1:
        g |= {"lat_last": _deg(p, 17), "lon_last": _deg(p, 20), "lad": _deg(p, 23), "dx": unsigned(p, 28, 3), "dy": unsigned(p, 31, 3)}
    elif kind in (3, 5):
        g |= {"lov": _deg(p, 17), "dx": unsigned(p, 20, 3), "dy": unsigned(p, 23, 3), "south": bool(p[26] & 0x80)}
        if kind == 3:
            g |= {"latin1": _deg(p, 28), "latin2": _deg(p, 31)}
            g["lad"] = g["latin1"]
        else:
            g["lad"] = 60.0
    if ni == 0xFFFF:  # a list of row lengths
        at = p[4] - 1 + 4 * p[3]
        g["pl"] = [unsigned(p, at + 2 * k, 2) for k in range(nj)]
        g["grid_type"] = "reduced_" + g["grid_type"]
    return g


def messages(data: bytes):
    """Metadata and section ranges of each message; nothing is decoded."""
    at = index = 0
    while True:
        at = data.find(b"GRIB", at)
        if at < 0 or at + 8 > len(data):
            return
        total = unsigned(data, at + 4, 3)
        if data[at + 7] != 1 or total < 12 or at + total > len(data) or data[at + total - 4 : at + total] != b"7777":
            at += 4
            continue
        pos = at + 8
        pds = data[pos : pos + unsigned(data, pos, 3)]
        pos += len(pds)
        m = {"message_index": index, "byte_offset": at, "byte_length": total, "edition": 1, "table_version": pds[3], "centre": pds[4], "process": pds[5], "grid_number": pds[6], "parameter": pds[8], "level_type": pds[9], "level_1": pds[10], "level_2": pds[11], "time_unit": pds[17], "p1": pds[18], "p2": pds[19], "time_range": pds[20], "sub_centre": pds[25], "decimal": signed(pds, 26, 2)}
        m["reference_time"] = "%04d-%02d-%02dT%02d:%02d:00Z" % ((pds[24] - 1) * 100 + pds[12], *pds[13:17])
        if pds[7] & 0x80:
            n = unsigned(data, pos, 3)
            m["grid"] = grid(data[pos : pos + n])
            pos += n
        elif pds[6] in PREDEFINED:
            ni, nj, a, b, c, d, step = PREDEFINED[pds[6]]
            m["grid"] = {"grid_type": "latlon", "ni": ni, "nj": nj, "lat_first": a, "lon_first": b, "lat_last": c, "lon_last": d, "dj": step, "scan": 0}
        else:
            raise Unsupported(f"no grid section and predefined grid {pds[6]}")
        m["bitmap_range"] = None
        if pds[7] & 0x40:
            n = unsigned(data, pos, 3)
            m["bitmap_range"] = (pos, n)
            pos += n
        n = unsigned(data, pos, 3)
        m |= {"data_range": (pos, n), "packing": packing(data[pos : pos + n])}
        yield m
        index += 1
        at += total


def packing(b: bytes) -> str:
    """Name of the packing the data section's flags select."""
    f = b[3]
    if f & 0x80:
        return "spectral_complex" if f & 0x40 else "spectral_simple"
    if f & 0x40:
        if not f & 0x10:
            return "unsupported_complex"
        x = b[13]
        if x & 0x08:
            return "grid_second_order_spd" + str((x >> 1 & 1) * 2 + (x & 1)) if x & 0x03 else "grid_second_order_no_spd"
        return {(0, 1): "grid_second_order_row_by_row", (1, 0): "grid_second_order_constant_width", (1, 1): "grid_second_order_general"}.get((x >> 5 & 1, x >> 4 & 1), "unsupported_complex")
    if f & 0x10:
        return "grid_ieee" if f & 0x20 else "grid_simple_matrix"
    return "grid_simple"


def points(g: dict) -> int:
    return sum(g["pl"]) if "pl" in g else g["ni"] * g["nj"]


def bitmap(b: bytes, count: int) -> np.ndarray:
    if unsigned(b, 4, 2):
        raise Unsupported("predefined bitmaps")
    bits = np.unpackbits(np.frombuffer(b[6:], np.uint8))
    if len(bits) < count:
        raise FormatError("the bitmap is shorter than the grid")
    return bits[:count]


def _scale(x, b: bytes, decimal: int) -> np.ndarray:
    return (ibm_float(unsigned(b, 6, 4)) + np.asarray(x, np.float64) * 2.0 ** signed(b, 4, 2)) * 10.0**-decimal


def _extended(b: bytes, n: int, ni: int) -> np.ndarray:
    """General extended second order: SPD seeds and bias, group widths, lengths, references, residuals."""
    flag = b[13]
    order = (flag >> 1 & 1) * 2 + (flag & 1)
    groups = unsigned(b, 16, 2) + 65536 * b[20]
    s = Stream(b, 25)
    seeds, bias = np.zeros(0, np.int64), 0
    if order:
        width = b[25]
        s = Stream(b, 26)
        seeds = s.take(order, width)
        v = int(s.take(1, width)[0])
        bias = -(v & ((1 << (width - 1)) - 1)) if v >> (width - 1) else v
        s.align()
    widths = s.take(groups, b[21])
    s.align()
    lengths = s.take(groups, b[22])
    s.at = 8 * (unsigned(b, 11, 2) - 1)
    first = s.take(groups, b[10])
    s.at = 8 * (unsigned(b, 14, 2) - 1)
    if int(lengths.sum()) + order != n:
        raise FormatError("group lengths and seeds give another number of values")
    x = np.concatenate([seeds, s.take_runs(lengths, widths) + np.repeat(first, lengths)])
    x = undo_differences(x, order, bias)
    return rows_turned(x, ni) if flag & 0x04 else x


def _classic(b: bytes, n: int, ni: int, kind: str) -> np.ndarray:
    """Row-by-row, constant-width and general second order: a group per row or per set bit of a bitmap."""
    groups = unsigned(b, 16, 2) + 65536 * b[20]
    one = kind == "grid_second_order_constant_width"
    widths = np.full(groups, b[21], np.int64) if one else np.frombuffer(b[21 : 21 + groups], np.uint8).astype(np.int64)
    s = Stream(b, 22 if one else 21 + groups)
    if kind == "grid_second_order_row_by_row":
        if groups * ni != n:
            raise FormatError("row-by-row packing needs a group for each row")
        lengths = np.full(groups, ni, np.int64)
    else:
        starts = np.flatnonzero(s.take(n, 1))
        if len(starts) != groups or not groups or starts[0]:
            raise FormatError("the secondary bitmap does not begin each group")
        lengths = np.diff(np.r_[starts, n])
        s.align()
    s.at = 8 * (unsigned(b, 11, 2) - 1)
    first = s.take(groups, b[10])
    s.at = 8 * (unsigned(b, 14, 2) - 1)
    return s.take_runs(lengths, widths) + np.repeat(first, lengths)


def decode(m: dict, data: bytes) -> np.ma.MaskedArray:
    """Values of a message in storage order, masked where missing; reduced grids keep their short rows."""
    g = m["grid"]
    n = points(g)
    if n > MAX_POINTS:
        raise FormatError("more points than the engine decodes")
    a, size = m["data_range"]
    b = data[a : a + size]
    bits = None
    if m["bitmap_range"]:
        p, k = m["bitmap_range"]
        bits = bitmap(data[p : p + k], n)
    k = n if bits is None else int(bits.sum())
    kind = m["packing"]
    if kind == "grid_simple":
        v = _scale(Stream(b, 11).take(k, b[10]) if b[10] else np.zeros(k), b, m["decimal"])
    elif kind == "grid_ieee":
        form = {32: ">f4", 64: ">f8"}.get(b[10])
        if form is None:
            raise Unsupported(f"IEEE values of {b[10]} bits")
        v = np.frombuffer(b, form, k, 11).astype(np.float64)
    elif kind == "grid_simple_matrix":
        if b[13] & 0x40:
            raise Unsupported("a matrix at each point has no single field")
        at = 24 + 4 * (b[19] + b[21])
        v = _scale(Stream(b, at).take(k, b[10]), b, m["decimal"])
    elif kind.startswith("grid_second_order"):
        if bits is not None and not bits.all():
            raise Unsupported("second-order packing with a bitmap")
        ni = g["ni"] or 0
        x = _extended(b, n, ni) if "spd" in kind else _classic(b, n, ni, kind)
        return np.ma.masked_array(_scale(x, b, m["decimal"]))
    else:
        raise Unsupported(f"packing {kind}")
    return place(v, bits, n)


def coefficients(m: dict, data: bytes) -> list[tuple[int, int, float, float]]:
    """(m, n, re, im) of a spectral message with simple packing."""
    a, size = m["data_range"]
    b = data[a : a + size]
    big = m["grid"]["j"]
    order = [(k, n) for k in range(big + 1) for n in range(k, big + 1)]
    if m["packing"] == "spectral_simple":
        v = np.r_[ibm_float(unsigned(b, 11, 4)), 0.0, _scale(Stream(b, 15).take(2 * len(order) - 2, b[10]), b, m["decimal"])]
        return [(k, n, float(v[2 * i]), 0.0 if k == 0 else float(v[2 * i + 1])) for i, (k, n) in enumerate(order)]
    if m["packing"] != "spectral_complex":
        raise Unsupported(f"packing {m['packing']} has no coefficients")
    power, js, ks, ms = signed(b, 13, 2) / 1e3, b[15], b[16], b[17]
    if not js == ks == ms or ks > big:
        raise Unsupported("a sub-truncation that is no triangle")
    n = np.array([c[1] for c in order])
    scale = np.where(n > 0, np.maximum(n * (n + 1.0), 1.0) ** -power, 0.0)
    inner = n <= ks
    k = int(inner.sum())
    out = np.zeros((len(order), 2))
    raw = [ibm_float(unsigned(b, 18 + 4 * q, 4)) for q in range(2 * k)]
    out[inner] = np.array(raw).reshape(k, 2)
    out[n == ks] *= scale[n == ks][:, None]  # the last row of the subset is scaled as well
    x = Stream(b, 18 + 8 * k).take(2 * (len(order) - k), b[10]) if b[10] else np.zeros(2 * (len(order) - k))
    out[~inner] = _scale(x, b, m["decimal"]).reshape(-1, 2) * scale[~inner][:, None]
    return [(c[0], c[1], float(v[0]), 0.0 if c[0] == 0 and c[1] > ks else float(v[1])) for c, v in zip(order, out, strict=True)]


def matrix(m: dict, data: bytes) -> np.ma.MaskedArray:
    """True matrices of values: (point, NR, NC), masked where a secondary bitmap has no value."""
    a, size = m["data_range"]
    b = data[a : a + size]
    if m["packing"] != "grid_simple_matrix" or not b[13] & 0x40:
        raise Unsupported("not a matrix of values")
    if not b[13] & 0x20:
        raise Unsupported("a matrix of values without secondary bitmaps")
    count = points(m["grid"])
    bits = None
    if m["bitmap_range"]:
        p, k = m["bitmap_range"]
        bits = bitmap(data[p : p + k], count)
    nr, nc = unsigned(b, 14, 2), unsigned(b, 16, 2)
    present = count if bits is None else int(bits.sum())
    if unsigned(b, 11, 2) != present or not nr * nc:
        raise FormatError("the matrix header disagrees with the grid")
    s = Stream(b, 24 + 4 * (b[19] + b[21]))
    second = s.take(present * nr * nc, 1)
    s.align()
    own = place(_scale(s.take(int(second.sum()), b[10]), b, m["decimal"]), second, present * nr * nc).reshape(present, nr * nc)
    out = np.ma.masked_all((count, nr * nc))
    out[np.ones(count, bool) if bits is None else bits.astype(bool)] = own
    return out.reshape(count, nr, nc)


def expand_reduced(v: np.ma.MaskedArray, pl: list[int]) -> np.ma.MaskedArray:
    """Short rows widened to the widest: column k takes (k*len + width/2) / width % len."""
    width = max(pl)
    k, out, at = np.arange(width), [], 0
    for n in pl:
        out.append(v[at : at + n][(k * n + width // 2) // width % n] if n else np.ma.masked_all(width))
        at += n
    return np.ma.concatenate(out)


def set_p1(data: bytes, byte_offset: int, value: int) -> bytes:
    """The file with the P1 octet of the message at byte_offset replaced."""
    if not 0 <= value <= 255:
        raise ValueError("P1 is one octet")
    at = byte_offset + 8 + 18
    return data[:at] + bytes([value]) + data[at + 1 :]
