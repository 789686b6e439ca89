"""Writers of grid, product, spectral and entropy-coded sections, for tests and round-trip queries.

Sections are laid out from the published octet tables of the GRIB manuals: a table row names an
octet (counted from 1 in its section), its length and its kind, so writer and reader share no layout.
"""

from __future__ import annotations

import struct

import numpy as np

from .bits import ibm_bytes, pack
from .synth import _section, _sm, bds, red

# Octets of section 3 by template (manual on codes, part B): name -> (octet, length, kind);
# u unsigned, s sign and magnitude, f IEEE.
_ENDS = {"lat_first": (47, 4, "s"), "lon_first": (51, 4, "u"), "lat_last": (56, 4, "s"), "lon_last": (60, 4, "u"), "dx": (64, 4, "u"), "dy": (68, 4, "u"), "scan": (72, 1, "u")}
_PLANE = {"lat_first": (39, 4, "s"), "lon_first": (43, 4, "u"), "lad": (48, 4, "s"), "lov": (52, 4, "u"), "dx": (56, 4, "u"), "dy": (60, 4, "u"), "centre": (64, 1, "u"), "scan": (65, 1, "u")}
GRID2 = {
    0: (72, _ENDS),
    1: (84, _ENDS | {"pole_lat": (73, 4, "s"), "pole_lon": (77, 4, "u"), "angle": (81, 4, "f")}),
    10: (72, {"lat_first": (39, 4, "s"), "lon_first": (43, 4, "u"), "lad": (48, 4, "s"), "lat_last": (52, 4, "s"), "lon_last": (56, 4, "u"), "scan": (60, 1, "u"), "dx": (65, 4, "u"), "dy": (69, 4, "u")}),
    20: (65, _PLANE),
    30: (81, _PLANE | {"latin1": (66, 4, "s"), "latin2": (70, 4, "s")}),
    40: (72, _ENDS),
}
# The same of edition 1 (grid description section, by data representation type).
_ENDS1 = {"lat_first": (11, 3, "s"), "lon_first": (14, 3, "s"), "lat_last": (18, 3, "s"), "lon_last": (21, 3, "s"), "dx": (24, 2, "u"), "dy": (26, 2, "u"), "scan": (28, 1, "u")}
_PLANE1 = {"lat_first": (11, 3, "s"), "lon_first": (14, 3, "s"), "lov": (18, 3, "s"), "dx": (21, 3, "u"), "dy": (24, 3, "u"), "centre": (27, 1, "u"), "scan": (28, 1, "u")}
GRID1 = {
    0: (32, _ENDS1),
    1: (42, {k: v for k, v in _ENDS1.items() if k not in ("dx", "dy")} | {"lad": (24, 3, "s"), "dx": (29, 3, "u"), "dy": (32, 3, "u")}),
    3: (42, _PLANE1 | {"latin1": (29, 3, "s"), "latin2": (32, 3, "s")}),
    4: (32, _ENDS1),
    5: (32, _PLANE1),
    10: (42, _ENDS1 | {"pole_lat": (33, 3, "s"), "pole_lon": (36, 3, "s"), "angle": (39, 4, "i")}),
}


def _laid(size: int, octets: dict, values: dict) -> bytearray:
    out = bytearray(size)
    for name, (at, n, kind) in octets.items():
        v = values.get(name, 0)
        raw = struct.pack(">f", v) if kind == "f" else ibm_bytes(v) if kind == "i" else _sm(int(v), n) if kind == "s" else int(v).to_bytes(n, "big")
        out[at - 1 : at - 1 + n] = raw
    return out


def grid2(template: int, ni: int, nj: int, earth: bytes, **values) -> bytes:
    """Section 3 with the grid template; numbers as they are stored (micro-degrees, millimetres)."""
    size, octets = GRID2[template]
    s = _laid(size, octets, values)
    s[:14] = struct.pack(">IBBIBBH", size, 3, 0, ni * nj, 0, 0, template)
    s[14:30] = earth.ljust(16, b"\0")
    s[30:38] = struct.pack(">II", ni, nj)
    return bytes(s)


def message2(s3: bytes, s4: bytes, template: int, drs: bytes, body: bytes, n: int) -> bytes:
    s1 = _section(1, struct.pack(">HHBBB", 98, 0, 30, 0, 1) + struct.pack(">HBBBBB", 2024, 3, 14, 15, 9, 26) + bytes([0, 1]))
    secs = s1 + s3 + s4 + _section(5, struct.pack(">IH", n, template) + drs) + _section(6, b"\xff") + _section(7, body)
    return b"GRIB\0\0" + bytes([0, 2]) + struct.pack(">Q", 16 + len(secs) + 4) + secs + b"7777"


def product2(template: int, category: int = 0, number: int = 0, unit: int = 1, forecast: int = 0, first: tuple = (255, None, None), second: tuple = (255, None, None)) -> bytes:
    """Section 4 of template 4.0, 4.8 or 4.11; a surface is (type, scale factor, scaled value), None for missing."""
    surface = lambda s: bytes([s[0]]) + (b"\xff" if s[1] is None else _sm(s[1], 1)) + (b"\xff" * 4 if s[2] is None else _sm(s[2], 4))
    body = bytes([category, number, 2, 0, 96, 0, 0, 0, unit]) + _sm(forecast, 4) + surface(first) + surface(second)
    tail = {0: b"", 8: bytes(24), 11: bytes(27)}[template]
    return _section(4, struct.pack(">HH", 0, template) + body + tail)


def grid_message2(template: int, ni: int, nj: int, earth: bytes, **values) -> bytes:
    return message2(grid2(template, ni, nj, earth, **values), product2(0), 0, red(0.0, 0, 0, 0) + b"\0", b"", ni * nj)


def message1(gds: bytes | None, body: bytes, number: int = 255) -> bytes:
    pds = bytes([0, 0, 28, 3, 98, 130, number, 0x80 if gds else 0, 11, 100, 1, 244, 24, 3, 14, 15, 9, 1, 6, 0, 0, 0, 0, 0, 21, 0]) + _sm(0, 2)
    out = pds + (gds or b"") + body
    return b"GRIB" + (8 + len(out) + 4).to_bytes(3, "big") + bytes([1]) + out + b"7777"


def grid1(kind: int, ni: int, nj: int, **values) -> bytes:
    """A grid description section; numbers as they are stored (milli-degrees, metres)."""
    size, octets = GRID1[kind]
    s = _laid(size, octets, values)
    s[:10] = size.to_bytes(3, "big") + bytes([0, 255, kind]) + struct.pack(">HH", ni, nj)
    return bytes(s)


def grid_message1(kind: int, ni: int, nj: int, **values) -> bytes:
    return message1(grid1(kind, ni, nj, **values), bds(0, 0, 0.0, 0, b""))


def classic1(x: np.ndarray, ni: int, nj: int, kind: str, size: int = 5, r: float = -1.0, e: int = -10) -> bytes:
    """Second-order packing of edition 1: "rows" (a group a row), "constant" (one width) or "general"."""
    x = np.asarray(x, np.int64)
    step = ni if kind == "rows" else size
    parts = [x[i : i + step] for i in range(0, len(x), step)]
    first = [int(p.min()) for p in parts]
    widths = [int(p.max() - p.min()).bit_length() for p in parts]
    if kind == "constant":
        widths = [max(widths)] * len(parts)
    own = bytes(widths[:1] if kind == "constant" else widths)
    marks = b"" if kind == "rows" else pack(np.arange(len(x)) % step == 0, 1)
    wide = max(1, max(first).bit_length())
    refs = pack(first, wide)
    n1 = 22 + len(own) + len(marks)
    bits = np.concatenate([((p - f)[:, None] >> np.arange(w - 1, -1, -1) & 1).ravel() for p, f, w in zip(parts, first, widths, strict=True)])
    flags = {"rows": 0x10, "constant": 0x20, "general": 0x30}[kind]
    head = struct.pack(">HBHHHB", n1, flags, n1 + len(refs), len(parts), len(x) & 0xFFFF, 0)
    body = bds(0x50, e, r, wide, head + own + marks + refs + np.packbits(bits.astype(np.uint8)).tobytes())
    return message1(grid1(0, ni, nj, lat_first=90000, lat_last=-90000, lon_last=354375), body)


def _spectral2(t: int) -> bytes:
    return _section(3, struct.pack(">BIBBH", 0, 0, 0, 0, 50) + struct.pack(">III", t, t, t) + bytes([1, 1]))


def spectral2(t: int, mean: float, x: np.ndarray, r: float = -1.0, e: int = -10, bits: int = 12) -> bytes:
    """5.50: the mean apart, then the packed pairs."""
    return message2(_spectral2(t), product2(0), 50, red(r, e, 0, bits) + struct.pack(">f", mean), pack(x, bits), len(x) + 2)


def spectral_scaled2(t: int, sub: int, inner: np.ndarray, x: np.ndarray, power: float, r: float = -1.0, e: int = -10, bits: int = 12) -> bytes:
    """5.51: the pairs of the sub-truncation as IEEE numbers, the rest packed after scaling by (n (n + 1)) ** power."""
    drs = red(r, e, 0, bits) + _sm(round(power * 1e6), 4) + struct.pack(">HHH", sub, sub, sub) + struct.pack(">I", len(inner)) + bytes([1])
    return message2(_spectral2(t), product2(0), 51, drs, np.asarray(inner, ">f4").tobytes() + pack(x, bits), len(inner) + len(x))


def spectral1(t: int, mean: float, x: np.ndarray, r: float = -1.0, e: int = -10, bits: int = 12) -> bytes:
    """Edition 1, spherical harmonics with simple packing."""
    gds = (32).to_bytes(3, "big") + bytes([0, 255, 50]) + struct.pack(">HHHBB", t, t, t, 1, 1) + bytes(18)
    return message1(gds, bds(0x80, e, r, bits, ibm_bytes(mean) + pack(x, bits)))


# ---- entropy coder -----------------------------------------------------------------------


def entropy_coded(x: np.ndarray, bits: int, block: int, rsi: int) -> bytes:
    """CCSDS 121.0-B coding with preprocessing: each block by its shortest option, zero blocks in runs."""
    x = [int(v) for v in x] + [int(x[-1])] * (-len(x) % block)
    top, n_id = (1 << bits) - 1, 3 if bits <= 8 else 4 if bits <= 16 else 5
    out: list[str] = []
    unary = lambda v: "0" * v + "1"
    for a in range(0, len(x), block * rsi):
        own = x[a : a + block * rsi]
        mapped = []
        for before, now in zip(own, own[1:]):
            room, d = min(before, top - before), now - before
            mapped.append(2 * d if 0 <= d <= room else -2 * d - 1 if -room <= d < 0 else room + abs(d))
        blocks = [mapped[max(0, k - 1) : k + block - 1] for k in range(0, len(own), block)]
        k = 0
        while k < len(blocks):
            b = blocks[k]
            ref = format(own[0], f"0{bits}b") if k == 0 else ""
            run = 0
            while k + run < len(blocks) and (k + run) // 64 == k // 64 and not any(blocks[k + run]):
                run += 1
            if run:
                rest = min(len(blocks), 64 - k % 64 + k) - k
                length = 5 if run == rest and run >= 5 else run if run < 5 else run + 1
                out.append("0" * n_id + "0" + ref + unary(length - 1))
                k += run
                continue
            pairs = [0, *b] if k == 0 else b
            pairs = list(zip(pairs[::2], pairs[1::2], strict=True))
            ways = ["0" * n_id + "1" + ref + "".join(unary((p + q) * (p + q + 1) // 2 + q) for p, q in pairs)] if max(p + q for p, q in pairs) < 32 else []
            ways += [format(s + 1, f"0{n_id}b") + ref + "".join(unary(v >> s) for v in b) + "".join(format(v & ((1 << s) - 1), f"0{s}b") for v in b if s) for s in range(min(bits, (1 << n_id) - 2)) if max(b) >> s < 64]
            ways.append("1" * n_id + ref + "".join(format(v, f"0{bits}b") for v in b))
            out.append(min(ways, key=len))
            k += 1
    raw = "".join(out)
    return np.packbits(np.frombuffer(raw.encode(), np.uint8) - 48).tobytes()


def ccsds2(x: np.ndarray, ni: int, nj: int, bits: int = 12, block: int = 8, rsi: int = 4, r: float = -1.0, e: int = -10) -> bytes:
    """5.42 with preprocessing."""
    drs = red(r, e, 0, bits) + bytes([0, 8, block]) + struct.pack(">H", rsi)
    return message2(grid2(0, ni, nj, b"\x06", lat_first=90_000_000, lat_last=-90_000_000, lon_last=354_375_000), product2(0), 42, drs, entropy_coded(x, bits, block, rsi), len(x))
