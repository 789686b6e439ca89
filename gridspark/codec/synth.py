"""Writers of small GRIB and NetCDF files, for tests and round-trip queries."""

from __future__ import annotations

import struct

import numpy as np

from .bits import ibm_bytes, pack


def _sm(v: int, n: int) -> bytes:
    return (abs(v) | (1 << (8 * n - 1) if v < 0 else 0)).to_bytes(n, "big")


def _section(number: int, body: bytes) -> bytes:
    return struct.pack(">IB", len(body) + 5, number) + body


def latlon2(ni: int, nj: int, la1=90.0, lo1=0.0, la2=-90.0, lo2=354.375, scan: int = 0) -> bytes:
    """Payload of grid template 3.0."""
    deg = lambda v: _sm(round(v * 1e6), 4)
    return bytes([6]) + b"\0" * 15 + struct.pack(">II", ni, nj) + b"\0" * 8 + deg(la1) + struct.pack(">I", round(lo1 * 1e6)) + bytes([48]) + deg(la2) + struct.pack(">I", round(lo2 * 1e6)) + struct.pack(">II", round(abs(lo2 - lo1) / max(ni - 1, 1) * 1e6), round(abs(la2 - la1) / max(nj - 1, 1) * 1e6)) + bytes([scan])


def grib2(ni: int, nj: int, template: int, drs: bytes, body: bytes, bitmap=None, n_values: int | None = None, grid: bytes | None = None, grid_template: int = 0, category: int = 0, number: int = 0) -> bytes:
    s1 = struct.pack(">HHBBB", 98, 0, 30, 0, 1) + struct.pack(">HBBBBB", 2024, 3, 14, 15, 9, 26) + bytes([0, 1])
    s3 = bytes([0]) + struct.pack(">I", ni * nj) + bytes([0, 0]) + struct.pack(">H", grid_template) + (grid or latlon2(ni, nj))
    s4 = struct.pack(">HH", 0, 0) + bytes([category, number, 2, 0, 96]) + b"\0\0\0" + bytes([1]) + struct.pack(">I", 6) + bytes([100, 0]) + struct.pack(">I", 50000) + bytes([255, 255]) + b"\xff" * 4
    s5 = struct.pack(">IH", ni * nj if n_values is None else n_values, template) + drs
    s6 = b"\xff" if bitmap is None else b"\0" + pack(np.asarray(bitmap), 1)
    secs = _section(1, s1) + _section(3, s3) + _section(4, s4) + _section(5, s5) + _section(6, s6) + _section(7, body)
    return b"GRIB\0\0" + bytes([0, 2]) + struct.pack(">Q", 16 + len(secs) + 4) + secs + b"7777"


def red(r: float, e: int, d: int, bits: int) -> bytes:
    return struct.pack(">f", r) + _sm(e, 2) + _sm(d, 2) + bytes([bits])


def simple2(x: np.ndarray, ni: int, nj: int, r: float = -1.0, e: int = -10, d: int = 0, bits: int = 12, bitmap=None) -> bytes:
    return grib2(ni, nj, 0, red(r, e, d, bits) + b"\0", pack(x, bits), bitmap, len(x))


def ieee2(v: np.ndarray, ni: int, nj: int, double: bool = False) -> bytes:
    """5.4: values as they are."""
    return grib2(ni, nj, 4, bytes([2 if double else 1]), np.asarray(v, ">f8" if double else ">f4").tobytes(), None, len(v))


def log2(v: np.ndarray, ni: int, nj: int, offset: float = 2.0, e: int = -28, bits: int = 30) -> bytes:
    """5.61: the logarithm of the values, moved above zero by an offset."""
    w = np.log(np.asarray(v, np.float64) + np.float64(np.float32(offset)))
    r = np.float64(np.float32(w.min() - 1e-6))
    x = np.floor((w - r) / 2.0**e + 0.5).astype(np.int64)
    return grib2(ni, nj, 61, red(float(r), e, 0, bits) + struct.pack(">f", offset), pack(x, bits), None, len(x))


def png2(x: np.ndarray, ni: int, nj: int, r: float = -1.0, e: int = -10, bits: int = 16) -> bytes:
    """5.41: the packed integers as a gray picture."""
    from . import png

    gray = np.asarray(x, ">u2").reshape(nj, ni).view(np.uint8)
    return grib2(ni, nj, 41, red(r, e, 0, bits) + b"\0", png.encode(gray, bits, 0), None, ni * nj)


def alternate2(x: np.ndarray, ni: int, nj: int, r: float = -1.0, e: int = -10, bits: int = 12) -> bytes:
    """Simple packing with every odd row stored backwards (scan flag 0x10)."""
    g = np.asarray(x).reshape(nj, ni).copy()
    g[1::2] = g[1::2, ::-1]
    return grib2(ni, nj, 0, red(r, e, 0, bits) + b"\0", pack(g.ravel(), bits), None, ni * nj, latlon2(ni, nj, scan=0x10))


def complex2(x: np.ndarray, ni: int, nj: int, order: int = 0, size: int = 16, r: float = -1.0, e: int = -10, d: int = 0) -> bytes:
    """Complex packing in groups of ``size`` (5.2) or with spatial differencing of order 1 or 2 (5.3)."""
    x = np.asarray(x, np.int64)
    head = b""
    if order:
        diff = np.diff(x, n=order)
        low = int(diff.min()) if len(diff) else 0
        own = np.r_[np.zeros(order, np.int64), diff - low]
        head = b"".join(int(v).to_bytes(4, "big") for v in x[:order]) + _sm(low, 4)
    else:
        own = x
    parts = [own[i : i + size] for i in range(0, len(own), size)]
    refs = [int(p.min()) for p in parts]
    widths = [int(p.max() - p.min()).bit_length() for p in parts]
    bits = max(1, max(refs).bit_length())
    body = head + pack(refs, bits) + pack(widths, 6) + pack([0] * len(parts), 1) + _pack_runs([p - q for p, q in zip(parts, refs, strict=True)], widths)
    drs = red(r, e, d, bits) + bytes([0, 1, 0]) + b"\0" * 8 + struct.pack(">I", len(parts)) + bytes([0, 6]) + struct.pack(">I", size) + bytes([1]) + struct.pack(">I", len(parts[-1])) + bytes([1])
    return grib2(ni, nj, 3 if order else 2, drs + (bytes([order, 4]) if order else b""), body, None, len(x))


def _pack_runs(parts, widths) -> bytes:
    bits = []
    for p, w in zip(parts, widths, strict=True):
        if w:
            v = np.asarray(p, np.uint64)
            bits.append(((v[:, None] >> np.arange(w - 1, -1, -1, dtype=np.uint64)).astype(np.uint8) & 1).ravel())
    return np.packbits(np.concatenate(bits)).tobytes() if bits else b""


def second_order2(x: np.ndarray, ni: int, nj: int, order: int = 1, size: int = 16, r: float = -1.0, e: int = -10, d: int = 0, turned: bool = False) -> bytes:
    """5.50001, or 5.50002 with every odd row stored backwards."""
    x = np.asarray(x, np.int64)
    if turned:
        g = x.reshape(nj, ni).copy()
        g[1::2] = g[1::2, ::-1]
        x = g.ravel()
    diff = np.diff(x, n=order) if order else x
    low = int(diff.min()) if order else 0
    own = diff - low
    parts = [own[i : i + size] for i in range(0, len(own), size)]
    first, widths = [int(p.min()) for p in parts], [int(p.max() - p.min()).bit_length() for p in parts]
    w1 = max(1, max(first).bit_length())
    body = pack(widths, 6) + pack([len(p) for p in parts], 8) + pack(first, w1) + _pack_runs([p - q for p, q in zip(parts, first, strict=True)], widths)
    drs = red(r, e, d, 12) + bytes([w1]) + struct.pack(">II", len(parts), len(own)) + bytes([6, 8]) + (bytes([0x80]) if turned else b"") + bytes([order])
    if order:
        seeds = [int(v) for v in x[:order]]
        drs += bytes([24]) + pack([*seeds, abs(low) | (1 << 23 if low < 0 else 0)], 24)
    return grib2(ni, nj, 50002 if turned else 50001, drs, body, None, len(x))


def run_length2(levels: np.ndarray, ni: int, nj: int, bits: int = 4, table=(10, 20, 30)) -> bytes:
    top, base = len(table), (1 << bits) - 1 - len(table)
    codes, k = [], 0
    levels = np.asarray(levels)
    while k < len(levels):
        n = 1
        while k + n < len(levels) and levels[k + n] == levels[k]:
            n += 1
        codes.append(int(levels[k]))
        rest = n - 1
        while rest:
            codes.append(rest % base + top + 1)
            rest //= base
        k += n
    drs = bytes([bits]) + struct.pack(">HH", top, top) + _sm(1, 1) + b"".join(struct.pack(">H", t) for t in table)
    return grib2(ni, nj, 200, drs, pack(codes, bits), None, len(levels))


def grib1(ni: int, nj: int, bds: bytes, decimal: int = 0, bitmap=None, parameter: int = 11, level: tuple = (100, 1, 244), la=(90.0, -90.0), lo=(0.0, 354.375)) -> bytes:
    deg = lambda v: _sm(round(v * 1e3), 3)
    pds = bytes([0, 0, 28, 3, 98, 130, 255, 0x80 | (0x40 if bitmap is not None else 0), parameter, *level, 24, 3, 14, 15, 9, 1, 6, 0, 0, 0, 0, 0, 21, 0]) + _sm(decimal, 2)
    gds = bytes([0, 0, 32, 0, 255, 0]) + struct.pack(">HH", ni, nj) + deg(la[0]) + deg(lo[0]) + bytes([128]) + deg(la[1]) + deg(lo[1]) + struct.pack(">HH", min(65535, round(abs(lo[1] - lo[0]) / max(ni - 1, 1) * 1e3)), min(65535, round(abs(la[1] - la[0]) / max(nj - 1, 1) * 1e3))) + bytes([0]) + b"\0" * 4
    bms = b""
    if bitmap is not None:
        body = pack(np.asarray(bitmap), 1)
        bms = (6 + len(body)).to_bytes(3, "big") + bytes([8 * len(body) - len(bitmap), 0, 0]) + body
    out = pds + gds + bms + bds
    return b"GRIB" + (8 + len(out) + 4).to_bytes(3, "big") + bytes([1]) + out + b"7777"


def bds(flag: int, e: int, r: float, bits: int, rest: bytes) -> bytes:
    return (11 + len(rest)).to_bytes(3, "big") + bytes([flag]) + _sm(e, 2) + ibm_bytes(r) + bytes([bits]) + rest


def simple1(x, ni: int, nj: int, r: float = -1.0, e: int = -10, d: int = 0, bits: int = 12, bitmap=None) -> bytes:
    return grib1(ni, nj, bds(0, e, r, bits, pack(x, bits)), d, bitmap)


def ieee1(v, ni: int, nj: int) -> bytes:
    """Edition 1 values as 32-bit IEEE numbers (flags 0x30)."""
    return grib1(ni, nj, bds(0x30, 0, 0.0, 32, np.asarray(v, ">f4").tobytes()))


def second_order1(x, ni: int, nj: int, order: int = 1, size: int = 16, r: float = -1.0, e: int = -10, d: int = 0) -> bytes:
    """General extended second-order packing with spatial differencing of order 0 to 3."""
    x = np.asarray(x, np.int64)
    diff = np.diff(x, n=order) if order else x
    low = int(diff.min()) if order else 0
    own = diff - low
    parts = [own[i : i + size] for i in range(0, len(own), size)]
    first, widths = [int(p.min()) for p in parts], [int(p.max() - p.min()).bit_length() for p in parts]
    w1 = max(1, max(first).bit_length())
    spd = bytes([24]) + pack([*(int(v) for v in x[:order]), abs(low) | (1 << 23 if low < 0 else 0)], 24) if order else b""
    groups = pack(widths, 6) + pack([len(p) for p in parts], 8)
    n1 = 25 + len(spd) + len(groups)
    refs = pack(first, w1)
    n2 = n1 + len(refs)
    flags = 0x08 | (order & 1) | (order >> 1 & 1) << 1
    head = struct.pack(">H", n1 + 1) + bytes([flags]) + struct.pack(">HHH", n2 + 1, len(parts) & 0xFFFF, len(own) & 0xFFFF) + bytes([len(parts) >> 16, 6, 8]) + b"\0\0"
    return grib1(ni, nj, bds(0x50, e, r, w1, head + spd + groups + refs + _pack_runs([p - q for p, q in zip(parts, first, strict=True)], widths)), d)


def netcdf3(dims: dict, variables: dict, attrs: dict | None = None, version: int = 1) -> bytes:
    """variables: name -> (dims, array, attrs); a dimension of length 0 is the record dimension."""
    from .netcdf3 import TYPES

    kinds = {np.dtype(f).newbyteorder("=").str[1:]: (k, f) for k, (_, f) in TYPES.items() if k != 2}
    w = 8 if version == 5 else 4
    num = lambda v: int(v).to_bytes(w, "big")
    pad = lambda b: b + b"\0" * (-len(b) % 4) if len(b) % 4 else b
    name = lambda s: num(len(s.encode())) + pad(s.encode())

    def atts(a: dict) -> bytes:
        if not a:
            return b"\0" * 4 + num(0)
        out = (0x0C).to_bytes(4, "big") + num(len(a))
        for k, v in a.items():
            if isinstance(v, str):
                out += name(k) + (2).to_bytes(4, "big") + num(len(v)) + pad(v.encode())
            else:
                v = np.atleast_1d(v)
                kind, form = kinds[v.dtype.newbyteorder("=").str[1:]]
                out += name(k) + kind.to_bytes(4, "big") + num(len(v)) + pad(v.astype(form).tobytes())
        return out

    records = [v for v in variables.values() if v[0] and dims[v[0][0]] == 0]
    nrec = max((len(v[1]) for v in records), default=0)
    head = b"CDF" + bytes([version]) + num(nrec)
    head += (0x0A).to_bytes(4, "big") + num(len(dims)) + b"".join(name(k) + num(n) for k, n in dims.items())
    head += atts(attrs or {})
    ids = {k: i for i, k in enumerate(dims)}

    def table(begins: dict) -> bytes:
        out = (0x0B).to_bytes(4, "big") + num(len(variables))
        for k, (dn, arr, at) in variables.items():
            kind, form = kinds[arr.dtype.newbyteorder("=").str[1:]]
            rec = bool(dn) and dims[dn[0]] == 0
            size = -(-int(np.prod(arr.shape[1:] if rec else arr.shape)) * arr.dtype.itemsize // 4) * 4
            out += name(k) + num(len(dn)) + b"".join(num(ids[d]) for d in dn) + atts(at) + kind.to_bytes(4, "big") + num(size) + begins.get(k, 0).to_bytes(4 if version == 1 else 8, "big")
        return out

    at = len(head) + len(table({}))
    begins, body, size = {}, [], 0
    for k, (dn, arr, _) in variables.items():
        if not (dn and dims[dn[0]] == 0):
            begins[k] = at + size
            body.append(pad(arr.astype(kinds[arr.dtype.newbyteorder("=").str[1:]][1], copy=False).tobytes()))
            size += len(body[-1])
    recs = [(k, v[1]) for k, v in variables.items() if v[0] and dims[v[0][0]] == 0]
    base = at + size
    slab = lambda a, r: a[r : r + 1].astype(kinds[a.dtype.newbyteorder("=").str[1:]][1]).tobytes()
    off = 0
    for k, a in recs:
        begins[k] = base + off
        off += -(-a[0].size * a.dtype.itemsize // 4) * 4
    for r in range(nrec):
        for _, a in recs:
            body.append(slab(a, r) if len(recs) == 1 else pad(slab(a, r)))
    return b"".join([head, table(begins), *body])


def extensible_array(put, elements: dict[int, bytes], esize: int, direct: int = 2, least: int = 2, pointers: int = 2, page_bits: int = 2, bits: int = 32) -> tuple[bytes, int]:
    """(parameters as a layout tells them, address of the header) of an index that holds these elements.

    Blocks and pages without an element are not stored.
    """
    u = lambda v, n: int(v).to_bytes(n, "little")
    none, page, wide = b"\xff" * esize, 1 << page_bits, -(-bits // 8)
    take = lambda a, n: b"".join(elements.get(i, none) for i in range(a, a + n))
    held = lambda a, n: any(i in elements for i in range(a, a + n))
    head = b"\0\0" + u(0, 8)
    last, first, pairs, supers = max(elements, default=-1) + 1, direct, b"", b""
    inner = {1: 0, 2: 2, 4: 4}[pointers]
    level = 0
    while level < inner or first < last:
        count, n = 2 ** (level // 2), least * 2 ** ((level + 1) // 2)
        paged = level >= inner and n > page
        addresses, marks = b"", ""
        for a in range(first, first + count * n, n):
            body = take(a, n) + u(0, 4)
            if paged:
                body = u(0, 4) + b"".join(take(b, page) + u(0, 4) if held(b, page) else b"\x55" * (page * esize + 4) for b in range(a, a + n, page))
                marks += "".join(str(int(held(b, page))) for b in range(a, a + n, page))
            addresses += u(put(b"EADB" + head + u(a - direct, wide) + body), 8) if held(a, n) else b"\xff" * 8
        if level < inner:
            pairs += addresses
        else:
            size = count * -(-(n // page) // 8) if paged else 0
            bitmap = int(marks.ljust(8 * size, "0"), 2).to_bytes(size, "big") if size else b""
            supers += u(put(b"EASB" + head + u(first - direct, wide) + bitmap + addresses + u(0, 4)), 8)
        first += count * n
        level += 1
    supers += b"\xff" * (8 * (1 + bits - (least.bit_length() - 1) - level))
    index = put(b"EAIB" + head + take(0, direct) + pairs + supers + u(0, 4))
    stats = u(0, 8) * 4 + u(last, 8) + u(last, 8)
    return bytes([bits, direct, pointers, least, page_bits]), put(b"EAHD\0\0" + bytes([esize, bits, direct, least, pointers, page_bits]) + stats + u(index, 8) + u(0, 4))


def hdf5(variables: dict, chunk: tuple | None = None, unlimited: int | None = None, skip: tuple = ()) -> bytes:
    """A NetCDF-4-like file: name -> (array, attrs); chunked with shuffle and deflate where ``chunk`` is given.

    With an ``unlimited`` dimension an extensible array indexes the chunks; those numbered in ``skip`` are not stored.
    """
    import zlib

    out = bytearray(b"\0" * 48)
    u = lambda v, n: int(v).to_bytes(n, "little")

    def put(b: bytes) -> int:
        at = len(out)
        out.extend(b + b"\0" * (-len(b) % 8))
        return at

    def dtype(a: np.dtype) -> bytes:
        size = a.itemsize
        if a.kind == "f":
            e, m = (8, 23) if size == 4 else (11, 52)
            return bytes([0x11, 0x20, size * 8 - 1, 0]) + u(size, 4) + u(0, 2) + u(8 * size, 2) + bytes([m, e, 0, m]) + u((1 << (e - 1)) - 1, 4)
        return bytes([0x10, 8 if a.kind == "i" else 0, 0, 0]) + u(size, 4) + u(0, 2) + u(8 * size, 2)

    space = lambda shape: bytes([1, len(shape), 0, 0, 0, 0, 0, 0]) + b"".join(u(s, 8) for s in shape)
    pad8 = lambda b: b + b"\0" * (-len(b) % 8)

    def attribute(k: str, v) -> bytes:
        if isinstance(v, str):
            raw = v.encode() + b"\0"
            t, s, body = bytes([0x13, 0, 0, 0]) + u(len(raw), 4), space(()), raw
        else:
            v = np.atleast_1d(v)
            t, s, body = dtype(v.dtype), space(v.shape), v.astype(v.dtype.newbyteorder("<")).tobytes()
        n = k.encode() + b"\0"
        return bytes([1, 0]) + u(len(n), 2) + u(len(t), 2) + u(len(s), 2) + pad8(n) + pad8(t) + pad8(s) + body

    def header(messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(u(k, 2) + u(len(pad8(b)), 2) + b"\0" * 4 + pad8(b) for k, b in messages)
        return put(bytes([1, 0]) + u(len(messages), 2) + u(1, 4) + u(len(body), 4) + b"\0" * 4 + body)

    links = []
    for name, (a, attrs) in variables.items():
        a = a.astype(a.dtype.newbyteorder("<"))
        msgs = [(1, space(a.shape)), (3, dtype(a.dtype))]
        if chunk and a.ndim == len(chunk):
            keys, elements = b"", {}
            grid = list(np.ndindex(*[-(-s // c) for s, c in zip(a.shape, chunk, strict=True)]))
            for g in grid:
                part = np.zeros(chunk, a.dtype)
                own = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(g, chunk, a.shape, strict=True))
                part[tuple(slice(0, s.stop - s.start) for s in own)] = a[own]
                raw = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, a.itemsize).T.tobytes())
                if unlimited is not None:
                    rest = [(i, -(-s // c)) for k, (i, s, c) in enumerate(zip(g, a.shape, chunk, strict=True)) if k != unlimited]
                    number = g[unlimited]
                    for i, n in rest:
                        number = number * n + i
                    if number not in skip:
                        elements[number] = u(put(raw), 8) + u(len(raw), 2) + u(0, 4)
                    continue
                keys += u(len(raw), 4) + u(0, 4) + b"".join(u(i * c, 8) for i, c in zip(g, chunk, strict=True)) + u(0, 8) + u(put(raw), 8)
            if unlimited is not None:
                most = [b"\xff" * 8 if k == unlimited else u(s, 8) for k, s in enumerate(a.shape)]
                msgs[0] = (1, bytes([1, a.ndim, 1]) + space(a.shape)[3:] + b"".join(most))
                told, at = extensible_array(put, elements, 14)
                index = bytes([4, 2, 0, a.ndim + 1, 4]) + b"".join(u(c, 4) for c in chunk) + u(a.itemsize, 4) + b"\x04" + told + u(at, 8)
            else:
                tree = put(b"TREE" + bytes([1, 0]) + u(len(grid), 2) + b"\xff" * 16 + keys)
                index = bytes([3, 2, a.ndim + 1]) + u(tree, 8) + b"".join(u(c, 4) for c in chunk) + u(a.itemsize, 4)
            msgs.append((8, index))
            msgs.append((11, bytes([1, 2]) + b"\0" * 6 + u(2, 2) + u(0, 2) + u(0, 2) + u(1, 2) + u(a.itemsize, 4) + b"\0" * 4 + u(1, 2) + u(0, 2) + u(0, 2) + u(1, 2) + u(4, 4) + b"\0" * 4))
        else:
            msgs.append((8, bytes([3, 1]) + u(put(a.tobytes()), 8) + u(a.nbytes, 8)))
        links.append((name, header(msgs + [(12, attribute(k, v)) for k, v in attrs.items()])))
    root = header([(6, bytes([1, 0]) + bytes([len(n.encode())]) + n.encode() + u(at, 8)) for n, at in links])
    out[:48] = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + u(0, 8) + b"\xff" * 8 + u(len(out), 8) + u(root, 8) + b"\0" * 4
    return bytes(out)
