"""Bit-level numbers of packed fields, vectorised over a section."""

from __future__ import annotations

import numpy as np


class FormatError(ValueError):
    """The bytes contradict themselves or the format."""


class Unsupported(FormatError):
    """A well-formed part that this engine does not decode."""


def bits_of(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))


SLAB = 1 << 16  # numbers that are unpacked at a time


def at_offsets(data: np.ndarray, offsets: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Unsigned big-endian numbers of ``widths`` bits (0..32) at rising bit ``offsets`` of octets, SLAB numbers at a time."""
    offsets, widths = np.asarray(offsets, np.int64), np.broadcast_to(np.asarray(widths, np.int64), np.shape(offsets))
    if len(offsets) and int((offsets + widths).max()) > 8 * len(data):
        raise FormatError("a packed section ends before its numbers do")
    if len(widths) and widths.max() > 32:
        raise FormatError("a packed number is wider than 32 bits")
    out = np.zeros(len(offsets), np.int64)
    for k in range(0, len(offsets), SLAB):
        at, each = offsets[k : k + SLAB], widths[k : k + SLAB]
        low = int(at.min()) // 8
        bits = np.unpackbits(data[low : -(-int((at + each).max()) // 8)])
        for w in np.unique(each).tolist():
            if w:
                own = np.flatnonzero(each == w)
                b = bits[(at[own] - 8 * low)[:, None] + np.arange(w)]
                out[k + own] = b @ (1 << np.arange(w - 1, -1, -1, dtype=np.int64))
    return out


class Stream:
    """Reads runs of equal-width numbers one after another."""

    def __init__(self, data: bytes, byte: int = 0):
        self.data, self.at = np.frombuffer(data, np.uint8), 8 * byte

    def take(self, n: int, width: int) -> np.ndarray:
        n, width = int(n), int(width)
        if n and self.at + width * n > 8 * len(self.data):
            raise FormatError("a packed section ends before its numbers do")
        if n and width > 32:
            raise FormatError("a packed number is wider than 32 bits")
        out = np.zeros(n, np.int64)
        for k in range(0, n if width else 0, SLAB):
            m, at = min(SLAB, n - k), self.at + width * k
            bits = np.unpackbits(self.data[at // 8 : -(-(at + width * m) // 8)])[at % 8 :][: width * m]
            out[k : k + m] = bits.reshape(m, width) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        self.at += width * n
        return out

    def take_runs(self, lengths: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Numbers of consecutive groups, each of its own length and width."""
        w = np.repeat(widths, lengths)
        off = self.at + np.cumsum(w) - w
        self.at += int(w.sum())
        return at_offsets(self.data, off, w)

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def sign_magnitude(v: int, width: int) -> int:
    top = 1 << (width - 1)
    return -(v & (top - 1)) if v & top else v


def unsigned(data: bytes, at: int, n: int) -> int:
    if at + n > len(data):
        raise FormatError("a section is too short")
    return int.from_bytes(data[at : at + n], "big")


def signed(data: bytes, at: int, n: int) -> int:
    return sign_magnitude(unsigned(data, at, n), 8 * n)


def ibm_float(raw: int) -> float:
    """IBM single precision: base 16, excess 64."""
    m = (raw & 0xFFFFFF) / (1 << 24) * 16.0 ** ((raw >> 24 & 0x7F) - 64)
    return -m if raw >> 31 else m


def ibm_bytes(v: float) -> bytes:
    if not v:
        return bytes(4)
    s, v, e = (0x80 if v < 0 else 0), abs(v), 64
    while v >= 1:
        v, e = v / 16, e + 1
    while v < 1 / 16:
        v, e = v * 16, e - 1
    m = round(v * (1 << 24))
    return ((s | e) << 24 | m).to_bytes(4, "big")


def pack(values, width: int) -> bytes:
    """Numbers of one width, padded to an octet."""
    v = np.asarray(values, np.uint64)
    b = (v[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(b.ravel()).tobytes() if width else b""


def undo_differences(x: np.ndarray, order: int, bias: int) -> np.ndarray:
    """Spatial differences of order 0 to 3; x begins with ``order`` seeds."""
    if order not in (0, 1, 2, 3):
        raise FormatError("spatial differencing has order 0 to 3")
    if order == 0:
        return x
    d = x.astype(np.int64).copy()
    d[order:] += bias
    head = d[:order].copy()
    for k in range(order):  # seeds to the differences that running sums turn back into them
        d[k] = np.diff(head[: k + 1], n=k)[0] if k else head[0]
    if order >= 2 and len(d) > 1:
        d[1] = head[1] - 2 * head[0]
    if order == 3 and len(d) > 2:
        d[1], d[2] = head[1] - 3 * head[0], head[2] - 3 * head[1] + 3 * head[0]
    for _ in range(order):
        d = np.cumsum(d)
    return d


def place(values: np.ndarray, bitmap: np.ndarray | None, count: int) -> np.ndarray:
    """Masked values at the set bits of a bitmap; a masked array of ``count`` points."""
    v = np.ma.masked_array(values)
    if bitmap is None:
        if len(v) != count:
            raise FormatError(f"{len(v)} values decoded, {count} needed")
        return v
    if len(bitmap) != count:
        raise FormatError("the bitmap has another length than the grid")
    if int(bitmap.sum()) != len(v):
        raise FormatError("the bitmap needs another number of values")
    out = np.ma.masked_all(count, np.float64)
    out[bitmap.astype(bool)] = v
    return out


def rows_turned(v: np.ndarray, ni: int) -> np.ndarray:
    """Every odd row reversed."""
    g = v.reshape(-1, ni).copy()
    g[1::2] = g[1::2, ::-1]
    return g.ravel()
