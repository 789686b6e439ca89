"""The part of PNG that packed fields use: one non-interlaced greyscale or RGB(A) image, both ways."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .bits import FormatError, Unsupported

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(samples as bytes of rows, bits per pixel)."""
    if data[:8] != MAGIC:
        raise FormatError("not a PNG stream")
    at, idat, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[3] not in CHANNELS:
        raise Unsupported("this kind of PNG image is not used for fields")
    w, h, depth, colour, _, _, interlace = head
    if interlace:
        raise Unsupported("interlaced PNG images are not used for fields")
    per = depth * CHANNELS[colour]
    stride, step = -(-w * per // 8), max(1, per // 8)
    raw = np.frombuffer(zlib.decompress(idat), np.uint8)
    if len(raw) < h * (stride + 1):
        raise FormatError("a PNG image ends too early")
    rows = raw[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for y in range(h):
        kind, row = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 2:
            row = row + above
        elif kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step])
        elif kind in (3, 4):
            line, up = row.tolist(), above.tolist()
            for x in range(stride):
                a, c = (line[x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    line[x] = (line[x] + (a + up[x]) // 2) & 255
                else:
                    p = a + up[x] - c
                    pa, pb, pc = abs(p - a), abs(p - up[x]), abs(p - c)
                    line[x] = (line[x] + (a if pa <= pb and pa <= pc else up[x] if pb <= pc else c)) & 255
            row = np.array(line)
        elif kind:
            raise FormatError(f"unknown PNG filter {kind}")
        above = row & 255
        out[y] = above
    return out, per


def encode(rows: np.ndarray, depth: int, colour: int = 0) -> bytes:
    """A PNG file of rows of bytes (unfiltered)."""
    h, stride = rows.shape
    w = stride * 8 // (depth * CHANNELS[colour])
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows.astype(np.uint8)], 1).tobytes()
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
