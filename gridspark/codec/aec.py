"""Adaptive entropy coding (CCSDS 121.0-B) of unsigned samples."""

from __future__ import annotations

import numpy as np

from .bits import FormatError, bits_of

# Flag bits of the coder.
SIGNED, PREPROCESS, RESTRICTED = 1, 8, 16


def decode(data: bytes, count: int, bits: int, block: int, rsi: int, flags: int) -> np.ndarray:
    """``count`` samples of ``bits`` bits in blocks of ``block``, reference samples every ``rsi`` blocks."""
    if not 1 <= bits <= 32 or block not in (8, 16, 32, 64) or not 1 <= rsi <= 4096:
        raise FormatError("the parameters of the entropy coder are out of range")
    b = bits_of(data)
    ones = np.flatnonzero(b)
    n_id = (1 if bits <= 2 else 2) if flags & RESTRICTED and bits <= 4 else 3 if bits <= 8 else 4 if bits <= 16 else 5
    pre = bool(flags & PREPROCESS)
    out = np.zeros(count + block * rsi, np.int64)
    at = done = 0

    def number(n: int) -> int:
        nonlocal at
        if at + n > len(b):
            raise FormatError("entropy-coded data end too early")
        v = int(b[at : at + n] @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))) if n else 0
        at += n
        return v

    def unary(n: int) -> np.ndarray:
        """n fundamental sequences: zeros before each one."""
        nonlocal at
        k = int(np.searchsorted(ones, at))
        if k + n > len(ones):
            raise FormatError("entropy-coded data end too early")
        own = ones[k : k + n]
        v = np.diff(np.concatenate([[at - 1], own])) - 1
        at = int(own[-1]) + 1 if n else at
        return v

    last = (1 << n_id) - 1
    while done < count:
        in_rsi = 0
        start = done
        while in_rsi < rsi and done < count:
            ref = pre and in_rsi == 0
            option = number(n_id)
            n = block - ref
            if option == 0:
                second = number(1)
                if ref:
                    out[done] = number(bits)
                if second:  # pairs of samples in one code
                    pos = ref
                    while pos < block:
                        m = int(unary(1)[0])
                        beta = int((np.sqrt(8 * m + 1) - 1) // 2)
                        while (beta + 1) * (beta + 2) // 2 <= m:
                            beta += 1
                        y = m - beta * (beta + 1) // 2
                        if pos % 2 == 0:
                            out[done + pos] = beta - y
                            pos += 1
                        out[done + pos] = y
                        pos += 1
                    blocks = 1
                else:
                    z = int(unary(1)[0]) + 1
                    if z == 5:  # the rest of the segment of 64 blocks
                        blocks = min(rsi - in_rsi, 64 - in_rsi % 64)
                    else:
                        blocks = z - 1 if z > 5 else z
                    blocks = max(1, min(blocks, rsi - in_rsi))
            elif option == last:
                for k in range(block):
                    out[done + k] = number(bits)
                blocks = 1
            else:
                if ref:
                    out[done] = number(bits)
                k = option - 1
                high = unary(n)
                if at + n * k > len(b):
                    raise FormatError("entropy-coded data end too early")
                low = b[at : at + n * k].reshape(n, k) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
                at += n * k
                out[done + ref : done + block] = (high << k) + low
                blocks = 1
            done += blocks * block
            in_rsi += blocks
        if pre:
            _unmap(out, start, min(done, len(out)), bits, bool(flags & SIGNED))
    return out[:count]


def _unmap(x: np.ndarray, start: int, stop: int, bits: int, is_signed: bool) -> None:
    """Mapped prediction errors of one reference interval back to samples, in place."""
    lo, hi = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if is_signed else (0, (1 << bits) - 1)
    v = int(x[start])
    if is_signed and v > hi:
        v -= 1 << bits
    x[start] = v
    own = x[start + 1 : stop].tolist()
    for k, d in enumerate(own):
        theta = min(v - lo, hi - v)
        if d <= 2 * theta:
            v += d // 2 if d % 2 == 0 else -(d + 1) // 2
        elif theta == v - lo:
            v = lo + d
        else:
            v = hi - d
        own[k] = v
    x[start + 1 : stop] = own
