"""NumPy kernels over byte buffers: words, hashes of windows, window minima.

All hashes are 64-bit polynomials over randomly chosen odd constants, finished with an
avalanche step; they depend on the bytes alone, so every task computes the same values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLOCK = 1 << 19
_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15
_B = 0xD1342543DE82EF95
_BINV = pow(_B, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser); a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_T = mix(np.arange(1, 257, dtype=np.uint64) * U(_R))
_T0 = np.where(WHITE, U(0), _T)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW = [_powers(_B, _BLOCK + 1), _powers(_BINV, _BLOCK + 1)]


def _power(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        _POW[:] = [_powers(_B, n), _powers(_BINV, n)]
    return _POW


def words(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of buf."""
    n = len(buf)
    starts, ends, hashes = [], [], []
    a = 0
    while a < n:
        b = min(a + _BLOCK, n)
        white = WHITE[buf[a:b]]
        if b < n and not WHITE[buf[b]]:
            cut = np.flatnonzero(white)
            if len(cut):
                b = a + int(cut[-1]) + 1
            else:  # a word longer than a block
                while b < n and not WHITE[buf[b]]:
                    more = np.flatnonzero(WHITE[buf[b : b + _BLOCK]])
                    b += int(more[0]) if len(more) else min(_BLOCK, n - b)
            white = WHITE[buf[a:b]]
        edge = np.flatnonzero(np.diff(white, prepend=True, append=True))
        s, e = edge[0::2], edge[1::2]
        part = LOWER[buf[a:b]] if lower else buf[a:b]
        pw, inv = _power(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_T0[part] * pw[: b - a], out=total[1:])
        h = (total[e] - total[s]) * inv[s]
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        a = b
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k elements, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, off, cur, size, left = None, 0, h, 1, k
    while left:
        if left & 1:
            part = cur[off : off + n]
            out = part.copy() if out is None else out + part * U(pow(_R, off, 1 << 64))
            off += size
        left >>= 1
        if left:
            cur = cur[:-size] + cur[size:] * U(pow(_R, size, 1 << 64))
            size *= 2
    return mix(out)


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _T[buf]


_SPAN = 1 << 21
_LOW = (1 << 24) - 1


def minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, the position of its smallest one (leftmost of ties)."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if width == 1:
        return np.arange(n)
    span = max(_SPAN, 4 * width)
    if span + width > _LOW:
        raise ValueError("window too wide")
    out = np.empty(n, np.int64)
    for a in range(0, n, span):
        m = min(span, n - a) + width - 1
        rows = -(-m // width)
        key = np.full(rows * width, U(_MASK))
        key[:m] = (g[a : a + m] & ~U(_LOW)) | np.arange(m, dtype=np.uint64)
        key = key.reshape(rows, width)
        fore = np.minimum.accumulate(key, axis=1).ravel()
        back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        k = m - width + 1
        out[a : a + k] = (np.minimum(back[:k], fore[width - 1 : width - 1 + k]) & U(_LOW)).astype(np.int64) + a
    return out


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n elements lie in a window of that length at one of the sorted starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.subtract.at(step, starts + length, 1)
    return np.cumsum(step[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def planes(x: np.ndarray) -> bytes:
    """The values' bytes, plane by plane: sorted or small values then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()
