"""Vectorised word splitting and hashing over UTF-8 bytes, one text at a time.

Words are runs of bytes other than U+0020 and U+0009-U+000D. A word's hash is a
polynomial over a random byte table, modulo 2**64, followed by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[i for i in range(128) if not chr(i).isalnum()]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, 256, dtype=U)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MULT = _rng.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per process, at most for BLOCK bytes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, U(base), U)
        have[0] = U(1)
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each text of an Arrow column, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, at, data = column.buffers()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if data is None:
        yield from (np.zeros(0, np.uint8) if v else None for v in valid)
        return
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)
    for v, s, e in zip(valid, ends[:-1], ends[1:], strict=True):
        yield raw[s:e] if v else None


def bounds(b: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end."""
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~separators[b]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(b: np.ndarray, lower: bool = False, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of all words of a text of any length."""
    starts, ends = bounds(b, separators)
    if not len(starts):
        return np.zeros(0, U), starts, ends
    hashes = np.empty(len(starts), U)
    lut = _LOWER if lower else _TABLE
    i = 0
    while i < len(starts):  # blocks of whole words bound the memory for long texts
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        base = int(starts[i])
        part = b[base : int(ends[j - 1])]
        total = np.empty(len(part) + 1, U)
        total[0] = 0
        np.cumsum(lut[part] * power(_BASE, len(part)), out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        hashes[i:j] = mix((total[e] - total[s]) * power(_INVERSE, len(part))[s] + (e - s).astype(U))
        i = j
    return hashes, starts, ends


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all n consecutive words."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out += h[k : k + len(out)] * _MULT[(k + seed) % 64]
    return mix(out + U(seed))


def long_grams(h: np.ndarray, n: int, base: int = _BASE, seed: int = 0) -> np.ndarray:
    """As grams, for large n: a rolling polynomial instead of n passes."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    h = mix(h + U(seed)) if seed else h
    out = np.empty(count, U)
    for a in range(0, count, BLOCK):
        part = h[a : a + BLOCK + n - 1]
        m = len(part) - n + 1
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * power(base, len(part)), out=total[1:])
        out[a : a + m] = mix((total[n:] - total[:-n]) * power(pow(base, -1, 2**64), m))
    return out


def runs(hit: np.ndarray, n: int, total: int) -> np.ndarray:
    """Positions (of total) covered by any of the windows of n that start where hit holds."""
    cover = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.subtract.at(cover, np.minimum(at + n, total), 1)
    return np.cumsum(cover[:-1]) > 0
