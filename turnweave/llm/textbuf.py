"""Vectorised word splitting and hashing of Arrow text buffers.

Texts of a batch lie one behind the other in a single byte buffer; words and their 64-bit hashes come from a handful of
numpy passes over it, without a Python object for any text or word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
#: A random number for each byte value, and another for hashes that must not depend on the first's.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
OTHER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes that are hashed at a time.
CHUNK = 1 << 20


def separators(spec: str) -> np.ndarray:
    """A table of 256 flags: True for bytes that end a word; ``white``: the six white-space bytes, ``alnum``: all ASCII
    but digits and letters."""
    flags = np.zeros(256, bool)
    if spec == "white":
        flags[[0x20, *range(0x09, 0x0E)]] = True
    else:
        flags[:0x80] = True
        for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            flags[a : b + 1] = False
    return flags


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        if n > CHUNK + 1:  # only for a word longer than a chunk; not kept
            return powers(_BASE, n), powers(_INVERSE, n)
        _POWERS[n] = powers(_BASE, n), powers(_INVERSE, n)
    return _POWERS[n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a binary or string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``data``, and for each text the number of words before it (one more than texts).
    Words never cross texts."""
    inside = ~ends_word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = np.unique(edge[(edge > 0) & (edge < len(data))])
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hashes of the byte ranges, which ascend without overlap. Equal bytes give equal hashes anywhere."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        n = int(ends[j - 1] - low)
        up, down = _tables(max(CHUNK, n) + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers[data[low : low + n]] * up[:n], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def window_hashes(values: np.ndarray, width: int, at: np.ndarray | None = None, base: int = _BASE) -> np.ndarray:
    """Hash of ``values[p:p+width]`` for every p, or for the ascending positions ``at``."""
    at = np.arange(max(0, len(values) - width + 1)) if at is None else at
    out = np.empty(len(at), np.uint64)
    step = CHUNK // 4
    up, down = powers(base, step + width), powers(pow(base, -1, 2**64), step + width)
    for low in range(int(at[0]) if len(at) else 0, int(at[-1]) + 1 if len(at) else 0, step):
        i, j = np.searchsorted(at, [low, low + step])
        if i == j:
            continue
        part = values[low : low + step + width]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        p = at[i:j] - low
        out[i:j] = (sums[p + width] - sums[p]) * down[p]
    return mixed(out)
