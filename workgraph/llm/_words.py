"""Words and word shingles of whole Arrow batches as 64-bit hashes, by numpy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased. Every doc's words are hashed over whole
texts; memory follows SLICE, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word is still hashed whole.
SLICE = 1 << 20
_rng = np.random.Generator(np.random.Philox(key=[20, 11]))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POSITION = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: multiply and shift, twice."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE * 2, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        if len(_powers) > 1:
            _powers.clear()
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, given as bytes."""
    out = []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        while end < n and not _IS_WHITE[data[end]]:  # on to the end of the word
            more = np.nonzero(_IS_WHITE[data[end : end + SLICE]])[0]
            end = end + int(more[0]) if len(more) else min(n, end + SLICE)
        out.append(_hash_slice(data[at:end]))
        at = end
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.uint64)


def _hash_slice(b: np.ndarray) -> np.ndarray:
    ink = ~_IS_WHITE[b]
    edge = np.diff(ink.astype(np.int8), prepend=0, append=0)
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[b]] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _POSITION[63])


def texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each text's bytes without copying; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(n):
        yield raw[at[i] : at[i + 1]] if valid[i] else None


def shingle_set(data: np.ndarray | None, wide: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of wide words; a shorter text is one shingle, a wordless one has none."""
    if data is None:
        return np.zeros(0, np.uint64)
    w = word_hashes(data)
    n = len(w)
    if n == 0:
        return w
    k = min(n, wide)
    s = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        s += w[j : n - k + 1 + j] * _POSITION[j]
    return np.unique(mix(s + np.uint64(k) * _POSITION[62]))
