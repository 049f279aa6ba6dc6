"""Vectorised words and word hashes over Arrow batches of text, without a Python object per word.

A word is a maximal run of bytes of the UTF-8 text that are not ASCII white space (space, ``\\t \\n
\\r \\v \\f``). Its hash is a polynomial in B modulo 2**64 over one random value per byte, finished
with a mixer, so it is computed from one cumulative sum over the batch. With ``fold=True`` ASCII
letters count without case and ASCII punctuation counts as nothing, so ``The,`` and ``the`` agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are summed at a time: a worker keeps two numbers of 8 bytes for each of them.
_WINDOW = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of MurmurHash3, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    if fold:
        lower, upper = np.arange(97, 123), np.arange(65, 91)
        values[upper] = values[lower]
        values[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i in 0..n, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, _WINDOW + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(size, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes in ``buf``) and document of each word; document d is buf[offsets[d]:offsets[d + 1]]."""
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    black = (buf - np.uint8(9) > 4) & (buf != 32)  # SPACE, by comparisons
    first = black.copy()
    first[1:] &= ~black[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = black[cuts]
    last = black.copy()
    last[:-1] &= ~black[1:]
    before = cuts[cuts > 0] - 1
    last[before] = black[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """uint64 hash of each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = _VALUES[fold]
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _WINDOW, side="right")))
        stop = ends[j - 1]
        power, inverse = _powers(int(stop - base))
        sums = np.zeros(stop - base + 1, dtype=np.uint64)
        np.cumsum(values[buf[base:stop]] * power[: stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries (entry i: hashes[i:i + k])."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + len(out)]
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most ``most`` bytes of text, or one row."""
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An int64 column; nulls come back as 0, see ``column(...).is_valid()``."""
    return column(batch, name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
