"""Words of many texts at once: where they begin and end, and a 64-bit hash of each, by NumPy over the texts' bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import LOWER, UPPER

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


STRETCH = 1 << 16  #: bytes hashed at a time: what fits a core's cache
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)
_CODES = np.array([xxhash.xxh3_64_intdigest(bytes([b]).translate(LOWERED), 11) for b in range(256)], np.uint64)
BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


def hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end] for each word: a polynomial in the bytes' codes, from running sums, then mixed."""
    low, high, shift = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    total = np.uint64(0)
    for at in range(0, len(b), STRETCH):
        part = b[at : at + STRETCH]
        terms = _CODES[part]
        terms *= _POWERS[: len(part)]
        terms *= np.uint64(pow(_BASE, at, 1 << 64))
        sums = np.cumsum(terms, dtype=np.uint64)
        sums += total
        i, j = np.searchsorted(start, (at, at + len(part)))
        here = start[i:j] - at
        before = sums[here - 1]
        before[here == 0] = total
        low[i:j] = before
        shift[i:j] = _INVERSES[here] * np.uint64(pow(_INVERSE, at, 1 << 64))
        i, j = np.searchsorted(end, (at + 1, at + len(part) + 1))
        high[i:j] = sums[end[i:j] - at - 1]
        total = sums[-1]
    h = (high - low) * shift
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


#: What parts words of letters and digits: other ASCII. Non-ASCII characters are letters.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def cut(texts: pa.Array, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where texts begin, where words begin, where they end, whose words they are) for words parted by the bytes marked in `parts`."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    edge = np.zeros(len(b) + 1, bool)  # where a text begins
    edge[at] = True
    blank = parts[b]
    full = ~blank
    first, last = full.copy(), full.copy()
    first[1:] &= blank[:-1] | edge[1:-1]
    last[:-1] &= blank[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return b, at, start, end, between(at[1:-1], start)


def between(marks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the sorted `marks` are at or before each of the sorted `places`; marks are few beside places."""
    return np.repeat(np.arange(len(marks) + 1), np.diff(np.concatenate([[0], np.searchsorted(places, marks), [len(places)]])))


def runs(batches: Iterator[pa.RecordBatch], column: int, nbytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices that hold about `nbytes` in a text or binary column, one row at least."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        at = np.frombuffer(values.buffers()[1], np.int64 if large else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        start = 0
        while start < len(values):
            end = max(start + 1, int(np.searchsorted(at, at[start] + nbytes, side="right")) - 1)
            end = min(end, len(values))
            yield batch.slice(start, end - start)
            start = end
