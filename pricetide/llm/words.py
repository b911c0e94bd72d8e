"""Numpy helpers over Arrow string batches: words, their hashes, and hashes of runs of words.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Nulls count as empty texts.  All work is on flat arrays, in slices of bounded bytes, so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1B54A32D192ED03))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text comes alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts in them (with the end)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the number of the first word of each text (with the end)."""
    inside = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes in every task."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the number of each text's first word (with the end)."""
    data, off = flat(column)
    start, end, first = spans(data, off)
    return hashes(data, start, end), first


def runs(words: np.ndarray, k: int, salt: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A hash of the k words from each position (positions too near the end hold runs that are cut off; callers mask them)."""
    out = np.zeros(len(words), np.uint64)
    block, size, done = words.copy(), 1, 0
    while size <= k:
        if k & size:
            shifted = np.zeros_like(out)
            if done < len(words):
                shifted[: len(words) - done] = block[done:]
            out += shifted * U(pow(salt | 1, done, 1 << 64))
            done += size
        nxt = block.copy()
        if size < len(words):
            nxt[: len(words) - size] += block[size:] * U(pow(salt | 1, size, 1 << 64))
        block, size = nxt, size * 2
    return mix(out + U(k))


def positions(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
