"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on the raw UTF-8 buffers of an Arrow string column, so a
worker never builds one Python object per word.  Hashes are 64-bit; equality of
two hashes is taken as equality of the words, which for one pair of documents of
``n`` and ``m`` words errs with a probability of about ``n * m / 2**64``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        have = np.full(size, _B if kind == "up" else _BINV, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    base = int(offsets[0])
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[base : int(offsets[-1])], offsets - base


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of about ``limit`` bytes, at least one row each."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def regroup(it: Iterator[pa.RecordBatch], limit: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``limit`` bytes, but for the last."""
    held, size = [], 0
    for batch in it:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of the maximal runs of bytes that aren't separators."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    word = ~is_sep[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = word[first]
    end[last] = word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[starts[i]:ends[i]] for each i, by one prefix sum."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow("up", n)[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _pow("down", n)[np.minimum(starts, n - 1)] if n else np.zeros(len(starts), np.uint64)
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


_C = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct k-word shingles of each row, sorted by hash within the row.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space; a row of fewer
    than k words, but not none, has its whole word sequence as its one shingle.
    """
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = span_hashes(data, starts, ends)
    count = np.diff(first)
    grams = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        grams += words[j : len(words) - k + 1 + j] * _C[j % len(_C)] + np.uint64(j) if len(grams) else np.uint64(0)
    rows = np.repeat(np.arange(len(count)), count)
    if len(grams):
        whole = rows[: len(grams)] == rows[k - 1 :]
        grams, owner = mix(grams[whole]), rows[: len(whole)][whole]
    else:
        owner = np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = np.full(len(short), 0, np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            h[has] += words[first[short[has]] + j] * _C[j % len(_C)] + np.uint64(j)
        h = mix(mix(h) + count[short].astype(np.uint64))
        grams, owner = np.concatenate([grams, h]), np.concatenate([owner, short])
    order = np.argsort(grams)
    order = order[np.argsort(owner[order], kind="stable")]
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[keep], owner[keep]
    return grams, np.searchsorted(owner, np.arange(len(count) + 1))
