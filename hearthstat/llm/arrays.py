"""Whole-batch text work on Arrow columns: slices of bytes, words and their hashes.

Texts stay UTF-8 bytes in one numpy array.  A word is a longest run of bytes other than
0x20 and 0x09-0x0D, which on UTF-8 is the same as on code points.  Hashes are polynomials
modulo 2**64 over random byte values, mixed afterwards, so a span of any length costs two
look-ups.  Memory is bounded by the slice size, or by one text where it is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTE_VALUES.copy()
_FOLDED[65:91] = _BYTE_VALUES[97:123]  # A-Z count as a-z
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def flat(column) -> pa.StringArray:
    """One string array in place of any Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def text_slices(column, max_bytes: int = SLICE_BYTES):
    """Yield (first row, offsets, bytes) of runs of rows; NULL is read as the empty text."""
    column = flat(column)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1024)
        out = np.ones(size, np.uint64)
        if size > 1:
            out[1:] = np.uint64(base)
            with np.errstate(over="ignore"):
                np.multiply.accumulate(out, out=out)
        known = out
        if size <= 2 * SLICE_BYTES:  # powers for longer texts are not held
            _powers[base] = out
    return known[:n]


def prefix_sums(data: np.ndarray, fold: bool) -> np.ndarray:
    """Running polynomial sums of bytes; ``fold`` lower-cases A-Z."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = (_FOLDED if fold else _BYTE_VALUES)[data]
    terms *= powers(_BASE, len(data))
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes: equal bytes give equal hashes wherever they lie."""
    return mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (n + 1 values)."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_STEP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, and for each row the index of its first window."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out += hashes[at + i] * np.uint64(_STEP[i] if i < len(_STEP) else pow(_BASE, i + 1, 1 << 64))
    return mixed(out), begins


def lists(values: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values, kind))


