"""Vectorised access to the texts of an Arrow batch.

Every text operator works on *slices*: consecutive rows whose UTF-8 bytes lie
in one flat ``uint8`` array with row offsets.  A slice holds at most
``SLICE_BYTES`` bytes (a longer single text is a slice of its own), which
bounds a task's memory whatever the batch size.  Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first n bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and row offsets (length rows + 1, starting at 0) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0]: off[-1]], off - off[0]


def cuts(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for each slice of the batches."""
    for batch in batches:
        data, off = utf8(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in cuts(off):
            yield batch.slice(lo, hi - lo), data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]


def per_slice(fn: Callable[[np.ndarray, np.ndarray], list], ids: str, text: str, schema: pa.Schema):
    """A ``mapInArrow`` function: ``fn(bytes, offsets)`` gives the columns after ``ids``."""
    def run(batches):
        for rows, data, off in text_slices(batches, text):
            columns = [rows.column(rows.schema.get_field_index(ids)), *fn(data, off)]
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                   for c, f in zip(columns, schema, strict=True)], schema=schema)
    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span (spans have at least one byte).

    Eight bytes at a time, mixed with their place by a function that is not
    linear before they are added, so that no rearrangement of a text keeps
    its hash.  Different seeds give independent hashes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    count = (lengths + 7) >> 3
    first = np.cumsum(count) - count
    step = np.arange(int(count.sum())) - np.repeat(first, count)
    at = np.repeat(starts, count) + 8 * step
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    words = words[at] & _FIRST_BYTES[np.minimum(np.repeat(ends, count) - at, 8)]
    with np.errstate(over="ignore"):
        places = mix(np.arange(1, int(count.max()) + 1).astype(np.uint64) * _STEP + np.uint64(seed & 0xFFFFFFFF) * _MIX2)
        mixed = mix(words ^ places[step])
        total = mixed if len(mixed) == len(starts) else np.add.reduceat(mixed, first)
        return mix(total + lengths.astype(np.uint64) * _MIX1)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and where each row's words begin (rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.concatenate(([False], ~IS_SPACE[data], [False]))
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    word = inside[1:-1]
    starts = np.flatnonzero(word & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(word & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``bounds`` (an empty range sums to 0)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
