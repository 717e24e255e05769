"""Counts over the words and lines of a slice of texts, shared by the quality operators."""

from __future__ import annotations

import numpy as np

from .batches import mix, row_sums, rows_of, span_hashes, word_spans

_ROW = np.uint64(0x9E3779B97F4A7C15)


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the ``\\n``-split lines with at least one byte, and the rows' bounds in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.concatenate(([False], data != 0x0A, [False]))
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    line = inside[1:-1]
    starts = np.flatnonzero(line & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(line & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def in_row(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes made different for different rows."""
    with np.errstate(over="ignore"):
        return mix(hashes + rows_of(bounds).astype(np.uint64) * _ROW)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` items inside a row, and the item at which it begins."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = rows_of(bounds)
    first = np.flatnonzero(row[:n] == row[size - 1:])
    joined = np.zeros(len(first), np.uint64)
    for k in range(size):
        joined = mix(joined * _ROW + hashes[first + k])
    return joined, first


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, size: int = 3) -> np.ndarray:
    """Per row, the words inside windows of ``size`` words that occur twice or more in the row."""
    joined, first = windows(hashes, bounds, size)
    if not len(first):
        return np.zeros(len(bounds) - 1, np.int64)
    own = mix(joined + rows_of(bounds)[first].astype(np.uint64) * _ROW)
    _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
    again = first[count[inverse] > 1]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + size, -1)
    return row_sums(np.cumsum(change)[:-1] > 0, bounds)


def distinct_per_row(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of different hashes in each row."""
    _, first = np.unique(in_row(hashes, bounds), return_index=True)
    return np.bincount(rows_of(bounds)[first], minlength=len(bounds) - 1)


def repeated_lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word, and those of them that equal an earlier one."""
    starts, ends, bounds = line_spans(data, off)
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    hashes = span_hashes(data, starts, ends)[has_word]
    kept = np.concatenate(([0], np.cumsum(has_word)))[bounds]
    lines = np.diff(kept)
    return lines, lines - distinct_per_row(hashes, kept)


class Words:
    """Words of a slice: spans, hashes and row bounds."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.starts, self.ends, self.bounds = word_spans(data, off)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.count = np.diff(self.bounds)
