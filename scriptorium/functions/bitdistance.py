"""Bit-parallel edit distance for texts of any length (SCA-1 on raw lines and whole pages).

``levenshtein`` visits every cell of the alignment matrix, which is right for
short lines and too slow for pages.  Here one column of the matrix is a
bit vector of its vertical differences (+1 / -1), and a text character updates the
whole column by a dozen word operations.

* A shorter side of at most 64 characters is one machine word: all such pairs of an
  Arrow batch advance together, one text position at a time.
* Longer pairs lose their common ends.  Up to ``LONGEST_TEXT`` characters they advance
  together in a band along the diagonal, which is widened for pairs whose distance is beyond its reach.
* Texts longer still, and pairs beyond the widest band, use integers as wide as the
  shorter side, whose addition carries across words.

Distances are exact, in code points with unit costs, equal to ``levenshtein``;
null if a side is null.  A column of a pair needs a few times its length in
bits, so memory is bounded by the longest text of a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

WORD = 64
#: Longer texts leave the batch of short pairs, whose other pairs would wait for them.
LONGEST_TEXT = 2048
#: Pairs that advance together.
BATCH = 16_384
#: Words of the bands that pairs of longer texts try in turn.
BANDS = (1, 2, 4, 8)
#: Such pairs that advance together, as their bits are kept for the whole alphabet; fewer than ``FEW`` a word go one by one.
TOGETHER, FEW = 4096, 48


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins (texts + 1)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.append(0, np.cumsum(size))


def word_distances(patterns: Sequence[str], texts: Sequence[str]) -> np.ndarray:
    """Distances of pairs whose pattern has at most 64 characters."""
    n = len(patterns)
    order = np.argsort([-len(t) for t in texts], kind="stable")
    patterns, texts = [patterns[i] for i in order], [texts[i] for i in order]
    flat, begin = _codes(patterns)
    size = np.diff(begin)
    pair = np.repeat(np.arange(n), size)
    bit = np.uint64(1) << (np.arange(len(flat)) - begin[pair]).astype(np.uint64)
    key = (pair << 21) | flat
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n and len(key) else np.zeros(0, np.int64)
    masks = np.bitwise_or.reduceat(bit[by], first) if len(first) else np.zeros(0, np.uint64)
    keys = key[first]
    text, start = _codes(texts)
    length = np.diff(start)
    wanted = (np.repeat(np.arange(n), length) << 21) | text
    if len(keys):
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        equal = np.where(keys[place] == wanted, masks[place], np.uint64(0))
    else:
        equal = np.zeros(len(wanted), np.uint64)
    last = np.uint64(1) << (np.maximum(size, 1) - 1).astype(np.uint64)
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), size.copy()
    one = np.uint64(1)
    for t in range(int(length.max(initial=0))):
        live = int(np.searchsorted(-length, -t, "left"))  # texts longer than t come first
        eq, pv, mv, top = equal[start[:live] + t], plus[:live], minus[:live], last[:live]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[:live] += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
        ph, mh = (ph << one) | one, mh << one
        plus[:live], minus[:live] = mh | ~(xv | ph), ph & xv
    score[size == 0] = length[size == 0]
    out = np.empty(n, np.int64)
    out[order] = score
    return out


def long_distance(a: str, b: str) -> int:
    """Distance of one pair of any length."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    differ = np.flatnonzero(x != y[: len(x)])
    head = int(differ[0]) if len(differ) else len(x)
    differ = np.flatnonzero(x[head:][::-1] != y[len(y) - len(x) + head:][::-1])
    tail = int(differ[0]) if len(differ) else len(x) - head
    x, y = x[head: len(x) - tail], y[head: len(y) - tail]
    m = len(x)
    if not m:
        return len(y)
    equal = {int(c): int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in np.unique(x)}
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in y.tolist():
        eq = equal.get(c, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & full
        ph, mh = minus | (full ^ (xh | plus)), plus & xh
        if ph >= top:
            score += 1
        elif mh >= top:
            score -= 1
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        plus, minus = mh | (full ^ (xv | ph)), ph & xv
    return score


def band_distances(longer: Sequence[str], shorter: Sequence[str], words: int) -> np.ndarray:
    """Distances of pairs from a band of ``words`` words along the diagonal; right where they are at most ``reach(words)``, else above it.

    Bit b of the band is row ``start + b`` of the longer text's column, and ``start`` moves with the column.  The
    score follows the band's last diagonal to the last row, then that row.
    """
    n, most = len(longer), reach(words)
    order = np.argsort([-len(t) for t in shorter], kind="stable")
    longer, shorter = [longer[i] for i in order], [shorter[i] for i in order]
    flat, begin = _codes(longer)
    text, first = _codes(shorter)
    size, length = np.diff(begin), np.diff(first)
    alphabet, code = np.unique(flat, return_inverse=True)
    # rows of bits by (pair, character of the alphabet), with room on both sides; one character stands for all others
    width, room = len(alphabet) + 1, words * WORD
    place = np.minimum(np.searchsorted(alphabet, text), len(alphabet) - 1)
    at = np.where(alphabet[place] == text, place, len(alphabet))
    row = np.repeat(np.arange(n), size)
    col = np.arange(len(flat)) - np.repeat(begin[:-1], size) + room
    height = (max(int(size.max()), int(length[0])) + 2 * room) // WORD + words + 2
    cell = (col // WORD) * (n * width) + row * width + code
    by = np.argsort(cell, kind="stable")
    cell = cell[by]
    head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    bits = np.zeros(height * n * width, np.uint64)
    bits[cell[head]] = np.bitwise_or.reduceat(np.uint64(1) << (col[by] % WORD).astype(np.uint64), head)
    bits = bits.reshape(height, n * width)
    one, top = np.uint64(1), np.uint64(WORD - 1)
    plus, minus = np.zeros((words, n), np.uint64), np.zeros((words, n), np.uint64)
    for b in range(room - most - 1, room):
        plus[b // WORD] |= one << np.uint64(b % WORD)
    score = np.minimum(most, size)
    # each column's characters side by side, as places in a row of bits
    steps = int(length[0])
    columns = np.zeros((steps, n), np.int64)
    of = np.repeat(np.arange(n), length)
    columns[np.arange(len(text)) - np.repeat(first[:-1], length), of] = at + of * width
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # texts longer than t come first
    last_row = room - 2 + size - most  # the last row's bit in column 0
    for t in range(steps):
        live = int(alive[t])
        wanted = columns[t, :live]
        start = most + 1 + t  # of the band, room included
        k, shift = divmod(start, WORD)
        rows = [bits[k + j].take(wanted) for j in range(words + (shift > 0))]
        if shift:
            right, left = np.uint64(shift), np.uint64(WORD - shift)
            rows = [(rows[j] >> right) | (rows[j + 1] << left) for j in range(words)]
        diagonal, ups, downs, carry = [], [], [], None
        for j, eq in enumerate(rows):
            pv, mv = plus[j, :live], minus[j, :live]
            x = eq & pv
            total = x + pv
            if words > 1:
                over = total < pv
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            d = (total ^ pv) | eq | mv
            diagonal.append(d)
            ups.append(mv | ~(d | pv))
            downs.append(d & pv)
        bit = last_row[:live] - t
        inside = bit < room - 1
        change = one - (diagonal[-1] >> top)
        change = change.astype(np.int64)
        if inside.any():
            bit = np.clip(bit, 0, room - 1)
            by_bit, of_word = (bit % WORD).astype(np.uint64), bit // WORD
            for j in range(words):
                here = inside & (of_word == j)
                change = np.where(here, ((ups[j] >> by_bit) & one).astype(np.int64) - ((downs[j] >> by_bit) & one).astype(np.int64), change)
        score[:live] += change
        for j, d in enumerate(diagonal):
            d = (d >> one) | (diagonal[j + 1] << top) if j + 1 < words else d >> one
            plus[j, :live], minus[j, :live] = downs[j] | ~(d | ups[j]), d & ups[j]
    out = np.empty(n, np.int64)
    out[order] = score
    return out


def reach(words: int) -> int:
    """Largest distance that a band of so many words finds."""
    return words * WORD // 2 - 1


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Two different texts without their common start and end, the shorter one first."""
    head = len(commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return (a, b) if len(a) <= len(b) else (b, a)


def distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Edit distance of every pair."""
    out = np.zeros(len(a), np.int64)
    short, wide = [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            continue
        p, t = _trimmed(x, y)
        if not p:
            out[i] = len(t)
        elif len(t) > LONGEST_TEXT:
            out[i] = long_distance(p, t)
        else:
            (short if len(p) <= WORD else wide).append((i, p, t))
    for lo in range(0, len(short), BATCH):
        rows, p, t = zip(*short[lo: lo + BATCH], strict=True)
        out[list(rows)] = word_distances(p, t)
    for words in BANDS:  # pairs beyond a band's reach try the next one
        later = [x for x in wide if len(x[2]) - len(x[1]) > reach(words)]
        tried = sorted((x for x in wide if len(x[2]) - len(x[1]) <= reach(words)), key=lambda x: len(x[2]))
        if len(tried) < FEW * words:
            break
        for lo in range(0, len(tried), TOGETHER):
            some = tried[lo: lo + TOGETHER]
            rows, p, t = zip(*some, strict=True)
            found = band_distances(t, p, words)
            known = found <= reach(words)
            out[np.array(rows)[known]] = found[known]
            later += [x for x, done in zip(some, known, strict=True) if not done]
        wide = later
    for i, p, t in wide:
        out[i] = long_distance(p, t)
    return out


@pandas_udf(LongType())
def _edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.array(np.zeros(len(a), np.int64), "Int64")
    out[~known] = pd.NA
    out[known] = distances(a[known].tolist(), b[known].tolist())
    return pd.Series(out)


def page_edit_distance(a, b) -> Column:
    """SCA-1 for texts that may be long; for lines of a few dozen characters ``edit_distance`` needs no Python."""
    return _edit_distance(a, b)
