"""13a tokens and clipped n-gram counts of whole Arrow batches (SCA-8, SCA-8b).

The rules of ``bleu.py`` as operations on the UTF-8 bytes of many texts at
once: a rule only puts spaces around ASCII characters, so tokens are the runs
between white space and *cuts*, and no text is rewritten but those that hold
one of the literals.  Tokens are numbered by a dictionary of their bytes, so
equal numbers are equal tokens.

Of a pair, each hypothesis token has a word of bits, one for each reference
token that equals it; n-grams that agree are such words shifted and combined.
A hypothesis n-gram counts if fewer like it stand before it than there are in
the reference, which clips the counts.  Pairs with more tokens than a word has
bits are counted by a table of their n-grams, one pair after the other.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MAX_ORDER = 4
#: Bytes of texts that are worked on together (a longer text by itself), which bounds a task's memory.
SLICE_BYTES = 1 << 19
#: Sides of the squares of a pair's tokens with the words that hold a row, and the cells that are compared together.
SQUARES, CELLS = ((16, np.uint16), (32, np.uint32), (64, np.uint64)), 1 << 21

#: Literals of the 13a rules, replaced in this order after trailing white space is gone.
LITERALS = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
# A line break is white space with or without its rule.
_LITERAL_BYTES = [old.encode() for old, _ in LITERALS if old != "\n"]
_ANY_LITERAL = "|".join(old for old, _ in LITERALS if old != "\n")

SPACE, MARK, POINT, DIGIT, DASH, WIDE = 1, 2, 4, 8, 16, 32
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = SPACE
KIND[[ord(c) for c in "{|}~[\\]^_`!\"#$%&()*+:;<=>?@/"]] = MARK
KIND[[ord(c) for c in ".,"]] = POINT
KIND[[ord(c) for c in "0123456789"]] = DIGIT
KIND[ord("-")] = DASH
#: First bytes of white space beyond ASCII.
KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = WIDE
WIDE_SPACES = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _plain(column: pa.Array) -> pa.Array:
    """The texts as bytes, literals replaced where there are any."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return column
    off = np.frombuffer(offsets, np.int64)
    held = memoryview(data)[off[column.offset]: off[column.offset + len(column)]].tobytes()
    if not any(old in held for old in _LITERAL_BYTES):
        return column
    holds = pc.match_substring_regex(column, _ANY_LITERAL)

    def replaced(text: bytes) -> bytes:
        s = text.decode(errors="replace").rstrip()
        for old, new in LITERALS:
            s = s.replace(old, new)
        return s.encode()

    return pc.replace_with_mask(column, holds, pa.array([replaced(t) for t in column.filter(holds).to_pylist()], pa.large_binary()))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (texts + 1)."""
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[off[0]: off[-1]], off - off[0]


def _spaces(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space (Python's)."""
    space = (kind & SPACE) != 0
    lead = np.flatnonzero(kind & WIDE)
    if len(lead):
        first, second, third = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3))
        two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
        three = (first != 0xC2) & np.isin((first & 15) << 12 | (second & 63) << 6 | third & 63, WIDE_SPACES)
        for k, wide in ((0, two | three), (1, two | three), (2, three)):
            space[lead[wide] + k] = True
    return space


def _cuts(kind: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a token cannot go on: at texts' borders and where a 13a rule puts a space (bytes + 1)."""
    edge = np.zeros(len(kind) + 1, bool)
    edge[off] = True
    cut = edge.copy()

    def digit(at):  # within the text that the neighbour is in
        return (kind[np.minimum(at, len(kind) - 1)] & DIGIT) != 0

    mark = np.flatnonzero(kind & MARK)
    cut[mark] = cut[mark + 1] = True
    dash = np.flatnonzero(kind & DASH)
    dash = dash[~edge[dash] & digit(dash - 1)]
    cut[dash] = cut[dash + 1] = True
    point = np.flatnonzero(kind & POINT)
    if len(point):
        # Points and commas in a row are cut from each other.  The rules take them two by two, so whether the last one
        # keeps a digit behind it depends on their number and on the character before; one between digits keeps both.
        cut[point] = cut[point + 1] = True
        at = np.flatnonzero(np.append(True, (np.diff(point) != 1) | edge[point[1:]]))
        head, number = point[at], np.diff(np.append(at, len(point)))
        after = head + number
        before, behind = ~edge[head] & digit(head - 1), ~edge[after] & digit(after)
        cut[after[behind & (before == (number % 2 == 1))]] = False
        cut[head[before & behind & (number == 1)]] = False
    return cut


def token_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the 13a tokens of all texts in a row (equal for equal tokens), and where each text's begin (texts + 1)."""
    data, off = flat(_plain(texts))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    kind = KIND[data]
    solid = ~_spaces(data, kind)
    begins = _cuts(kind, off)[:-1]
    begins[1:] |= ~solid[:-1]
    begins &= solid
    starts = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid))
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data[solid])])
    return tokens.dictionary_encode().indices.to_numpy(), np.searchsorted(np.flatnonzero(begins), off)


def _grid(numbers: np.ndarray, first: np.ndarray, size: np.ndarray, width: int, fill: int) -> np.ndarray:
    """(rows, width): each row's numbers, then ``fill``."""
    col = np.arange(width)
    inside = col < size[:, None]
    if not len(numbers):
        return np.full(inside.shape, fill, np.int32)
    return np.where(inside, numbers[np.minimum(first[:, None] + col, len(numbers) - 1)], np.int32(fill))


def _bits(a: np.ndarray, b: np.ndarray, word: type) -> np.ndarray:
    """(rows, width): bit j of word i is set where a's number i is b's number j."""
    same = a[:, :, None] == b[:, None, :]
    return np.packbits(same.reshape(-1), bitorder="little").view(word).reshape(a.shape)


def _squares(hyp: np.ndarray, ref: np.ndarray, word: type) -> np.ndarray:
    """Clipped counts (rows, orders) of grids of at most as many tokens as a word has bits."""
    width = hyp.shape[1]
    found, own = _bits(hyp, ref, word), _bits(hyp, hyp, word)
    found_1, own_1 = found.copy(), own.copy()
    earlier = (word(1) << np.arange(width).astype(word)) - word(1)
    out = np.empty((len(hyp), MAX_ORDER), np.int32)
    for n in range(MAX_ORDER):
        if n:
            for grams, single in ((found, found_1), (own, own_1)):
                grams[:, :-n] &= single[:, n:] >> word(n)
                grams[:, width - n:] = 0
        counts = np.bitwise_count(own & earlier) < np.bitwise_count(found)
        out[:, n] = np.bitwise_count(np.packbits(counts.reshape(-1)).view(word))
    return out


def _table(hyp: list[int], ref: list[int]) -> list[int]:
    """Clipped counts of one pair of any length."""
    def grams(tokens, n):
        return Counter(zip(*(tokens[k:] for k in range(n))))

    return [sum((grams(hyp, n) & grams(ref, n)).values()) for n in range(1, MAX_ORDER + 1)]


def clipped_counts(numbers: np.ndarray, hyp_first: np.ndarray, hyp_size: np.ndarray, ref_first: np.ndarray, ref_size: np.ndarray) -> np.ndarray:
    """(pairs, orders): sum over distinct n-grams of the smaller of their counts in the hypothesis and in the reference."""
    out = np.zeros((len(hyp_size), MAX_ORDER), np.int32)
    most, least = np.maximum(hyp_size, ref_size), 0
    for width, word in SQUARES:
        some = np.flatnonzero((most > least) & (most <= width))
        for lo in range(0, len(some), CELLS // width ** 2):
            rows = some[lo: lo + CELLS // width ** 2]
            # what fills the grids is no token and differs, so it agrees with nothing
            out[rows] = _squares(_grid(numbers, hyp_first[rows], hyp_size[rows], width, -2), _grid(numbers, ref_first[rows], ref_size[rows], width, -1), word)
        least = width
    for i in np.flatnonzero(most > least):
        out[i] = _table(numbers[hyp_first[i]: hyp_first[i] + hyp_size[i]].tolist(), numbers[ref_first[i]: ref_first[i] + ref_size[i]].tolist())
    return out


def slices(hyp: pa.Array, ref: pa.Array):
    """Ranges of pairs whose texts have at most ``SLICE_BYTES`` bytes together, or one pair."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (hyp, ref))
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def pair_counts(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
    """(pairs, 2 + orders): tokens of the hypothesis, of the reference, clipped counts; a null hypothesis stands for the reference."""
    out = np.zeros((len(ref), 2 + MAX_ORDER), np.int32)
    for lo, hi in slices(hyp, ref):
        part = out[lo: hi]
        other = hyp[lo: hi]
        differs = np.flatnonzero(other.is_valid().to_numpy(zero_copy_only=False))
        numbers, first = token_numbers(pa.concat_arrays([ref[lo: hi], other.take(pa.array(differs))]))
        size = np.diff(first)
        part[:, 0] = part[:, 1] = size[: hi - lo]
        part[differs, 0] = size[hi - lo:]
        part[:, 2:] = np.maximum(part[:, :1] - np.arange(MAX_ORDER), 0)
        part[differs, 2:] = clipped_counts(numbers, first[hi - lo: -1], size[hi - lo:], first[differs], size[differs])
    return out


FIELDS = ("lh", "lr", *(f"c{n}" for n in range(1, MAX_ORDER + 1)))


@F.arrow_udf(StructType([StructField(f, IntegerType()) for f in FIELDS]))
def _pair_counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    counts = pair_counts(hyp, pc.fill_null(ref, ""))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(FIELDS))], FIELDS)


def ngram_counts(hyp: Column, ref: Column) -> Column:
    """Struct of the token counts ``lh`` and ``lr`` and the clipped n-gram counts ``c1`` to ``c4``; a null text has no tokens."""
    h, r = F.coalesce(hyp, F.lit("")), F.coalesce(ref, F.lit(""))
    return _pair_counts(F.when(h != r, h), ref)
