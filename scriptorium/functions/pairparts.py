"""Edit distances and accuracy measures of whole Arrow batches of pairs (SCA-1, SCA-9..11, SCA-14, AGG-1/2 parts).

The measures of ``distance.py`` as operations on the code points of many
texts at once.  White space is one table look-up; what lies before a
place is a prefix sum; words are numbered by a dictionary of their characters.

Distances advance one column of the alignment matrix at a time, as bits of
vertical differences, for all pairs together (see ``bitdistance.py``, which
takes the pairs whose shorter text has more characters than a word has
bits).  A pair whose texts are their own normalised form has one distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .bitdistance import WORD, distances
from .ngramcounts import WIDE_SPACES, flat, slices

#: Longer texts leave the pairs that advance together, as these all wait for the longest.
LONGEST_TEXT = 128
#: Pairs that advance together, and pairs of characters that are compared together.
TOGETHER, CELLS = 4096, 1 << 18

#: Python's white space by code point; the last entry stands for all code points beyond.
SPACES = np.zeros(0x3002, bool)
SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, *WIDE_SPACES]] = True


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins (texts + 1)."""
    data, off = flat(texts.cast(pa.large_binary()))
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint16), off
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    size[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1  # a byte that is no UTF-8
    begin = np.cumsum(size) - size
    # 0xFFFF stays free for what no text holds
    return codes.astype(np.uint16 if codes.max() < 0xFFFF else np.uint32), np.searchsorted(begin, off)


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place (places + 1)."""
    out = np.zeros(len(flags) + 1, np.int32)  # sums of this width take a quarter of the time, and no text has more characters
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def _places(first: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The ``size`` places from each ``first`` on, one span after the other; ``end`` sums the sizes."""
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - size), size)


def _agreeing(values: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of ``size`` values from ``a`` on equal those from ``b`` on, for each pair of places."""
    end = np.cumsum(size)
    equal = _before(values[_places(a, size, end)] == values[_places(b, size, end)])
    return equal[end] - equal[end - size]


def _grid(codes: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """(rows, width): each row's characters, then one that no text holds."""
    col = np.arange(width)
    none = codes.dtype.type(np.iinfo(codes.dtype).max)
    return np.where(col < size[:, None], codes[np.minimum(first[:, None] + col, len(codes) - 1)], none)


def _together(codes: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Distances of pairs whose texts at ``a`` have 1 to ``WORD`` characters; the longest text at ``b`` comes first."""
    n, longest = len(a), int(lb[0])
    pattern, text = _grid(codes, a, la, WORD), _grid(codes, b, lb, longest)
    equal = np.empty((longest, n), np.uint64)
    step = max(1, CELLS // (WORD * longest))
    for lo in range(0, n, step):
        same = text[lo: lo + step, :, None] == pattern[lo: lo + step, None, :]
        equal[:, lo: lo + step] = np.packbits(same.reshape(-1), bitorder="little").view(np.uint64).reshape(-1, longest).T
    one = np.uint64(1)
    top = (la - 1).astype(np.uint64)
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.astype(np.int64)
    lives = np.searchsorted(-lb, -np.arange(longest), "left")
    for t in range(longest):
        live = int(lives[t])
        eq, pv, mv, at = equal[t, :live], plus[:live], minus[:live], top[:live]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score[:live] += ((ph >> at) & one).astype(np.int64)
        score[:live] -= ((mh >> at) & one).astype(np.int64)
        ph, mh = (ph << one) | one, mh << one
        plus[:live], minus[:live] = mh | ~(xv | ph), ph & xv
    return score


def pair_distances(codes: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distances of the texts of ``la`` characters at ``a`` and ``lb`` at ``b``."""
    swap = la > lb
    a, la, b, lb = np.where(swap, b, a), np.where(swap, lb, la), np.where(swap, a, b), np.where(swap, la, lb)
    out = lb.astype(np.int64)  # right where the shorter text is empty
    near = np.flatnonzero((la > 0) & (la <= WORD) & (lb <= LONGEST_TEXT))
    near = near[np.argsort(-lb[near], kind="stable")]
    for lo in range(0, len(near), TOGETHER):
        rows = near[lo: lo + TOGETHER]
        out[rows] = _together(codes, a[rows], la[rows], b[rows], lb[rows])
    far = np.flatnonzero((la > 0) & ((la > WORD) | (lb > LONGEST_TEXT)))
    if len(far):
        def text(first, size):
            return codes[first: first + size].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

        out[far] = distances([text(a[i], la[i]) for i in far], [text(b[i], lb[i]) for i in far])
    return out


def text_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """SCA-1 of pairs, null where a side is."""
    differs = pc.not_equal(a, b)
    rows = np.flatnonzero(pc.fill_null(differs, False).to_numpy(zero_copy_only=False))
    out = np.zeros(len(a), np.int64)
    a, b = a.take(pa.array(rows)), b.take(pa.array(rows))
    for lo, hi in slices(a, b):
        codes, off = characters(pa.concat_arrays([a[lo: hi], b[lo: hi]]))
        first, size, n = off[:-1], np.diff(off), hi - lo
        out[rows[lo: hi]] = pair_distances(codes, first[:n], size[:n], first[n:], size[n:])
    return pa.array(out, mask=differs.is_null().to_numpy(zero_copy_only=False))


def _word_numbers(codes: np.ndarray, solid: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin at the given places among the characters that are not white space."""
    kept = codes[solid]
    ends = np.append(starts, len(kept)) * codes.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode().indices.to_numpy()


FIELDS = ("ed", "ed_norm", "exact", "pad_match", "trunc_match", "word_match",
          "pred_chars", "pred_words", "ref_chars", "ref_words", "ref_norm_len")
#: Fields that one side decides; the others are null if either side is.
ONE_SIDED = {"pred_chars": 0, "pred_words": 0, "ref_chars": 1, "ref_words": 1, "ref_norm_len": 1}


def pair_parts(pred: pa.Array, ref: pa.Array) -> dict[str, np.ndarray]:
    """The fields of pairs of texts without nulls."""
    n = len(ref)
    differs = np.flatnonzero(~pc.equal(pred, ref).to_numpy(zero_copy_only=False))
    # all references, then the predictions that differ; of equal texts one is enough
    codes, off = characters(pa.concat_arrays([ref, pred.take(pa.array(differs))]))
    own = np.arange(n)
    own[differs] = n + np.arange(len(differs))
    length = np.diff(off)
    space = SPACES[np.minimum(codes, len(SPACES) - 1)]
    solid, edge = ~space, np.zeros(len(codes) + 1, bool)
    edge[off] = True
    heads = solid & edge[:-1]
    heads[1:] |= solid[1:] & space[:-1]
    solids, words = _before(solid), _before(heads)
    n_solid, n_words = np.diff(solids[off]), np.diff(words[off])
    at = np.append(np.flatnonzero(solid), 0)
    begin = np.where(n_solid > 0, at[solids[off[:-1]]], off[:-1])
    stripped = np.where(n_solid > 0, at[solids[off[1:]] - 1] + 1 - begin, 0)
    norm_len = n_solid + np.maximum(n_words - 1, 0)

    out = {f: np.zeros(n, np.int64) for f in FIELDS}
    for side, which in (("pred", own), ("ref", np.arange(n))):
        out[f"{side}_chars"], out[f"{side}_words"] = stripped[which], n_words[which]
    out["ref_norm_len"] = norm_len[:n]
    out["exact"] = np.ones(n, bool)
    out["pad_match"], out["trunc_match"], out["word_match"] = stripped[:n].copy(), stripped[:n].copy(), n_words[:n].copy()
    if not len(differs):
        return out

    p, r = own[differs], differs
    both = np.minimum(stripped[p], stripped[r])
    agree = _agreeing(codes, begin[p], begin[r], both)
    longer = np.where(stripped[p] > stripped[r], p, r)
    # a space agrees with what fills the shorter text up
    size = stripped[longer] - both
    end = np.cumsum(size)
    blanks = _before(codes[_places(begin[longer] + both, size, end)] == 0x20)
    out["trunc_match"][r], out["pad_match"][r] = agree, agree + blanks[end] - blanks[end - size]
    out["exact"][r] = (stripped[p] == stripped[r]) & (agree == both)
    numbers, first = _word_numbers(codes, solid, solids[np.flatnonzero(heads)]), words[off[:-1]]
    out["word_match"][r] = _agreeing(numbers, first[p], first[r], np.minimum(n_words[p], n_words[r]))

    out["ed"][r] = pair_distances(codes, off[p], length[p], off[r], length[r])
    normal, odd = norm_len == length, space & (codes != 0x20)
    if odd.any():
        odds = _before(odd)
        normal &= odds[off[1:]] == odds[off[:-1]]
    rest = ~(normal[p] & normal[r])
    out["ed_norm"][r] = out["ed"][r]
    if rest.any():
        p, r = p[rest], r[rest]
        # a space is kept before each word but a text's first
        kept, head = solid.copy(), np.flatnonzero(heads)
        later = np.ones(len(head), bool)
        later[first[n_words > 0]] = False
        kept[head[later] - 1] = True
        texts = np.where(space, codes.dtype.type(0x20), codes)[kept]
        start = _before(kept)[off[:-1]]
        out["ed_norm"][r] = pair_distances(texts, start[p], norm_len[p], start[r], norm_len[r])
    return out


def batch_parts(pred: pa.Array, ref: pa.Array) -> pa.StructArray:
    """The fields of pairs of texts, null where a side that they depend on is."""
    known = [c.is_valid().to_numpy(zero_copy_only=False) for c in (pred, ref)]
    pred, ref = pc.fill_null(pred, ""), pc.fill_null(ref, "")
    parts = [pair_parts(pred[lo: hi], ref[lo: hi]) for lo, hi in slices(pred, ref)]
    columns = []
    for f in FIELDS:
        values = np.concatenate([x[f] for x in parts]) if parts else np.zeros(0, np.int64)
        missing = ~known[ONE_SIDED[f]] if f in ONE_SIDED else ~(known[0] & known[1])
        columns.append(pa.array(values, pa.bool_() if f == "exact" else pa.int32(), mask=missing))
    return pa.StructArray.from_arrays(columns, FIELDS)


@F.arrow_udf(StructType([StructField(f, BooleanType() if f == "exact" else IntegerType()) for f in FIELDS]))
def _batch_parts(pred: pa.Array, ref: pa.Array) -> pa.Array:
    return batch_parts(pred, ref)


@F.arrow_udf(LongType())
def _text_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    return text_distances(a, b)


def line_distance(a, b) -> Column:
    """SCA-1 where the texts go to Python anyway, as for BLEU; ``distance.edit_distance`` needs none."""
    return _text_distances(a, b)


def line_parts(pred, ref) -> Column:
    """Struct of the measures of two texts (see ``scores.score_parts`` for what they are)."""
    return _batch_parts(pred, ref)
