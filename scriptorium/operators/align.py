"""JOI-2 for pages that drift: order-preserving alignment of all lines of a page.

``pairs.align_lines`` looks at the few lines around the same number; lines that
recognition dropped, split or invented move all later lines away from their
numbers.  Here both sides of a page are aligned as sequences: every line is either
paired (cost: edit distance) or left alone (cost: its length and its line
break), pairs do not cross, and the total cost is least.  Lines that differ in more
than half of the longer one's characters are no pair: they would otherwise be paired
wherever something was dropped and something invented.

1. *Anchors.*  Character q-grams that occur in exactly one line on each side of
   the page vote for that pair of lines.  Pairs that are each other's best, have
   two votes and a small distance, and form the longest increasing chain, are fixed.
2. *Between anchors* a banded dynamic programme aligns what is left.  A path that
   leaves a band of half width w skips at least w + 1 lines on both sides; while
   that could cost less than the best path inside, the band doubles.  So each
   stretch is aligned exactly, whatever was dropped in it.

In Spark both sides meet in one aggregate per page, and pages are aligned in Arrow
batches, whose size in bytes is bounded; the edit distances of many pages are taken
together, bit-parallel.  A page is held by one task, as a document's text is.

Semantics: null texts are empty lines; lines without a page id are aligned with
nothing and left out; lines of equal number keep the order of their texts.  A page
on one side only has unpaired lines only.  Of equally cheap paths the one is taken
that, seen from the end, pairs first and then leaves the recognised line alone.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitdistance import distances

GRAM, VOTES, FIRST_BAND = 10, 2, 4
#: Largest share of differing characters in a pair, and in one that is fixed beforehand.
PAIR_SHARE, ANCHOR_SHARE = 0.5, 0.4
#: Characters of the pages that are aligned together.
SLICE_CHARS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _single_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams that occur in one line only, ascending, and that line's number."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(flat) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(lines)), size)
    hashed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        hashed = (hashed + flat[k: k + n]) * _BASE
        hashed ^= hashed >> np.uint64(29)
    inside = line[:n] == line[GRAM - 1:]
    hashed, line = hashed[inside], line[:n][inside]
    by = np.lexsort((line, hashed))
    hashed, line = hashed[by], line[by]
    fresh = np.append(True, (hashed[1:] != hashed[:-1]) | (line[1:] != line[:-1]))[: len(hashed)]
    hashed, line = hashed[fresh], line[fresh]
    values, first, count = np.unique(hashed, return_index=True, return_counts=True)
    return values[count == 1], line[first[count == 1]]


def anchor_candidates(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of lines that are each other's best by shared single q-grams, ascending on the left."""
    a, la = _single_grams(left)
    b, lb = _single_grams(right)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return []
    pair, votes = np.unique(la[i] * len(right) + lb[j], return_counts=True)
    x, y = pair // len(right), pair % len(right)
    best_x, best_y = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    np.maximum.at(best_x, x, votes)
    np.maximum.at(best_y, y, votes)
    good = (votes >= VOTES) & (votes == best_x[x]) & (votes == best_y[y])
    return list(zip(x[good].tolist(), y[good].tolist(), strict=True))


def increasing_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain that ascends strictly on both sides; ``pairs`` ascend on the left."""
    ends, at, before = [], [], [-1] * len(pairs)
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))  # two pairs of one left line never join a chain
    for k, (_, y) in enumerate(pairs):
        place = bisect_left(ends, y)
        before[k] = at[place - 1] if place else -1
        if place == len(ends):
            ends.append(y)
            at.append(k)
        else:
            ends[place], at[place] = y, k
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


class _Distances:
    """Distances of line pairs, asked for in one go and taken once a pair."""

    def __init__(self):
        self.known: dict[tuple[str, str], int] = {}

    def take(self, pairs) -> None:
        new = [p for p in dict.fromkeys(pairs) if p not in self.known]
        if new:
            self.known.update(zip(new, distances(*zip(*new, strict=True)).tolist(), strict=True))


class _Stretch:
    """Lines between two anchors, and the band that their alignment has reached."""

    def __init__(self, left: list[str], right: list[str], x: int, y: int):
        self.left, self.right, self.x, self.y, self.band = left, right, x, y, FIRST_BAND
        self.drift = len(right) - len(left)

    def limits(self, i: int) -> tuple[int, int]:
        """First and last column of row i inside the band."""
        return max(0, i + min(0, self.drift) - self.band), min(len(self.right), i + max(0, self.drift) + self.band)

    def cells(self):
        for i, line in enumerate(self.left, 1):
            lo, hi = self.limits(i)
            for j in range(max(lo, 1), hi + 1):
                yield line, self.right[j - 1]

    def outside(self) -> float:
        """No path that leaves the band costs less."""
        if self.band >= max(len(self.left), len(self.right)):
            return float("inf")
        a, b = (np.append(0, np.cumsum(sorted(len(t) + 1 for t in side))) for side in (self.left, self.right))
        least = float("inf")
        for more, fewer, drift in ((b, a, self.drift), (a, b, -self.drift)):
            skipped = max(0, drift) + self.band + 1
            if skipped < len(more) and skipped - drift < len(fewer):
                least = min(least, int(more[skipped] + fewer[skipped - drift]))
        return least

    def align(self, known: dict) -> list | None:
        """(left, right, distance) triples, None if a wider band might do better."""
        n, m = len(self.left), len(self.right)
        gap_x, gap_y = [len(t) + 1 for t in self.left], [len(t) + 1 for t in self.right]
        rows, moves, none = [], [], float("inf")
        for i in range(n + 1):
            lo, hi = self.limits(i)
            cost, move = [], []
            up, up_lo = (rows[-1], self.limits(i - 1)[0]) if i else ([], 0)
            for j in range(lo, hi + 1):
                best, how = (0, 0) if i == j == 0 else (none, 0)
                k = j - up_lo
                if i and j and 0 <= k - 1 < len(up):
                    apart = known[self.left[i - 1], self.right[j - 1]]
                    if apart <= PAIR_SHARE * max(gap_x[i - 1] - 1, gap_y[j - 1] - 1):
                        best, how = up[k - 1] + apart, 1
                if i and 0 <= k < len(up) and up[k] + gap_x[i - 1] < best:
                    best, how = up[k] + gap_x[i - 1], 2
                if j > lo and cost[-1] + gap_y[j - 1] < best:
                    best, how = cost[-1] + gap_y[j - 1], 3
                cost.append(best)
                move.append(how)
            rows.append(cost)
            moves.append(move)
        if rows[n][m - self.limits(n)[0]] > self.outside():
            return None
        out, i, j = [], n, m
        while i or j:
            how = moves[i][j - self.limits(i)[0]]
            if how == 1:
                i, j = i - 1, j - 1
                out.append((self.x + i, self.y + j, known[self.left[i], self.right[j]]))
            elif how == 2:
                i -= 1
                out.append((self.x + i, None, len(self.left[i])))
            else:
                j -= 1
                out.append((None, self.y + j, len(self.right[j])))
        return out[::-1]


def align_texts(pages: list[tuple[list[str], list[str]]]) -> list[list[tuple[int | None, int | None, int]]]:
    """For each page (recognised, verified lines) its triples (left, right, distance), unpaired lines with None and their length."""
    known = _Distances()
    candidates = [anchor_candidates(a, b) for a, b in pages]
    known.take((a[x], b[y]) for (a, b), pairs in zip(pages, candidates, strict=True) for x, y in pairs)
    done, open_ = [], []
    for p, ((a, b), pairs) in enumerate(zip(pages, candidates, strict=True)):
        near = [(x, y) for x, y in pairs if known.known[a[x], b[y]] <= ANCHOR_SHARE * max(len(a[x]), len(b[y]))]
        found, x0, y0 = [], 0, 0
        for x, y in [*increasing_chain(near), (len(a), len(b))]:
            if x > x0 or y > y0:
                stretch = _Stretch(a[x0:x], b[y0:y], x0, y0)
                open_.append((p, len(found), stretch))
                found.append([])
            if x < len(a) or y < len(b):
                found.append([(x, y, known.known[a[x], b[y]])])
            x0, y0 = x + 1, y + 1
        done.append(found)
    while open_:
        known.take(c for _, _, stretch in open_ for c in stretch.cells())
        waiting = []
        for p, place, stretch in open_:
            path = stretch.align(known.known)
            if path is None:
                stretch.band *= 2
                waiting.append((p, place, stretch))
            else:
                done[p][place] = path
        open_ = waiting
    return [[triple for part in found for triple in part] for found in done]


def _aligner(batches):
    for batch in batches:
        ids, waiting, size = [], [], 0

        def flush():
            rows = [(page, None if i is None else left[0][i], None if j is None else right[0][j], d)
                    for page, (left, right), triples in zip(ids, waiting, align_texts([(a[1], b[1]) for a, b in waiting]), strict=True)
                    for i, j, d in triples]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.record_batch([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                   names=["page", "line", "aligned_line", "distance"])

        for page, *sides in zip(*(batch.column(i) for i in range(3)), strict=True):
            lines = [([x["n"] for x in side], [x["t"] for x in side]) for side in (s.as_py() for s in sides)]
            ids.append(page.as_py())
            waiting.append(lines)
            size += sum(len(t) for _, texts in lines for t in texts)
            if size >= SLICE_CHARS:
                yield flush()
                ids, waiting, size = [], [], 0
        if ids:
            yield flush()


def align_pages(ocr_lines: DataFrame, ref_lines: DataFrame, page: str = "page_id", num: str = "line_number",
                ocr: str = "ocr_prediction", ref: str = "text") -> DataFrame:
    """(page, num, aligned_line, distance): every line of both sides once; the line number of the missing side is null."""
    none = F.lit(None).cast("struct<n: bigint, t: string>")

    def side(df, text):
        return F.struct(F.col(num).cast("bigint").alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    known = [d.where(F.col(page).isNotNull()) for d in (ocr_lines, ref_lines)]
    both = (known[0].select(F.col(page).alias("page"), side(ocr_lines, ocr).alias("o"), none.alias("r"))
            .unionAll(known[1].select(F.col(page).alias("page"), none.alias("o"), side(ref_lines, ref).alias("r"))))
    pages = both.groupBy("page").agg(F.sort_array(F.collect_list("o")).alias("o"), F.sort_array(F.collect_list("r")).alias("r"))
    kind = pages.schema["page"].dataType.simpleString()
    return (pages.mapInArrow(_aligner, f"page {kind}, line bigint, aligned_line bigint, distance bigint")
            .select(F.col("page").alias(page), F.col("line").alias(num), "aligned_line", "distance"))
