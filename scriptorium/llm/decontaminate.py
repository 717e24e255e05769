"""Benchmark decontamination by q-gram counting in diagonal bands (operator 5).

A document holds a benchmark item if some ``WINDOW`` consecutive bytes of the
item (the whole item, if shorter) align with a part of the document within
``EDITS`` edits.  By the q-gram lemma such an alignment keeps at least
``window + 1 - Q * (edits + 1)`` common q-grams, all within ``edits + 1``
neighbouring diagonals (document position minus item position).  So:

1. every document position is looked up in a table of the items' q-grams, and
   only stretches dense enough to hold that many hits go on;
2. the hits of each item are counted in bands of diagonals and blocks of item
   positions, both overlapping by half, so that every possible alignment lies
   in one cell; cells with too few hits go;
3. every window of the remaining cells that has enough hits is verified by a
   banded alignment.  Neighbouring windows differ by one edit at most, so a
   window that misses the budget by n rules out the next n - 1.

Steps 1 and 2 never lose an alignment; step 3 decides.  Texts are compared as
UTF-8 with A-Z lower-cased and white-space bytes made blanks.

Items of fewer than ``LEAST_BYTES`` bytes share too few q-grams with anything.
They are held by a document that has them word for word, as whole words.

Documents stay where they are; the items travel.  They are broadcast in parts
of at most ``PART_BYTES`` bytes, each part with a pass of its own over the
documents, so what a task holds does not grow with the benchmark.

Semantics: null, empty and blank texts and items match nothing; repeated items and rows
are matched one by one; other columns are ignored or, in :func:`keep_clean`,
passed through; with an empty benchmark every document is clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import IS_SPACE, LOWER, text_slices

Q, WINDOW, EDITS = 8, 64, 5
LEAST_BYTES = 24
PART_BYTES = 8 << 20
#: Edits beyond the budget that an alignment still counts, to rule out windows.
SLACK = 8

_FOLD = LOWER.copy()
_FOLD[IS_SPACE] = 0x20
_WORD = np.array([chr(b).isalnum() and b < 0x80 or b >= 0x80 for b in range(256)])
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def edit_budget(length: int) -> int:
    """Edits allowed in a window of so many bytes."""
    return EDITS * min(length, WINDOW) // WINDOW


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes at each position as one number."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", np.ascontiguousarray(data), 0, (1,)) if len(data) >= Q else np.zeros(0, np.uint64)


@dataclass
class ItemIndex:
    """Items one after the other, and the positions of their q-grams."""

    ids: list
    data: np.ndarray
    off: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    places: np.ndarray
    present: np.ndarray
    window: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    #: Short items by text, as the numbers of their ids.
    short: dict[bytes, list[int]]

    @classmethod
    def build(cls, items: list[tuple[object, str]]) -> ItemIndex | None:
        texts = [(i, _FOLD[np.frombuffer(t.encode(), np.uint8)]) for i, t in items if t]
        brief = [(i, t.tobytes().strip()) for i, t in texts if len(t) < LEAST_BYTES]
        texts = [(i, t) for i, t in texts if len(t) >= LEAST_BYTES]
        short: dict[bytes, list[int]] = {}
        for n, (_, t) in enumerate(brief, len(texts)):
            if t:
                short.setdefault(t, []).append(n)
        if not texts and not short:
            return None
        off = np.concatenate(([0], np.cumsum([len(t) for _, t in texts]))).astype(np.int64)
        data = np.concatenate([np.zeros(0, np.uint8), *(t for _, t in texts)])
        gram = grams(data)
        inside = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - Q + 1) for a, b in zip(off[:-1], off[1:], strict=True))])
        order = inside[np.argsort(gram[inside], kind="stable")]
        keys, first = np.unique(gram[order], return_index=True)
        present = np.zeros(1 << _TABLE_BITS, bool)
        present[cls.slots(keys)] = True
        window = np.minimum(np.diff(off), WINDOW)
        edits = np.array([edit_budget(int(n)) for n in window], np.int64)
        return cls([i for i, _ in texts] + [i for i, _ in brief], data, off, keys, np.append(first, len(order)), order, present, window, edits,
                   window + 1 - Q * (edits + 1), short)

    def short_matches(self, data: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item number) -> (first byte, end byte of the first place, 0) of the short items that rows hold as whole words."""
        if not self.short:
            return {}
        if not hasattr(self, "_automaton"):
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for text in self.short:
                self._automaton.add_word(text.decode("latin-1"), text)
            self._automaton.make_automaton()
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            text = data[lo:hi]
            for last, item in self._automaton.iter(text.tobytes().decode("latin-1")):
                a, b = last + 1 - len(item), last + 1
                inside = a and _WORD[text[a - 1]] and _WORD[text[a]] or b < len(text) and _WORD[text[b]] and _WORD[text[last]]
                if not inside:
                    for n in self.short[item]:
                        out.setdefault((row, n), (a, b, 0))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}  # each worker builds its own

    @staticmethod
    def slots(gram: np.ndarray) -> np.ndarray:
        return (gram * _SPREAD) >> np.uint64(64 - _TABLE_BITS)

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, document position, item-data position) of the q-gram hits in dense stretches."""
        none = np.zeros(0, np.int64)
        gram = grams(data)
        if not len(gram) or not len(self.window):
            return none, none, none
        hit = self.present[self.slots(gram)]
        for k in range(1, Q):  # q-grams across the end of a row
            across = off[1:-1] - k
            hit[across[(across >= 0) & (across < len(hit))]] = False
        reach, needed = int((self.window + self.edits).max()), int(self.needed.min())
        count = np.concatenate(([0], np.cumsum(hit)))
        n = len(hit)
        full = count[np.minimum(np.arange(n) + reach, n)] - count[:n] >= needed
        # Positions within `reach` after the start of a full stretch.
        starts = np.flatnonzero(full)
        if not len(starts):
            return none, none, none
        last = np.full(n, -1, np.int64)
        last[starts] = starts
        near = np.arange(n) - np.maximum.accumulate(last)
        dense = np.flatnonzero(hit & (np.maximum.accumulate(last) >= 0) & (near < reach))
        key = np.searchsorted(self.keys, gram[dense])
        real = (key < len(self.keys)) & (self.keys[np.minimum(key, len(self.keys) - 1)] == gram[dense])
        dense, key = dense[real], key[real]
        size = self.first[key + 1] - self.first[key]
        before = np.cumsum(size) - size
        place = self.places[np.arange(int(size.sum())) + np.repeat(self.first[key] - before, size)]
        where = np.repeat(dense, size)
        return np.searchsorted(off, where, "right") - 1, where, place

    def matches(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, first byte, end byte, edits) of every item that a row holds; bytes count from the row's start."""
        data = _FOLD[data]
        best = self.short_matches(data, off)
        row, where, place = self.hits(data, off)
        if not len(row):
            return [(r, i, *span) for (r, i), span in sorted(best.items())]
        item = np.searchsorted(self.off, place, "right") - 1
        # A row and item with too few hits altogether have no cell with enough.
        _, pair, count = np.unique(row * len(self.ids) + item, return_inverse=True, return_counts=True)
        enough = count[pair] >= self.needed[item]
        row, where, item, pair, place = row[enough], where[enough], item[enough], pair[enough], place[enough]
        inside = place - self.off[item]
        diagonal = (where - off[row]) - inside
        band = diagonal // (self.edits[item] + 1)
        band -= band.min(initial=0) - 1
        block = inside // self.window[item] + 1
        bands, blocks = int(band.max(initial=0)) + 1, int(block.max(initial=0)) + 1
        cells = np.concatenate([(pair * bands + band - a) * blocks + block - b for a in (0, 1) for b in (0, 1)])
        own = np.tile(np.arange(len(row)), 4)
        order = np.argsort(cells, kind="stable")
        cells, own = cells[order], own[order]
        begins = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else cells
        counts = np.diff(np.append(begins, len(cells)))
        full = counts >= self.needed[item[own[begins]]] if len(cells) else np.zeros(0, bool)
        for at, count in zip(begins[full].tolist(), counts[full].tolist(), strict=True):
            some = own[at: at + count]
            r, i = int(row[some[0]]), int(item[some[0]])
            found = self.verify(data[off[r]: off[r + 1]], i, np.unique(np.column_stack((inside[some], diagonal[some])), axis=0))
            if found:
                known = best.get((r, i))
                best[r, i] = found if known is None else (min(known[0], found[0]), max(known[1], found[1]), min(known[2], found[2]))
        return [(r, i, *span) for (r, i), span in sorted(best.items())]

    def verify(self, text: np.ndarray, i: int, hits: np.ndarray) -> tuple[int, int, int] | None:
        """First and end byte in the text, and edits, over the windows of one cell that align within the budget."""
        pattern = self.data[self.off[i]: self.off[i + 1]]
        size, budget, needed = int(self.window[i]), int(self.edits[i]), int(self.needed[i])
        positions, diagonals = hits[:, 0], hits[:, 1]
        distinct = np.unique(positions)  # an alignment's common q-grams lie at different positions of the item
        starts = np.arange(max(0, distinct[0] + Q - size), min(distinct[-1], len(pattern) - size) + 1)
        enough = np.searchsorted(distinct, starts + size - Q + 1) - np.searchsorted(distinct, starts) >= needed
        low, high = int(diagonals.min()) - budget, int(diagonals.max()) + budget
        out = None
        following = 0
        for a in starts[enough].tolist():
            if a < following:
                continue
            # An exact copy needs no alignment.
            lo, hi = np.searchsorted(positions, (a, a + size - Q + 1))
            middle = int(diagonals[(lo + hi) // 2])
            if a + middle >= 0 and text[a + middle: a + middle + size].tobytes() == pattern[a: a + size].tobytes():
                found = (a + middle, a + middle + size, 0)
            else:
                found = banded(pattern[a: a + size].tobytes(), text, a + low - SLACK, a + high + SLACK, budget + SLACK)
            if found is None or found[2] > budget:
                following = a + (SLACK + 1 if found is None else found[2] - budget)
            else:
                following = a + 4  # windows that begin up to three bytes later hold nothing new
                out = found if out is None else (min(out[0], found[0]), max(out[1], found[1]), min(out[2], found[2]))
        return out


def banded(pattern: bytes, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole pattern with a part of the text that starts at ``low``..``high``, if within the budget.

    Cells are (pattern position, diagonal) with diagonals ``low``..``high``;
    returns (first byte, end byte, edits).
    """
    n, width, far = len(text), high - low + 1, budget + 1
    body = text[max(0, low): max(0, min(n, high + len(pattern)))].tobytes()
    base = max(0, low)
    # value[d]: edits of the prefix so far ending before text position row + low + d; begin[d]: where it began.
    value = [0 if 0 <= low + d <= n else far for d in range(width)]
    begin = [low + d for d in range(width)]
    for row in range(1, len(pattern) + 1):
        byte = pattern[row - 1]
        new, came = [far] * width, begin[:]
        for d in range(width):
            end = row + low + d  # text position after the aligned part
            if not 0 <= end <= n:
                continue
            cost, source = far, begin[d]
            if end >= 1 and value[d] < far:
                cost = value[d] + (body[end - 1 - base] != byte) if 0 <= end - 1 - base < len(body) else far
            if d + 1 < width and value[d + 1] + 1 < cost:
                cost, source = value[d + 1] + 1, begin[d + 1]
            if d and new[d - 1] + 1 < cost:
                cost, source = new[d - 1] + 1, came[d - 1]
            new[d], came[d] = min(cost, far), source
        value, begin = new, came
        if min(value) >= far:
            return None
    d = min(range(width), key=value.__getitem__)
    return (begin[d], len(pattern) + low + d, value[d]) if value[d] <= budget else None


def item_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> list[ItemIndex]:
    """Indexes of the benchmark's items, each over at most about ``part_bytes`` bytes of text (or one item)."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    indexes = [ItemIndex.build([(r.id, r.t) for r in items.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == p).orderBy("id", "t").toLocalIterator()])
               for p in range(parts)]
    return [x for x in indexes if x is not None]


_FOUND = "item_id bigint, start bigint, end bigint, edits int"


def find_matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, start, end, edits): the items each row holds, and the characters from the first to the last window found."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, {_FOUND}"
    arrow_id = to_arrow_type(df.schema[id_col].dataType)
    found = None
    for index in item_parts(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(index)  # at most PART_BYTES of text

        def run(batches, shared=shared):
            index = shared.value
            for rows, data, off in text_slices(batches, text_col):
                hits = index.matches(data, off)
                if not hits:
                    continue
                ids = rows.column(rows.schema.get_field_index(id_col))
                spans = []
                for r, _, a, b, _ in hits:
                    lead = (data[off[r]: off[r] + b] & 0xC0) != 0x80
                    spans.append((int(lead[:a].sum()), int(lead.sum())))
                yield pa.record_batch([ids.take(pa.array([h[0] for h in hits])).cast(arrow_id), pa.array([index.ids[h[1]] for h in hits], pa.int64()),
                                       pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64()),
                                       pa.array([h[4] for h in hits], pa.int32())], names=[id_col, "item_id", "start", "end", "edits"])

        part = df.select(id_col, text_col).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else df.sparkSession.createDataFrame([], schema)


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no item, with all their columns and no shuffle."""
    for index in item_parts(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(index)  # at most PART_BYTES of text

        def run(batches, shared=shared):
            for rows, data, off in text_slices(batches, text_col):
                dirty = {h[0] for h in shared.value.matches(data, off)}
                yield rows.filter(pa.array([r not in dirty for r in range(len(rows))], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
