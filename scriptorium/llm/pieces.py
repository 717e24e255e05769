"""Splitting of texts for byte-level BPE and the tokens of the pieces.

:func:`piece_starts` finds, without a regex engine, the matches of the public
pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

for a whole slice of texts at once: runs of one character class, a single
space joined to the run after it, the last of several spaces split off, and
contractions after an apostrophe that stands alone.

:class:`PieceTokens` keeps the ids of the pieces a worker has met, so that only
pieces new to it are merged.  It forgets everything when it is full, which
bounds its memory and never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .batches import span_hashes

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_CLASS: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """Class of every code point, built once per worker.

    Python's own tables belong to another version of Unicode than those of the
    libraries, which know more letters.  So the library is asked: an encoding
    whose pattern is one class returns the bytes of that class and skips the rest.
    """
    global _CLASS
    if _CLASS is None:
        import tiktoken

        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            found = bytes(probe.encode_ordinary(every)).decode()
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _CLASS = table
    return _CLASS


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each character of valid UTF-8, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.int32)
    for lowest, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        long = np.flatnonzero((lead >= lowest) & (lead < {1: 0xE0, 2: 0xF0, 3: 0xF8}[more]))
        if len(long):
            value = lead[long].astype(np.int32) & keep
            for k in range(1, more + 1):
                value = (value << 6) | (data[at[long] + k] & 0x3F)
            points[long] = value
    return at, points


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern's matches begin; each ends where the next begins or its text ends."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, points = code_points(data)
    kind = character_classes()[points]
    n = len(at)
    fresh = np.zeros(n + 1, bool)  # characters that begin a text; the end counts as one
    fresh[np.searchsorted(at, off)] = True
    fresh[n] = True
    run = fresh.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    begins = run[:n].copy()
    # A white-space run followed by something in its text gives up its last character ...
    after = np.flatnonzero(run[:n] & (kind != SPACE) & ~fresh[:n])
    after = after[kind[after - 1] == SPACE]
    begins[after - 1] = True
    # ... which belongs to what follows if it is a blank.
    begins[after[points[after - 1] == 0x20]] = False
    # Contractions: an apostrophe alone at a start, before one of the fixed endings.
    quote = np.flatnonzero((points == 0x27) & begins & run[:n] & run[1:])
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        second = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], points[second], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for ending in ("re", "ve", "ll"):
            size = np.where((one == ord(ending[0])) & (two == ord(ending[1])), 2, size)
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        rest = quote + 1 + size
        begins[rest[rest < n]] = True
    return at[begins]


class PieceTokens:
    """Ids of pieces, filled by ``encode(list of bytes) -> list of id sequences``."""

    def __init__(self, encode: Callable[[list[bytes]], list], pieces: int = 1_000_000):
        self.encode, self.most, self.seed = encode, pieces, 0
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks, self.first, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice in order, and where each row's ids begin (rows + 1)."""
        starts = piece_starts(data, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(data))
        checks = span_hashes(data, starts, ends, seed=-1)
        while True:
            hashes, example, inverse = np.unique(span_hashes(data, starts, ends, seed=self.seed), return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, hashes)
            inside = np.flatnonzero(place < len(self.keys))
            met = inside[self.keys[place[inside]] == hashes[inside]]
            # A piece is known if two independent hashes say so; pieces that agree in one alone get other hashes, and the memory starts anew.
            if (checks[example][inverse] == checks).all() and (self.checks[place[met]] == checks[example[met]]).all():
                break
            self.seed += 1
            self.forget()
        if len(self.keys) + len(hashes) > self.most:
            self.forget()
        place = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != hashes[inside]
        if new.any():
            found = self.encode([data[starts[j]: ends[j]].tobytes() for j in example[new]])
            size = np.fromiter(map(len, found), np.int32, len(found))
            self.first = np.insert(self.first, place[new], len(self.ids) + np.cumsum(size) - size)
            self.size = np.insert(self.size, place[new], size)
            self.keys = np.insert(self.keys, place[new], hashes[new])
            self.checks = np.insert(self.checks, place[new], checks[example[new]])
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))))
            place = np.searchsorted(self.keys, hashes)
        each = place[inverse]
        size = self.size[each].astype(np.int64)
        before = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.ids[np.arange(total) + np.repeat(self.first[each] - before, size)]
        piece_of_row = np.searchsorted(starts, off)
        return ids, np.append(before, total)[piece_of_row]
