"""Byte-level BPE encoding and decoding (operator 3).

A segment tree over the byte positions of a piece stores, at its root, the
leftmost pair of the lowest rank.  Merging that pair changes three leaves: the
pair that disappears, and those of the live neighbours on both sides; each
change is carried up the tree, so a piece of n bytes takes O(n log n).

Pieces of up to ``FOREST_BYTES`` bytes are merged many at a time: their trees
are the rows of one array and every step below handles all trees that still
have a pair.  Longer pieces use the same tree one at a time.

Semantics: ``ids`` are those of the ranks' own encoder without special tokens;
a special token's text is ordinary text.  Null and empty texts have no ids.
Rows are independent: repeated rows and repeated ids give repeated rows.
Decoding returns the bytes of the ids; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import text_slices
from .pieces import PieceTokens

FOREST_BYTES = 64
NONE = np.int32(1 << 30)


class Ranks:
    """A vocabulary of ranks: bytes of each id, and the id that each mergeable pair of ids becomes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.longest = max(map(len, self.rank))
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        merged = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    merged[left << 32 | right] = rank
        self.keys = np.array(sorted(merged), np.int64)
        self.becomes = np.array([merged[k] for k in self.keys.tolist()], np.int32)
        self.decimal = [str(i).encode() for i in range(len(self.token))]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.becomes[at], NONE)

    def encode(self, pieces: list[bytes]) -> list:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > FOREST_BYTES:
                out[i] = self.merge_one(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, where in by_width.items():
            for lo in range(0, len(where), 16384):
                some = where[lo: lo + 16384]
                for i, ids in zip(some, self.merge_forest([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece by its own tree: a leaf holds (rank, position) of the pair that begins there."""
        n, rank, longest = len(piece), self.rank, self.longest
        leaves = 1 << (n - 1).bit_length()
        none = 1 << 62
        tree = [none] * (2 * leaves)
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(at: int, end: int) -> None:
            found = rank.get(piece[at:end]) if end - at <= longest else None
            node = leaves + at
            tree[node] = none if found is None else found << 32 | at
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for at in range(n - 1):
            found = rank.get(piece[at: at + 2])
            tree[leaves + at] = none if found is None else found << 32 | at
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            at = tree[1] & 0xFFFFFFFF
            gone = after[at]
            end = after[at] = after[gone]
            put(gone, gone + longest + 1)  # too long for a rank: the leaf is empty
            if end < n:
                before[end] = at
                put(at, after[end])
            else:
                put(at, at + longest + 1)
            if before[at] >= 0:
                put(before[at], end)
        ids, at = [], 0
        while at < n:
            ids.append(rank[piece[at: after[at]]])
            at = after[at]
        return ids

    def merge_forest(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes (a power of two), all trees at once."""
        n, bits = len(pieces), width.bit_length() - 1
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(width)
        live = column < sizes[:, None]
        ids = np.zeros((n, width + 1), np.int32)
        ids[:, :width][live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((n, 2 * width), NONE, np.int32)
        pairs = live[:, 1:]
        ranks = self.pair(ids[:, : width - 1][pairs], ids[:, 1:width][pairs])
        tree[:, width: 2 * width - 1][pairs] = np.where(ranks < NONE, ranks << bits | np.broadcast_to(column[:-1], pairs.shape)[pairs], NONE)
        for level in range(bits - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low: 2 * high: 2], tree[:, 2 * low + 1: 2 * high: 2])
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int16), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int16), (n, width + 1)).copy()
        # Flat views: row r begins at r * (row length).
        flat, following, preceding, id_at, alive = tree.reshape(-1), after.reshape(-1), before.reshape(-1), ids.reshape(-1), live.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < NONE)

        def put(rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
            base, node = rows * (2 * width), at + width
            flat[base + node] = np.where(ranks < NONE, ranks << bits | at, NONE).astype(np.int32)
            for _ in range(bits):
                node = node >> 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])

        while len(rows):
            best = flat[rows * (2 * width) + 1].astype(np.int64)
            at, line = best & (width - 1), rows * (width + 1)
            gone = following[line + at].astype(np.int64)
            end = following[line + gone].astype(np.int64)
            id_at[line + at] = best >> bits
            following[line + at] = end
            preceding[line + end] = at
            alive[rows * width + gone] = False
            put(rows, gone, np.full(len(rows), NONE))
            more = end < sizes[rows]
            put(rows, at, np.where(more, self.pair(id_at[line + at], id_at[line + end]), NONE))
            prior = preceding[line + at].astype(np.int64)
            has = prior >= 0
            put(rows[has], prior[has], self.pair(id_at[(line + prior)[has]], id_at[(line + at)[has]]))
            rows = rows[flat[rows * (2 * width) + 1] < NONE]
        return np.split(ids[:, :width][live], np.cumsum(live.sum(1))[:-1])


@lru_cache(maxsize=4)
def worker_ranks(path: str) -> tuple[Ranks, PieceTokens]:
    """The vocabulary and the pieces met so far, kept by the worker between tasks."""
    ranks = Ranks(path)
    return ranks, PieceTokens(ranks.encode)


def encode_rows(path: str, id_col: str, text_col: str):
    """Arrow batches -> (id, ids of the text as an array) batches."""
    def run(batches):
        _, tokens = worker_ranks(path)
        for rows, data, off in text_slices(batches, text_col):
            ids, bounds = tokens(data, off)
            yield pa.record_batch([rows.column(rows.schema.get_field_index(id_col)),
                                   pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))],
                                  names=[id_col, "token_ids"])
    return run


def decode_rows(path: str, id_col: str):
    """Batches of :func:`encode_rows` -> the same with the decoded bytes."""
    def run(batches):
        ranks, _ = worker_ranks(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("token_ids"))
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            decoded = [b"".join(map(ranks.token.__getitem__, flat[lo:hi].tolist())) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch([batch.column(batch.schema.get_field_index(id_col)), lists, pa.array(decoded, pa.binary())],
                                  names=[id_col, "token_ids", "decoded"])
    return run


def _digests(path: str, id_col: str):
    def run(batches):
        ranks, _ = worker_ranks(path)
        for batch in batches:
            lists = batch.column(1)
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ids = [hashlib.sha256(b",".join(map(ranks.decimal.__getitem__, flat[lo:hi].tolist()))).hexdigest()
                   for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            texts = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(ids), pa.array(texts)],
                                  names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every row."""
    return df.select(id_col, text_col).mapInArrow(encode_rows(path, id_col, text_col), f"{id_col} {_id_type(df, id_col)}, token_ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids, decoded binary) of rows of :func:`encode`."""
    def some(batches):
        yield from decode_rows(path, id_col)(_whole(b) for b in batches)
    return encoded.select(id_col, "token_ids").mapInArrow(some, f"{id_col} {_id_type(encoded, id_col)}, token_ids array<int>, decoded binary")


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its list column rebuilt: null lists empty, offsets from 0."""
    lists = batch.column(batch.schema.get_field_index("token_ids"))
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    flat = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lists.flatten().cast(pa.int32()))
    return pa.record_batch([batch.column(0), flat], names=batch.schema.names[:2])


def encode_and_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded binary) of every row, in one pass with one Python worker per task."""
    first, second = encode_rows(path, id_col, text_col), decode_rows(path, id_col)
    return df.select(id_col, text_col).mapInArrow(lambda it: second(first(it)),
                                                  f"{id_col} {_id_type(df, id_col)}, token_ids array<int>, decoded binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row in one pass; (id, n_tokens, ids_sha256, decoded_sha256)."""
    first, second, third = encode_rows(path, id_col, text_col), decode_rows(path, id_col), _digests(path, id_col)
    return df.select(id_col, text_col).mapInArrow(lambda it: third(second(first(it))),
                                                  f"{id_col} {_id_type(df, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
