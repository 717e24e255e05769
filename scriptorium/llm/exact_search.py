"""Exact top-k search by inner product with block-at-a-time pruning (operator 12).

Components are scaled to integers.  The dimensions are the terms, a vector's
integers their weights.  Vectors are put in an order that keeps similar ones
together and cut into consecutive *blocks*; a block has a forward index (its
vectors) and, per dimension, the largest and smallest weight in it.  A query's
bound of a block is the sum over the dimensions of its own weight times the
block's maximum (the minimum where its weight is negative): no vector of the
block scores more.  A query takes the blocks in descending order of the bounds
and scores them through their forward index until the next bound is below
its k-th score.

On Spark.  Equal vectors are one *class* that carries its smallest ids only,
more than k of one class can never be returned; this takes the copies of a
frequent vector out before anything is compared.  Classes lie in *groups* of
blocks (ranges of the order, one task's memory each).  A first job searches
every query's own group and gives its first k-th score; a second brings the
queries, with that score, to all other groups.  Rows of a group arrive blocks
first, then its queries as a stream, so a task holds one group and
``CHUNK`` queries.  Neither queries nor vectors pass through the driver; it
holds ``PIVOTS`` vectors that fix the order, which affects the speed alone.

Semantics: vectors that are null or hold null or non-finite components take no
part; a shorter vector counts as filled with zeros.  A row is never compared
with itself; other rows with its id, and repeated rows, are candidates like any
other.  Equal scores go to the smaller id, null ids last; a null id is no query.
Scores have to fit 64 bits.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .vector_codes import usable

SCALE = 256
BLOCK, CHUNK, PIVOTS = 128, 512, 64
#: Vectors of a group: at least and at most; in between every task of the cluster gets one.
GROUP = (4096, 262_144)
#: Queries that meet a group in one task.
QUERY_SLICE = 65_536
NULL_ID = (1 << 63) - 1


def exact_kind(reach: int) -> type:
    """The fastest number type in which every sum up to ``reach`` is exact."""
    if reach >= 1 << 63:
        raise OverflowError("scores do not fit 64 bits")
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integers of a list column, short lists filled with zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return out


class BlockIndex:
    """Forward indexes and term maxima of a group's blocks, and the search over them."""

    def __init__(self, vectors: np.ndarray, blocks: np.ndarray, ids: np.ndarray, id_bounds: np.ndarray):
        """``vectors`` by block; row i stands for the ids ``ids[id_bounds[i]: id_bounds[i + 1]]``."""
        self.vectors, self.ids, self.id_bounds = vectors, ids, id_bounds
        self.starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        self.ends = np.append(self.starts[1:], len(vectors))
        self.maxima, self.minima = np.maximum.reduceat(vectors, self.starts), np.minimum.reduceat(vectors, self.starts)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.scored = 0  # (query, block) pairs whose vectors were scored
        self.forward: dict = {}

    def in_kind(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, maxima and minima as numbers of one type, converted once."""
        if kind not in self.forward:
            self.forward = {kind: tuple(x.astype(kind) for x in (self.vectors, self.maxima, self.minima))}
        return self.forward[kind]

    def search(self, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, score, id) of each query's k best, ties to smaller ids; scores below ``least`` may be left out."""
        kind = exact_kind(queries.shape[1] * self.largest * int(np.abs(queries).max(initial=0)))
        forward, maxima, minima = self.in_kind(kind)
        q = queries.astype(kind)
        bounds = (np.maximum(q, 0) @ maxima.T + np.minimum(q, 0) @ minima.T).astype(np.int64)
        order = np.argsort(-bounds, axis=1, kind="stable")
        ordered = np.take_along_axis(bounds, order, 1)
        floor = least.astype(np.int64).copy()
        best = (np.zeros(0, np.int64),) * 3
        lo, step, n = 0, 1, len(self.starts)
        while lo < n:
            hi = min(n, lo + step)
            which, place = np.nonzero(ordered[:, lo:hi] >= floor[:, None])
            if not len(which):
                break  # the next bounds are lower still
            block = order[which, lo + place]
            best = self._score(q, forward, which, block, floor, best, k)
            lo, step = hi, step * 2
        return best

    def _score(self, q, forward, which, block, floor, best, k):
        """Scores the (query, block) pairs and merges what may count into ``best``; raises ``floor``."""
        by_block = np.argsort(block, kind="stable")
        which, block = which[by_block], block[by_block]
        cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        found = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            lo, hi, own = self.starts[block[a]], self.ends[block[a]], which[a:b]
            scores = (q[own] @ forward[lo:hi].T).astype(np.int64)
            self.scored += b - a
            least = floor[own]
            if hi - lo > k:
                least = np.maximum(least, np.partition(scores, hi - lo - k, axis=1)[:, hi - lo - k])
            i, j = np.nonzero(scores >= least[:, None])
            found.append((own[i], scores[i, j], lo + j))
        query, score, row = (np.concatenate(x) for x in zip(*found, strict=True))
        size = self.id_bounds[row + 1] - self.id_bounds[row]
        first = np.cumsum(size) - size
        ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.id_bounds[row] - first, size)]
        query, score, ids = (np.concatenate(x) for x in zip(best, (np.repeat(query, size), np.repeat(score, size), ids), strict=True))
        by = np.lexsort((ids, -score, query))
        query, score, ids = query[by], score[by], ids[by]
        begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        full = np.flatnonzero(rank == k - 1)
        floor[query[full]] = np.maximum(floor[query[full]], score[full])
        keep = rank < k
        return query[keep], score[keep], ids[keep]


def _searcher(width: int, k: int):
    """Rows (cell, query, block, vec, ids, least) of a cell: the group's classes by block, then its queries."""
    def run(batches):
        cell, rows, index, waiting = None, [], None, []

        def flush():
            nonlocal waiting
            if waiting and index is not None:
                number, vectors, least = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for lo in range(0, len(number), CHUNK):
                    q, score, ids = index.search(vectors[lo: lo + CHUNK], least[lo: lo + CHUNK], k)
                    yield pa.record_batch([pa.array(number[lo + q], pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64())],
                                          names=["query", "score", "id"])
            waiting = []

        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            queries = batch.column(1)
            isq = pc.is_valid(queries).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((cells[1:] != cells[:-1]) | (isq[1:] != isq[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if cells[lo] != cell:
                    yield from flush()
                    cell, rows, index = cells[lo], [], None
                vectors = matrix(part.column(3), width)
                if not isq[lo]:
                    ids = part.column(4)
                    rows.append((vectors, part.column(2).to_numpy(), pc.list_flatten(ids).to_numpy(), pc.list_value_length(ids).to_numpy()))
                    continue
                if index is None and rows:
                    vecs, block, ids, size = (np.concatenate(x) for x in zip(*rows, strict=True))
                    index, rows = BlockIndex(vecs, block, ids, np.append(0, np.cumsum(size, dtype=np.int64))), []
                waiting.append((part.column(1).to_numpy(zero_copy_only=False).astype(np.int64), vectors, part.column(5).to_numpy(zero_copy_only=False)))
                if sum(len(x[0]) for x in waiting) >= CHUNK:
                    yield from flush()
        yield from flush()
    return run


def _cells(pivots: np.ndarray, width: int):
    """Adds the two nearest pivots to every class; they only order the classes."""
    def run(batches):
        half = (pivots * pivots).sum(1) / 2
        for batch in batches:
            near = np.argsort(half - matrix(batch.column(0), width).astype(np.float64) @ pivots.T, axis=1, kind="stable")[:, :2]
            yield pa.record_batch([*batch.columns, pa.array(near[:, 0], pa.int32()), pa.array(near[:, -1], pa.int32())],
                                  names=[*batch.schema.names, "near", "next"])
    return run


def _numbered(batches):
    """Adds group and block to classes that arrive in order; a query is numbered by its place."""
    group, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(at, at + batch.num_rows)
        at += batch.num_rows
        number = (np.int64(group) << 40) + place
        yield pa.record_batch([*batch.columns[:3], pa.array(np.full(batch.num_rows, group), pa.int64()), pa.array(place // BLOCK, pa.int64()), pa.array(number, pa.int64())],
                              names=["vec", "ids", "asks", "group", "block", "number"])


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids, asks): every distinct vector, its k smallest ids, whether a query has it."""
    order = Window.partitionBy("vec").orderBy("id")
    # row_number with a limit: Spark keeps k rows of a vector in each task before the shuffle.
    smallest = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("vec", "id", F.lit(False).alias("asks"))
    asking = rows.where("asks").select("vec").distinct().select("vec", F.lit(None).cast("bigint").alias("id"), F.lit(True).alias("asks"))
    return (smallest.unionByName(asking).groupBy("vec")
            .agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("asks").alias("asks")))


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): for every row that ``is_query`` (a condition on the id column ``id``) its k best other rows."""
    spark, more = df.sparkSession, k + 1  # its own row may be among the best of a query
    ids = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))
    rows = df.where(usable(F.col(vec_col))).select(
        ids.alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vec"))
    rows = rows.withColumn("asks", F.coalesce(is_query & (F.col("id") != NULL_ID), F.lit(False)))
    classes = written(classes_of(rows, more), "search-classes")
    n, asking, width = classes.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vec"))).head()
    width = width or 1
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(-(-n // GROUP[1]), min(tasks, -(-n // GROUP[0])), 1)
    slices = max(1, -(-asking // QUERY_SLICE))

    seeds = classes.orderBy(F.xxhash64("vec"), "vec").limit(PIVOTS).select("vec").toArrow()
    pivots = matrix(seeds.column(0).combine_chunks(), width).astype(np.float64) if seeds.num_rows else np.zeros((1, width))
    order = ["near", "next", F.xxhash64("vec"), "vec"]
    placed = classes.mapInArrow(_cells(pivots, width), "vec array<bigint>, ids array<bigint>, asks boolean, near int, next int")
    index = written(placed.repartitionByRange(groups, *order).sortWithinPartitions(*order).select("vec", "ids", "asks")
                    .mapInArrow(_numbered, "vec array<bigint>, ids array<bigint>, asks boolean, group bigint, block bigint, number bigint"), "search-index")

    none = F.lit(None).cast("bigint")
    held = index.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "group", none.alias("query"), "block", "vec", "ids", none.alias("least"))
    queries = index.where("asks").select((F.pmod(F.xxhash64("number"), F.lit(slices))).cast("int").alias("slice"), F.col("group").alias("home"), F.col("number").alias("query"), "vec")

    def searched(asked: DataFrame) -> DataFrame:
        """(query, score, id) from (slice, group, query, vec, least)."""
        ask = asked.select("slice", "group", "query", none.alias("block"), "vec", F.lit(None).cast("array<bigint>").alias("ids"), "least")
        both = held.unionByName(ask).withColumn("cell", F.col("group") * slices + F.col("slice"))
        return (both.select("cell", "query", "block", "vec", "ids", "least")
                .repartition(max(groups * slices, tasks), "cell").sortWithinPartitions("cell", F.col("query").asc_nulls_first(), "block")
                .mapInArrow(_searcher(width, more), "query bigint, score bigint, id bigint"))

    lowest = F.lit(-(1 << 63))
    at_home = written(searched(queries.select("slice", F.col("home").alias("group"), "query", "vec", lowest.alias("least"))), "search-home")
    reached = at_home.groupBy("query").agg(F.when(F.count(F.lit(1)) >= more, F.min("score")).alias("least"))
    elsewhere = (queries.join(reached, "query", "left")
                 .select("slice", "home", "query", "vec", F.coalesce("least", lowest).alias("least"),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"))
                 .where("group <> home"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    lists = (at_home.unionByName(searched(elsewhere)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= more)
             .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id"))).alias("found")))
    answers = queries.select("query", "vec").join(lists, "query").select("vec", "found")
    own = F.aggregate(F.transform("vec", lambda x: x * x), F.lit(0).cast("bigint"), lambda a, x: a + x)
    asked = rows.where("asks").select(F.col("id").alias("query_id"), "vec").join(answers, "vec").select(
        "query_id", F.transform("found", lambda x: F.struct(x.score.alias("score"), x.id.alias("id"))).alias("found"), own.alias("own"))
    mine = F.array_position("found", F.struct(F.col("own").alias("score"), F.col("query_id").alias("id")))
    others = asked.select("query_id", F.slice(F.filter("found", lambda x, i: (i + 1) != mine), 1, k).alias("found"))
    return (others.select("query_id", F.posexplode("found").alias("rank", "hit"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"),
                    F.when(F.col("hit.id") != NULL_ID, F.col("hit.id")).alias(id_col), F.col("hit.score").alias("score")))


ORACLE_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
