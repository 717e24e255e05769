"""Ranked lexical search by accumulator-limited term-at-a-time scoring (operator 13).

Terms are the maximal runs of ASCII letters and digits and of characters from
U+0080 on, only A-Z lower-cased.  With N texts that hold a term, L terms in all
texts, n terms in a text, df texts with a term and tf occurrences in a text,

    weight w  = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    length m  = 100 - B + (B * n * N) div L                      (B = 90)
    score     = sum over the item's terms of w * ((10**9 tf) div (1000 tf + 8 m))

The postings of a set of items: one pass over the texts writes, for each text, its
length and the numbers and frequencies of the items' terms.  N, L and df are
aggregates of that table.  A second pass over it scores: a task turns up to
``SHARD_TEXTS`` texts into a small inverted index and answers every item over it,
its terms rarest first.  A text gets an accumulator when a term reaches it.
As soon as the largest contributions that the remaining terms can make are
together below the k-th best partial score (or the k-th score of the task's
earlier shards), a text without an accumulator can no longer get into the best
k; from then on only existing accumulators are updated, exactly, with every
remaining term.  A task returns k rows an item at most, and Spark merges them.

Items are answered in parts whose distinct terms number about ``PART_TERMS``;
that bounds what the driver and the tasks hold, however many items there are.

Semantics: null and empty texts and items have no terms; a text without a term
of an item is never one of its results.  Rows are texts of their own, also with
the same id; so are item rows.  Equal scores go to the smaller document id, null
ids last.  Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

LENGTH_SHARE = 90
SHARD_TEXTS = 1 << 16
#: Distinct terms of the items that are answered in one pass over the texts, about.
PART_TERMS = 1 << 20
CHUNK_BYTES = 1 << 20
NULL_ID = (1 << 63) - 1

#: Bytes of terms stay, A-Z lower-cased; every other byte becomes a blank.  All bytes of characters from U+0080 on are above 0x7F.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))

POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def term_chunks(text: str | None):
    """Lists of the text's terms in order, about CHUNK_BYTES of text each."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def distinct_terms(text: str | None) -> list[bytes]:
    found: set[bytes] = set()
    for chunk in term_chunks(text):
        found.update(chunk)
    return sorted(found)


def _item_terms(batches):
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([distinct_terms(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], names=["item", "terms"])


def _postings(shared):
    def run(batches):
        number = shared.value.get
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, tf = 0, Counter()
                for chunk in term_chunks(text.as_py()):
                    n += len(chunk)
                    tf.update(map(number, chunk))
                tf.pop(None, 0)
                if n:
                    rows.append((doc, n, list(tf.keys()), list(tf.values())))
            if rows:
                doc, n, terms, tfs = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                                      names=["doc_id", "n", "terms", "tfs"])
    return run


def term_weight(texts: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, texts: int, total: int) -> np.ndarray:
    """m of texts with n terms."""
    if n.max(initial=0) * LENGTH_SHARE * texts < 1 << 63:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * n * texts // total
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * texts // total for x in n], np.int64)


class Shard:
    """A small inverted index with ready contributions, and the term-at-a-time search over it."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        by = np.argsort(term, kind="stable")
        self.ids, self.rows, term, tf = ids, row[by], term[by], tf[by]
        self.gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norms[self.rows]))
        found, begin, count = np.unique(term, return_index=True, return_counts=True)
        self.place = {int(t): (int(a), int(a + n)) for t, a, n in zip(found, begin, count, strict=True)}
        self.most = {t: int(self.gain[a:b].max()) for t, (a, b) in self.place.items()}
        self.total, self.held = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        self.created = self.skipped = 0  # accumulators made, postings of texts without one passed over

    def search(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the k best texts with a score above 0 and not below ``least``; ``terms`` come rarest first."""
        terms = [t for t in terms if t in self.place]
        rest = sum(self.most[t] for t in terms)
        seen, touched, kth, open_ = 0, [], max(least, 1), True
        for t in terms:
            if open_ and rest < kth:
                open_, alive = False, np.concatenate(touched) if touched else np.zeros(0, np.int64)
            a, b = self.place[t]
            rows, gain = self.rows[a:b], self.gain[a:b]
            if open_:
                fresh = rows[~self.held[rows]]
                self.held[fresh] = True
                touched.append(fresh)
                self.total[rows] += gain
                seen += self.most[t]
                # The k-th partial score only matters once it can exceed what is left.
                if rest - self.most[t] < seen:
                    alive = np.concatenate(touched)
                    if len(alive) >= k:
                        kth = max(kth, int(np.partition(self.total[alive], len(alive) - k)[len(alive) - k]))
            else:
                own = self.held[rows]
                self.total[rows[own]] += gain[own]
                self.skipped += len(rows) - int(own.sum())
            rest -= self.most[t]
        alive = np.concatenate(touched) if touched else np.zeros(0, np.int64)
        score = self.total[alive]
        good = np.flatnonzero(score >= max(least, 1))
        good = good[np.lexsort((self.ids[alive[good]], -score[good]))[:k]]
        out = score[good], self.ids[alive[good]]
        self.created += len(alive)
        self.total[alive], self.held[alive] = 0, False
        return out


def _scorer(shared, k: int):
    def run(batches):
        items, weights, texts, total = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        waiting, held = [], 0

        def answer():
            nonlocal waiting, held
            if waiting:
                ids, n, size, term, tf = (np.concatenate(x) for x in zip(*waiting, strict=True))
                shard = Shard(ids, length_norms(n, texts, total), np.repeat(np.arange(len(ids)), size), term, tf, weights)
                for i, terms in enumerate(items):
                    score, doc = best[i]
                    more, docs = shard.search(terms, k, int(score[-1]) if len(score) == k else 0)
                    if len(more):
                        score, doc = np.concatenate((score, more)), np.concatenate((doc, docs))
                        by = np.lexsort((doc, -score))[:k]
                        best[i] = score[by], doc[by]
            waiting, held = [], 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                terms, tfs = part.column(2), part.column(3)
                waiting.append((part.column(0).fill_null(NULL_ID).to_numpy(), part.column(1).to_numpy(), terms.value_lengths().to_numpy(),
                                terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
                held += part.num_rows
                if held >= SHARD_TEXTS or sum(len(x[3]) for x in waiting) >= 64 * SHARD_TEXTS:
                    answer()
        answer()
        item = np.repeat(np.arange(len(items)), [len(s) for s, _ in best])
        score, doc = (np.concatenate([x[i] for x in best]) if best else np.zeros(0, np.int64) for i in (0, 1))
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc", "score"])
    return run


def _answer_part(documents: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items given as (item_id, terms)."""
    spark = documents.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    shared = spark.sparkContext.broadcast(vocabulary)  # about PART_TERMS terms
    postings = written(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_postings(shared), POSTINGS), "postings")
    texts, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in postings.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term of the part
        frequency[row["t"]] = row["count"]
    weights = np.array([term_weight(texts, int(df)) for df in frequency], np.int64)
    numbers = [sorted((vocabulary[t] for t in terms), key=lambda t: (frequency[t], t)) for _, terms in items]
    scored = postings.mapInArrow(_scorer(spark.sparkContext.broadcast((numbers, weights, texts, total)), k), "item int, doc bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item int, item_id bigint")
    return ranked.join(names, "item").select("item_id", "rank", F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "score")


def search(documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", part_terms: int = PART_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    terms = written(items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text"))
                    .mapInArrow(_item_terms, "item bigint, terms array<binary>").where(F.size("terms") > 0), "search-items")
    parts = max(1, -(-(terms.agg(F.sum(F.size("terms"))).head()[0] or 0) // part_terms))
    part = F.pmod(F.xxhash64("item", "terms"), F.lit(parts))
    answers = []
    for p in range(parts):
        own = sorted(((r.item, [bytes(t) for t in r.terms]) for r in terms.where(part == p).collect()),  # about part_terms terms
                     key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if own:
            answers.append(_answer_part(documents, own, k, id_col, text_col))
    return reduce(DataFrame.unionByName, answers, empty)


ORACLE_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
postings AS MATERIALIZED (SELECT r, doc_id, t, count(*) AS tf FROM words GROUP BY r, doc_id, t),
lengths AS MATERIALIZED (SELECT r, sum(tf) AS n FROM postings GROUP BY r),
corpus AS MATERIALIZED (SELECT count(*) AS texts, sum(n) AS total FROM lengths),
weights AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln((2 * (SELECT texts FROM corpus) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings GROUP BY t),
asked AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
scored AS (
  SELECT i, item_id, p.r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * texts) // total))))) AS BIGINT) AS score
  FROM asked JOIN postings p USING (t) JOIN weights USING (t) JOIN lengths USING (r), corpus GROUP BY i, item_id, p.r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
