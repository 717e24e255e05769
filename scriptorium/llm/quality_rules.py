"""Quality rules by hashed n-gram log-likelihood ratios (operator 4).

Two multinomials over hashed word n-grams are counted: one over the texts of a
trusted target, one over the whole raw corpus.  A document's verdict is the
mean, over its n-grams, of log(p_target / p_raw): kept when it is at least
``THRESHOLD``.  The mean makes short and long documents comparable, and the
fixed threshold makes every verdict depend on the document and the two tables
alone: no sampling, the same at every size.  Before it come fixed rules: too
few words, or too many words in repeated windows (``base_failed``).

The counts are one partial array per task, summed by Spark by bucket; the
result has ``BUCKETS`` rows whatever the corpus, which bounds what the driver
holds and what tasks receive.

Semantics: null and empty texts have no words and fail the base rules; an
empty corpus or target leaves all ratios at 0, so the rules alone decide;
repeated rows count and are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import IS_SPACE, per_slice, row_sums, text_slices
from .wordstats import Words, repeated_lines, repeated_words, windows

BUCKETS = 1 << 16
#: Occurrences added to every bucket in the target, and to those expected of it from the raw corpus: rare buckets say little.
SMOOTHING = 8.0
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ngram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair of the slice, and its row's number."""
    pairs, first = windows(words.hashes, words.bounds, 2)
    row = np.repeat(np.arange(len(words.count)), words.count)
    buckets = np.concatenate((words.hashes, pairs)) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate((row, row[first]))


def _counter(text_col: str):
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, data, off in text_slices(batches, text_col):
            buckets, _ = ngram_buckets(Words(data, off))
            total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])
    return run


def count_buckets(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often each bucket occurs in all texts."""
    return texts.select(text_col).mapInArrow(_counter(text_col), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(raw: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """log(p_target / p_raw) of every bucket: ``BUCKETS`` numbers."""
    both = (count_buckets(target, text_col).withColumnRenamed("n", "t")
            .join(count_buckets(raw, text_col), "bucket", "full_outer").na.fill(0, ["t", "n"]))
    t, r = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in both.toLocalIterator():
        t[row.bucket], r[row.bucket] = row.t, row.n
    if not t.sum() or not r.sum():
        return np.zeros(BUCKETS, np.float32)
    return np.log((t + SMOOTHING) / (t.sum() * r / r.sum() + SMOOTHING)).astype(np.float32)


def base_counts(data: np.ndarray, off: np.ndarray, words: Words) -> list[np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of every row."""
    character = ((data & 0xC0) != 0x80) & ~IS_SPACE[data]
    return [row_sums(character, off), row_sums(_SYMBOL[data], off), repeated_lines(data, off, words.starts)[1], repeated_words(words.hashes, words.bounds)]


def judge(df: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS floats

    def columns(data, off):
        words = Words(data, off)
        counts = base_counts(data, off, words)
        buckets, row = ngram_buckets(words)
        sums = np.bincount(row, weights=shared.value[buckets], minlength=len(off) - 1)
        mean = sums / np.maximum(1, np.bincount(row, minlength=len(off) - 1))
        failed = (words.count < MIN_WORDS) | (100 * counts[3] > MAX_REPEAT_PERCENT * words.count)
        return [words.count, *counts, failed, ~failed & (mean >= threshold), mean]

    long = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    id_type = df.schema[id_col].dataType.simpleString()
    arrow = pa.schema([(id_col, _arrow_type(df, id_col)), *((c, pa.int64()) for c in long), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64())])
    return df.select(id_col, text_col).mapInArrow(per_slice(columns, id_col, text_col, arrow),
                                                  f"{id_col} {id_type}, " + ", ".join(f"{c} bigint" for c in long) + ", base_failed boolean, kept boolean, ratio double")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
