"""Quality classifier by regularised quadratic discriminants (operator 7).

Each text becomes a vector of transformed statistics (logarithms and square
roots of counts and shares, so that the classes are closer to normal).  For
each class the mean and a covariance shrunk towards the pooled covariance and
its diagonal are estimated; the Cholesky factors of the covariances are
computed once.  A text's score is the logistic function of

    log N(x; mean1, cov1) - log N(x; mean0, cov0) + log prior odds,

with the Mahalanobis terms from products with the cached inverse factors.

Fitting reads at most ``MAX_LABELLED`` labelled rows, those of the smallest
hash of their id (a documented bound; scoring reads every row).  Their ids are
broadcast, which that bound allows; the sums over vectors are Spark aggregates
of a fixed number of rows.

Semantics: null and empty texts have the vector of zero counts and get a score
like any other; repeated rows are scored one by one; rows without a label only
get scores.  Without labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import IS_SPACE, per_slice, row_sums, text_slices
from .wordstats import Words, distinct_per_row, repeated_lines, repeated_words

MAX_LABELLED = 20_000
#: Shares of the pooled covariance, and of the diagonal, in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.10, 0.10
FLOOR = 1e-4
#: log-density differences beyond this are as good as certain.
CLIP = 60.0
THRESHOLD = 0.7

STATISTICS = ("word_length", "capitals", "digits", "symbols", "marks", "repeats", "same_lines", "variety", "line_length", "pipes", "shouts")

_CLASSES = np.zeros((5, 256), bool)
_CLASSES[0, 65:91] = True                                            # capitals
_CLASSES[1, 48:58] = True                                            # digits
_CLASSES[2, list(b"#*$%&<>@^~=+\\/{}[]_")] = True                    # symbols
_CLASSES[3, list(b".,;:?\"'()-")] = True                             # marks of punctuation
_CLASSES[4, list(b"|")] = True


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text."""
    words = Words(data, off)
    n = words.count.astype(float)
    characters = row_sums(((data & 0xC0) != 0x80) & ~IS_SPACE[data], off)
    capitals, digits, symbols, marks, pipes = (row_sums(c[data], off) for c in _CLASSES)
    shouts = row_sums(data == 0x21, off)
    repeats = repeated_words(words.hashes, words.bounds)
    lines, same = repeated_lines(data, off, words.starts)
    variety = distinct_per_row(words.hashes, words.bounds)
    # Shares of short texts are pulled towards those of plain prose by a few words, characters and lines added to the counts.
    n_, chars_, lines_ = n + 20, characters + 110, lines + 4
    return np.column_stack((
        np.log1p(chars_ / n_),
        np.sqrt(capitals / chars_),
        np.sqrt(digits / chars_),
        np.sqrt(symbols / chars_),
        np.sqrt((marks + 4) / chars_),
        np.sqrt(repeats / n_),
        np.sqrt(same / lines_),
        np.log1p(variety + 20) / np.log1p(n_),
        np.log1p(n_ / lines_),
        np.sqrt(pipes / chars_),
        np.sqrt(shouts / chars_),
    ))


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of the two classes, and the constant of the difference."""

    means: np.ndarray
    factors: np.ndarray
    constant: float

    @classmethod
    def fit(cls, count: np.ndarray, total: np.ndarray, square: np.ndarray) -> Discriminant | None:
        """From each class's count, sum of vectors and sum of outer products."""
        if (count < 2).any():
            return None
        means = total / count[:, None]
        covariance = square / count[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (covariance * count[:, None, None]).sum(0) / count.sum()
        factors, constant = [], float(np.log(count[1] / count[0]))
        for k in (0, 1):
            own = (1 - TO_POOLED) * covariance[k] + TO_POOLED * pooled
            own = (1 - TO_DIAGONAL) * own + TO_DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(len(own))
            lower = np.linalg.cholesky(own)
            factors.append(np.linalg.inv(lower))
            constant += (1, -1)[k] * float(np.log(np.diag(lower)).sum())
        return cls(means, np.array(factors), constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        far = [(((x - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.constant + (far[0] - far[1]) / 2, -CLIP, CLIP)))


def _sums(label_col: str, text_col: str):
    """Per task and class: count, sums and outer products, as (class, place, value) rows."""
    def run(batches):
        d = len(STATISTICS)
        total = np.zeros((2, 1 + d + d * d))
        for rows, data, off in text_slices(batches, text_col):
            x = statistics(data, off)
            label = rows.column(rows.schema.get_field_index(label_col)).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        k, place = np.nonzero(total)
        yield pa.record_batch([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(total[k, place], pa.float64())], names=["k", "place", "value"])
    return run


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED) -> Discriminant | None:
    """Fit on the texts of labelled rows (label 0 or 1), at most ``max_labelled`` of them.

    An id with several labels takes the more frequent one, and none if they are equally frequent.
    """
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
              .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
              .groupBy("_id").agg(F.avg("_label").alias("_share")).where("_share <> 0.5").select("_id", F.round("_share").cast("int").alias("_label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_label")
    sums = rows.mapInArrow(_sums("_label", "_text"), "k int, place int, value double").groupBy("k", "place").agg(F.sum("value").alias("value"))
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # at most 2 * (1 + d + d * d) rows
        total[r.k, r.place] = r.value
    return Discriminant.fit(total[:, 0], total[:, 1: 1 + d], total[:, 1 + d:].reshape(2, d, d))


def classify(df: DataFrame, model: Discriminant | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``df`` with ``score`` and ``predicted`` after its id: (id, score, predicted)."""
    from pyspark.sql.pandas.types import to_arrow_type

    def columns(data, off):
        score = model.score(statistics(data, off)) if model else np.full(len(off) - 1, 0.5)
        return [score, (score >= threshold).astype(np.int32)]

    schema = pa.schema([(id_col, to_arrow_type(df.schema[id_col].dataType)), ("score", pa.float64()), ("predicted", pa.int32())])
    return df.select(id_col, text_col).mapInArrow(per_slice(columns, id_col, text_col, schema),
                                                  f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double, predicted int")


def keep_good(df: DataFrame, model: Discriminant | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that the model accepts, with all their columns and no shuffle."""
    def run(batches):
        for rows, data, off in text_slices(batches, text_col):
            good = model.score(statistics(data, off)) >= threshold if model else np.ones(len(rows), bool)
            yield rows.filter(pa.array(good))
    return df.mapInArrow(run, df.schema)
