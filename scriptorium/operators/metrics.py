"""Corpus metrics (AGG-1..9, AGG-11, AGG-12, AGG-15, AGG-21) as aggregate columns.

Every metric is a ratio of sums or a moment of per-row parts computed by
``scores.score_parts``, so all of them run in one aggregate.  Spark plans
``partial -> exchange(single) -> final``: the shuffle carries one small
buffer per task, whatever the data size.  ``median`` is exact; its buffer is
a value->count map, bounded by the number of distinct integer distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def cer(ed_norm: str = "ed_norm", ref_len: str = "ref_norm_len") -> Column:
    """AGG-1: micro-averaged CER, 0 when the reference total is 0."""
    return _ratio(F.sum(ed_norm), F.sum(ref_len))


def wer_reference(ed_norm: str = "ed_norm", ref_words: str = "ref_words") -> Column:
    """AGG-2: character distance of the normalised texts over reference words."""
    return _ratio(F.sum(ed_norm), F.sum(ref_words))


def wer_standard(word_ed: str = "word_ed", ref_words: str = "ref_words") -> Column:
    """AGG-15: word-level edit distance over reference words."""
    return _ratio(F.sum(word_ed), F.sum(ref_words))


def exact_match_rate(exact: str = "exact") -> Column:
    """AGG-5: share of exact matches, 0 on empty input."""
    return _ratio(F.count_if(F.col(exact)), F.count(F.lit(1)))


def char_accuracy_padded() -> Column:
    """AGG-6."""
    return _ratio(F.sum("pad_match"), F.sum("char_total"))


def char_accuracy_truncated() -> Column:
    """AGG-7."""
    return _ratio(F.sum("trunc_match"), F.sum("char_total"))


def word_accuracy() -> Column:
    """AGG-8."""
    return _ratio(F.sum("word_match"), F.sum("word_total"))


def evaluation_columns(bleu: bool = True) -> list[Column]:
    """AGG-21: the evaluator's metric set as aggregate columns."""
    cols = [
        cer().alias("character_error_rate"),
        wer_reference().alias("word_error_rate"),
    ]
    if bleu:
        cols += [F.avg("bleu_score").alias("bleu_score_mean"),
                 F.stddev_pop("bleu_score").alias("bleu_score_std")]
    cols += [
        exact_match_rate().alias("exact_match_accuracy"),
        char_accuracy_padded().alias("character_accuracy"),
        char_accuracy_truncated().alias("character_accuracy_truncated"),
        word_accuracy().alias("word_accuracy"),
        F.avg(F.col("ed").cast("double")).alias("edit_distance_mean"),
        F.stddev_pop(F.col("ed").cast("double")).alias("edit_distance_std"),
        F.median(F.col("ed").cast("double")).alias("edit_distance_median"),
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("exact")).alias("exact_matches"),
    ]
    return cols


def evaluate(parts: DataFrame, by: list[str] | None = None, rollup: bool = False,
             bleu: bool = True) -> DataFrame:
    """One-pass evaluation report over a ``score_parts`` table."""
    cols = evaluation_columns(bleu)
    if not by:
        return parts.agg(*cols)
    grouped = parts.rollup(*by) if rollup else parts.groupBy(*by)
    return grouped.agg(*cols)


def dataset_profile(df: DataFrame, cols=("ocr_prediction", "text")) -> DataFrame:
    """AGG-12 + PRJ-2 count: rows, mean length per column (NULL skipped), rows with a NULL."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for c in cols:
        aggs.append(F.avg(F.length(c).cast("double")).alias(f"avg_len_{c}"))
    aggs.append(F.count_if(F.greatest(*[F.col(c).isNull() for c in cols])).alias("rows_with_null"))
    return df.agg(*aggs)
