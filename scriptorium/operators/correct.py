"""Learned correction (MOD-1, MOD-2, MOD-3, JOI-3).

MOD-2, lexicon corrector: from aligned (OCR, verified) lines with the same
word count, count every (ocr_word, text_word) pair, keep for each OCR word
its most frequent reading (ties: smallest text word) when seen at least
``min_support`` times and different from the OCR word.  Both aggregations
combine map-side first, so a very frequent word (a third of all rows)
reaches the shuffle as one partial count per task.

JOI-3, apply: the distinct words of each line are joined to the lexicon
(whitespace never is), the hits of a line become a map, and the line is
rebuilt in its row.  The join is left to AQE: it becomes a broadcast hash join
when the lexicon's measured size is under the broadcast threshold and stays
a sort-merge join (with skew splitting) beyond it.

MOD-1, corrector seam: ``correct(df, corrector)`` accepts a DataFrame ->
DataFrame function (e.g. the lexicon) or a :class:`BatchCorrector`, a model
loaded once per task and run through ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chars, word_and_space_runs as tokens, words


def word_pairs(pairs: DataFrame, ocr: str = "ocr_prediction", truth: str = "text") -> DataFrame:
    """Aligned word pairs of lines whose word counts agree."""
    # The condition stands inside the explode: as a filter it would be pushed below the words and find them again.
    aligned = F.when(F.size("_wo") == F.size("_wt"), F.arrays_zip(F.col("_wo").alias("ocr_word"), F.col("_wt").alias("text_word")))
    return (pairs.select(words(ocr).alias("_wo"), words(truth).alias("_wt")).select(F.explode(aligned).alias("p"))
            .select("p.ocr_word", "p.text_word"))


def pair_counts(pairs: DataFrame, ocr: str = "ocr_prediction", truth: str = "text") -> DataFrame:
    """(ocr_word, text_word, n): aligned word pairs, counted."""
    return word_pairs(pairs, ocr, truth).groupBy("ocr_word", "text_word").agg(F.count(F.lit(1)).alias("n"))


def learn_lexicon(pairs: DataFrame, ocr: str = "ocr_prediction", truth: str = "text",
                  min_support: int = 2) -> DataFrame:
    """MOD-2: (ocr_word, text_word, support, seen) - best reading per OCR word."""
    return lexicon_of(pair_counts(pairs, ocr, truth), min_support)


def lexicon_of(counts: DataFrame, min_support: int = 2) -> DataFrame:
    """MOD-2 from :func:`pair_counts`."""
    best = counts.groupBy("ocr_word").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("text_word").alias("w"))).alias("b"),
        F.sum("n").alias("seen"))
    return (best.select("ocr_word", F.col("b.w").alias("text_word"), (-F.col("b.neg")).alias("support"), "seen")
            .where((F.col("support") >= min_support) & (F.col("text_word") != F.col("ocr_word"))))


def apply_lexicon(lines: DataFrame, lexicon: DataFrame, key=("page_id", "line_number"),
                  src: str = "ocr_prediction", out: str = "prediction") -> DataFrame:
    """JOI-3: replace every word found in the lexicon; whitespace and unknown words are kept.

    Only a line's distinct words meet the lexicon, and only hits come back, as
    one map per line; the line is rebuilt in its own row from its own tokens.
    Repeated keys share their hits, which are the same whatever row asks.
    """
    key = list(key)
    found = lines.select(*key, F.explode(F.array_distinct(words(src))).alias("_word"))
    lex = lexicon.select(F.col("ocr_word").alias("_word"), F.col("text_word").alias("_rep"))
    hits = (found.join(lex, "_word").groupBy(*key)
            .agg(F.map_from_entries(F.collect_set(F.struct("_word", "_rep"))).alias("_hits")))
    staged = lines.join(hits, key, "left").withColumn("_tokens", tokens(src))
    rebuilt = F.array_join(F.transform("_tokens", lambda t: F.coalesce(F.element_at("_hits", t), t)), "")
    return staged.select(*[F.col(c) for c in lines.columns],
                         F.when(F.col("_hits").isNull(), F.coalesce(F.col(src), F.lit(""))).otherwise(rebuilt).alias(out))


def confusion_table(pairs: DataFrame, ocr: str = "ocr_prediction", truth: str = "text") -> DataFrame:
    """MOD-3: (ocr_char, text_char, n) over aligned same-length words, confusions only."""
    return confusions_of(pair_counts(pairs, ocr, truth))


def confusions_of(counts: DataFrame) -> DataFrame:
    """MOD-3 from :func:`pair_counts`: the characters of a pair of words are compared once, however often it occurs."""
    differ = counts.where((F.length("ocr_word") == F.length("text_word")) & (F.col("ocr_word") != F.col("text_word")))
    zipped = differ.select("n", F.explode(F.arrays_zip(chars("ocr_word").alias("ocr_char"),
                                                       chars("text_word").alias("text_char"))).alias("z"))
    return (zipped.select("z.ocr_char", "z.text_char", "n").where(F.col("ocr_char") != F.col("text_char"))
            .groupBy("ocr_char", "text_char").agg(F.sum("n").alias("n")))


@dataclass(frozen=True)
class BatchCorrector:
    """A model behind MOD-1: ``load()`` runs once per task and returns ``list[str] -> list[str]``."""

    load: Callable[[], Callable[[list[str]], list[str]]]
    batch_size: int = 8


def correct(df: DataFrame, corrector, src: str = "ocr_prediction", out: str = "prediction", failed: str = "correction_failed") -> DataFrame:
    """MOD-1: run a corrector over ``src`` into ``out``.

    * DataFrame -> DataFrame function: called directly (native plans).
    * :class:`BatchCorrector`: over Arrow batches via ``mapInPandas``, in lists of
      ``batch_size`` lines.  Outputs are stripped.  When a list fails or comes
      back with another length, its lines are tried one by one; a line that
      fails alone keeps its input (PRJ-6) and is marked in ``failed``, so what
      happens to a line does not depend on its neighbours.  Blank lines are
      never sent (PRJ-5); null lines stay null.
    """
    if not isinstance(corrector, BatchCorrector):
        return corrector(df)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType()), T.StructField(failed, T.BooleanType())])

    def attempt(fn, texts):
        fixed = list(fn(texts))
        if len(fixed) != len(texts) or not all(isinstance(x, str) for x in fixed):
            raise ValueError("a corrector returns one string per line")
        return [x.strip() for x in fixed]

    def one_by_one(fn, texts):
        for text in texts:
            try:
                yield attempt(fn, [text])[0], False
            except Exception:  # this line keeps its input and is counted
                yield text, True

    def run(batches):
        fn = corrector.load()
        for pdf in batches:
            texts = pdf[src]
            result, bad = pd.Series([""] * len(pdf), index=pdf.index, dtype=object), pd.Series(False, index=pdf.index)
            todo = texts.index[~(texts.isna() | (texts.fillna("").str.strip() == ""))]
            for lo in range(0, len(todo), corrector.batch_size):
                some = todo[lo:lo + corrector.batch_size]
                lines = texts[some].tolist()
                try:
                    done = [(x, False) for x in attempt(fn, lines)]
                except Exception:
                    done = list(one_by_one(fn, lines))
                result[some], bad[some] = [x for x, _ in done], [f for _, f in done]
            pdf[out], pdf[failed] = result.where(~texts.isna(), None), bad
            yield pdf
    return df.mapInPandas(run, schema)
