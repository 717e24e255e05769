"""Per-row scores: one projection computing every per-pair quantity once.

The corpus metrics (``metrics.py``) are sums / means of these columns, so an
evaluation is ``score -> one aggregate``: a narrow projection followed by a
partial (map-side) aggregate and a tiny final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.bleu import with_sentence_bleu
from ..functions.pairparts import line_distance, line_parts
from ..functions.text import char_length, chars, is_blank, words, ws_strip

PART_COLUMNS = ("ed", "ed_norm", "ref_norm_len", "ref_words", "word_ed", "exact",
                "pad_match", "char_total", "trunc_match", "word_match", "word_total",
                "ocr_ed", "ocr_ed_norm", "bleu_score")


def score_parts(df: DataFrame, pred: str = "prediction", ref: str = "text",
                ocr: str | None = None, bleu: bool = True, word_level: bool = False, in_batches: bool = False) -> DataFrame:
    """Add the per-row parts of every metric for (pred, ref) [and (ocr, ref)].

    * ``ed``           raw edit distance (AGG-4, SCA-1)
    * ``ed_norm``      edit distance after whitespace normalisation (AGG-1/2)
    * ``ref_norm_len`` normalised reference length (AGG-1 denominator)
    * ``ref_words``    reference word count (AGG-2 denominator)
    * ``exact``        SCA-14
    * ``pad_match`` / ``trunc_match`` / ``char_total``   SCA-9 / SCA-10
    * ``word_match`` / ``word_total``                    SCA-11
    * ``ocr_ed`` / ``ocr_ed_norm``   the same distances for the OCR input (AGG-11, SCA-13)
    * ``bleu_score``   SCA-8 (optional)
    * ``word_ed``      AGG-15 standard word distance (optional)

    Built-in expressions alone, or ``in_batches``: all of them but the OCR
    distances and ``word_ed`` from whole Arrow batches (``pairparts.py``,
    ``ngramcounts.py``).  Null texts have null measures.
    """
    out = (_batch_parts if in_batches else _native_parts)(df, pred, ref)
    if ocr is not None:
        out = out.select("*", D.edit_distance(ocr, ref).alias("ocr_ed"), D.normalized_edit_distance(ocr, ref).alias("ocr_ed_norm"))
    if word_level:
        out = D.with_word_edit_distance(out, pred, ref, "word_ed")
    if bleu:
        out = with_sentence_bleu(out, pred, ref, "bleu_score", in_batches=in_batches)
    return out


def _batch_parts(df: DataFrame, pred: str, ref: str) -> DataFrame:
    cols = [F.col(c) for c in df.columns]
    part = lambda f: F.col(f"_parts.{f}").cast("bigint")
    return df.select(*cols, line_parts(F.col(pred), F.col(ref)).alias("_parts")).select(
        *cols, *[part(f).alias(f) for f in ("ed", "ed_norm", "ref_norm_len", "ref_words")], F.col("_parts.exact").alias("exact"),
        F.greatest(part("pred_chars"), part("ref_chars")).alias("char_total"), part("word_match").alias("word_match"),
        F.greatest(part("pred_words"), part("ref_words")).alias("word_total"), part("pad_match").alias("pad_match"), part("trunc_match").alias("trunc_match"))


def _native_parts(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Shared pieces (stripped texts, words, characters) are projected once; the optimizer keeps such projections
    instead of inlining them into every use.  Of identical texts one side's pieces do."""
    cols = [F.col(c) for c in df.columns]
    p, r = F.col(pred), F.col(ref)
    st = df.select(*cols, (p == r).alias("_same"), D.edit_distance(pred, ref).alias("ed"), ws_strip(r).alias("_sr"), words(r).alias("_wr"))
    same = F.col("_same")
    st = st.select("*", F.when(same, F.col("_sr")).otherwise(ws_strip(p)).alias("_sp"), F.when(same, F.col("_wr")).otherwise(words(p)).alias("_wp"))
    st = st.select("*", F.array_join("_wp", " ").alias("_np"), F.array_join("_wr", " ").alias("_nr"), (F.col("_sp") == F.col("_sr")).alias("exact"))
    st = st.select("*", F.when(~F.col("exact"), chars("_sp")).alias("_cp"), F.when(~F.col("exact"), chars("_sr")).alias("_cr"))
    # one pass over the character pairs that may differ: 2 = equal characters, 1 = equal only after space padding
    cmp = F.zip_with("_cp", "_cr", lambda a, b: F.when(a == b, 2).when(
        F.coalesce(a, F.lit(" ")) == F.coalesce(b, F.lit(" ")), 1).otherwise(0))
    # counted by what is left without a value: that is compiled, a filter's lambda is not
    matches = F.size(F.array_remove(F.zip_with("_wp", "_wr", lambda a, b: F.coalesce(a == b, F.lit(False))), False))
    normal = (F.col("_np") == p) & (F.col("_nr") == r)
    st = st.select(
        *cols, "ed", F.when(normal, F.col("ed")).otherwise(D.edit_distance("_np", "_nr")).alias("ed_norm"),
        F.length("_nr").cast("bigint").alias("ref_norm_len"), F.size("_wr").cast("bigint").alias("ref_words"), "exact",
        F.greatest(F.length("_sp"), F.length("_sr")).cast("bigint").alias("char_total"),
        F.when(same, F.size("_wr")).otherwise(matches).cast("bigint").alias("word_match"),
        F.greatest(F.size("_wp"), F.size("_wr")).cast("bigint").alias("word_total"),
        cmp.alias("_cmp"), F.length("_sr").alias("_all"))
    padded, unequal = F.size(F.array_remove("_cmp", 0)), F.size(F.array_remove("_cmp", 2))
    match = lambda n: F.when(F.col("exact"), F.col("_all")).otherwise(n).cast("bigint")
    return st.select(*[F.col(c) for c in st.columns if c not in ("_cmp", "_all")], match(padded).alias("pad_match"), match(F.size("_cmp") - unequal).alias("trunc_match"))


def row_scores(df: DataFrame, ocr: str = "ocr_prediction", pred: str = "prediction",
               truth: str = "text", key=("page_id", "line_number"), bleu: bool = True) -> DataFrame:
    """The detailed error-analysis table (row-score schema), keyed by ``key``.

    ``edit_distance`` and ``ocr_errors`` use raw strings; ``improvement`` is
    ``ocr_errors - edit_distance`` (positive = better).  Each distance is
    computed once; a line that the correction left as it was has only one.
    With BLEU, whose texts go to Python, the distance is computed there too.
    """
    o, p, t = F.col(ocr), F.col(pred), F.col(truth)
    staged = df.select(*key, o.alias("ocr_input"), p.alias("prediction"), t.alias("ground_truth"))
    distance = line_distance if bleu else D.edit_distance
    staged = staged.select("*", distance("prediction", "ground_truth").alias("edit_distance"))
    staged = staged.select("*", F.when(F.col("ocr_input") == F.col("prediction"), F.col("edit_distance"))
                           .otherwise(D.edit_distance("ocr_input", "ground_truth")).alias("ocr_errors"))
    if bleu:
        staged = with_sentence_bleu(staged, "prediction", "ground_truth", "bleu_score")
    else:
        staged = staged.withColumn("bleu_score", F.lit(None).cast("double"))
    return staged.select(
        *key, "ocr_input", "prediction", "ground_truth", "edit_distance", "bleu_score",
        char_length("ocr_input").alias("input_length"),
        char_length("prediction").alias("output_length"),
        char_length("ground_truth").alias("target_length"),
        "ocr_errors",
        (F.col("ocr_errors") - F.col("edit_distance")).alias("improvement"),
    )


def blank_short_circuit(df: DataFrame, src: str, out: str) -> DataFrame:
    """PRJ-5: a blank input line is corrected to ``''`` without calling the corrector."""
    return df.withColumn(out, F.when(is_blank(src), F.lit("")).otherwise(F.col(out)))


def fallback(df: DataFrame, src: str, out: str) -> DataFrame:
    """PRJ-6: a failed correction (NULL) keeps the input unchanged."""
    return df.withColumn(out, F.coalesce(F.col(out), F.col(src)))
