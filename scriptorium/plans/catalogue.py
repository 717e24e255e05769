"""Catalogue of registered queries over the driver tables.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables; the matching DuckDB SQL is registered next to it.  Column
names and types are aligned with the SQL (integers as BIGINT, doubles rounded
to 6 places where floating-point sums are involved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ws_normalize
from ..operators import metrics as M
from ..operators.scores import score_parts
from ..sources.fixture import document_lines, indexed_pairs, load_pairs, read_table
from .registry import query
from .sqlparts import DOC_LINES, norm, with_pairs


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------------------
# Lines and pairs (WIN-2, fixture)
# ---------------------------------------------------------------------------

@query("line_explode", f"WITH {DOC_LINES.strip()} SELECT page_id, line_number, text FROM doc_lines")
def line_explode(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(read_table(spark, sf, "documents"), keep=()).select("page_id", "line_number", "text")


@query("line_pairs", with_pairs(
    "SELECT page_id, line_number, line_id, text, ocr_prediction FROM pairs"))
def line_pairs_q(spark: SparkSession, sf: str) -> DataFrame:
    return load_pairs(spark, sf, spread_out=False).select("page_id", "line_number", "line_id", "text", "ocr_prediction")


# ---------------------------------------------------------------------------
# AGG-1 / AGG-11: corpus CER
# ---------------------------------------------------------------------------

@query("cer_by_lang", with_pairs(f"""
SELECT lang,
       CAST(sum(levenshtein({norm('ocr_prediction')}, {norm('text')})) AS BIGINT) AS total_errors,
       CAST(sum(length({norm('text')})) AS BIGINT) AS total_chars,
       coalesce(CAST(sum(levenshtein({norm('ocr_prediction')}, {norm('text')})) AS DOUBLE)
                / nullif(CAST(sum(length({norm('text')})) AS DOUBLE), 0), 0.0) AS cer
FROM pairs GROUP BY lang"""))
def cer_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum slice: documents -> lines -> noise -> normalise -> levenshtein -> CER per language."""
    pairs = load_pairs(spark, sf, spread_out=True)
    parts = pairs.select("lang", F.levenshtein(ws_normalize("ocr_prediction"), ws_normalize("text")).alias("ed_norm"),
                         F.length(ws_normalize("text")).alias("ref_norm_len"))
    return parts.groupBy("lang").agg(
        F.sum("ed_norm").cast("bigint").alias("total_errors"),
        F.sum("ref_norm_len").cast("bigint").alias("total_chars"),
        M.cer().alias("cer"))


# ---------------------------------------------------------------------------
# Shared inputs
# ---------------------------------------------------------------------------

from ..functions import distance as D  # noqa: E402
from ..functions import expand as X  # noqa: E402
from ..functions.bleu import with_sentence_bleu  # noqa: E402
from ..functions.text import add_prefix, is_blank, remove_prefix, ws_strip, words  # noqa: E402
from ..functions.tokens import argmax, byte_tokens, decode_tokens  # noqa: E402
from ..operators import analysis as A  # noqa: E402
from ..operators import correct as C  # noqa: E402
from ..operators import pages as P  # noqa: E402
from ..operators import pairs as PR  # noqa: E402
from ..operators import positions as POS  # noqa: E402
from ..operators import training as TR  # noqa: E402
from ..operators.scores import row_scores as _row_scores  # noqa: E402
from ..schema import PREFIX_EVAL, PREFIX_INFER, PREFIX_TRAIN  # noqa: E402
from ..sources.fixture import noise  # noqa: E402
from . import sqlparts as S  # noqa: E402

KEY = ["page_id", "line_number"]


def _pairs(spark, sf, heavy=False):
    """Line pairs; ``heavy``: spread over the tasks ahead of edit distances, BLEU or patterns."""
    return load_pairs(spark, sf, spread_out=heavy)


def _prediction():
    return F.when(is_blank("ocr_prediction"), F.lit("")).otherwise(X.expand_literals("ocr_prediction"))


def _predicted(spark, sf, heavy=False):
    """Pairs with a ``prediction``: blank lines -> '' (PRJ-5), else literal expansion of the OCR text."""
    return _pairs(spark, sf, heavy).withColumn("prediction", _prediction())


PRED_CTE = (f"predicted AS (SELECT *, CASE WHEN {S.strip('ocr_prediction')} = '' THEN '' "
            f"ELSE {S.expand_literals('ocr_prediction')} END AS prediction FROM pairs)")

SPLIT_CTE = """labeled AS (
  SELECT *, CASE WHEN idx < CAST(floor(n * 0.8) AS BIGINT) THEN 'train'
                 WHEN idx < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'validation'
                 ELSE 'test' END AS split
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY page_id, line_number) - 1 AS BIGINT) AS idx,
               CAST(count(*) OVER () AS DOUBLE) AS n FROM pairs))"""


# ---------------------------------------------------------------------------
# PRJ-2 / AGG-12: profile and null handling
# ---------------------------------------------------------------------------

@query("dataset_profile", with_pairs("""
SELECT CAST(count(*) AS BIGINT) AS total_rows,
       round(avg(length(ocr_prediction)), 6) AS avg_len_ocr_prediction,
       round(avg(length(text)), 6) AS avg_len_text,
       CAST(count(*) FILTER (WHERE ocr_prediction IS NULL OR text IS NULL) AS BIGINT) AS rows_with_null
FROM gappy""", """gappy AS (
  SELECT * REPLACE (CASE WHEN line_number % 11 = 3 THEN NULL ELSE ocr_prediction END AS ocr_prediction,
                    CASE WHEN line_number % 13 = 5 THEN NULL ELSE text END AS text) FROM pairs)"""))
def dataset_profile(spark, sf):
    prof = M.dataset_profile(_with_gaps(_pairs(spark, sf)))
    return prof.select("total_rows", _r("avg_len_ocr_prediction").alias("avg_len_ocr_prediction"),
                       _r("avg_len_text").alias("avg_len_text"), "rows_with_null")


GAPS_CTE = """gappy AS (
  SELECT * REPLACE (CASE WHEN line_number % 11 = 3 THEN NULL ELSE ocr_prediction END AS ocr_prediction,
                    CASE WHEN line_number % 13 = 5 THEN NULL ELSE text END AS text) FROM pairs)"""


def _with_gaps(pairs):
    """Pairs with NULLs in both text columns, by line number."""
    gap = lambda c, m, r: F.when(F.col("line_number") % m == r, F.lit(None)).otherwise(F.col(c))
    return pairs.withColumn("ocr_prediction", gap("ocr_prediction", 11, 3)).withColumn("text", gap("text", 13, 5))


@query("null_drop", with_pairs("""
SELECT CAST(count(*) AS BIGINT) AS rows_in,
       CAST(count(*) FILTER (WHERE ocr_prediction IS NOT NULL AND text IS NOT NULL) AS BIGINT) AS rows_kept,
       CAST(count(*) FILTER (WHERE ocr_prediction IS NULL OR text IS NULL) AS BIGINT) AS rows_dropped
FROM gappy""", GAPS_CTE))
def null_drop(spark, sf):
    return PR.incomplete_counts(_with_gaps(_pairs(spark, sf)))


# ---------------------------------------------------------------------------
# SCA-2 / SCA-3 / SCA-4
# ---------------------------------------------------------------------------

@query("normalise_ws", with_pairs(f"""
SELECT page_id, line_number, {S.norm('text')} AS text_norm, CAST(length({S.norm('text')}) AS BIGINT) AS norm_length
FROM pairs"""))
def normalise_ws(spark, sf):
    return _pairs(spark, sf).select(*KEY, ws_normalize("text").alias("text_norm"),
                                    F.length(ws_normalize("text")).cast("bigint").alias("norm_length"))


@query("strip_ws", with_pairs(f"""
SELECT page_id, line_number, {S.strip('text')} AS text_stripped, CAST(length(text) AS BIGINT) AS raw_length,
       CAST(length({S.strip('text')}) AS BIGINT) AS stripped_length
FROM pairs"""))
def strip_ws(spark, sf):
    return _pairs(spark, sf).select(*KEY, ws_strip("text").alias("text_stripped"),
                                    F.length("text").cast("bigint").alias("raw_length"),
                                    F.length(ws_strip("text")).cast("bigint").alias("stripped_length"))


# ---------------------------------------------------------------------------
# Row scores (SCA-1/4/8/12/13/14, PRJ-5, WIN-1)
# ---------------------------------------------------------------------------

@query("row_scores", with_pairs(f"""
SELECT p.page_id, p.line_number, CAST(row_number() OVER (ORDER BY p.page_id, p.line_number) - 1 AS BIGINT) AS sample_id,
       p.ocr_prediction AS ocr_input, p.prediction, p.text AS ground_truth,
       CAST({S.lev('p.prediction', 'p.text')} AS BIGINT) AS edit_distance,
       round(b.bleu_score, 6) AS bleu_score,
       CAST(length(p.ocr_prediction) AS BIGINT) AS input_length,
       CAST(length(p.prediction) AS BIGINT) AS output_length,
       CAST(length(p.text) AS BIGINT) AS target_length,
       CAST(levenshtein(p.ocr_prediction, p.text) AS BIGINT) AS ocr_errors,
       CAST(levenshtein(p.ocr_prediction, p.text) - {S.lev('p.prediction', 'p.text')} AS BIGINT) AS improvement
FROM predicted p JOIN bleu b ON p.page_id = b.page_id AND p.line_number = b.line_number""",
    PRED_CTE, *S.bleu_ctes("predicted", "page_id,line_number", "prediction", "text")))
def row_scores(spark, sf):
    # numbered from the page table, scored in the tasks that explode the lines
    indexed = indexed_pairs(spark, sf, out="sample_id").withColumn("prediction", _prediction())
    scores = _row_scores(indexed, key=KEY + ["sample_id"])
    return scores.select(*KEY, "sample_id", "ocr_input", "prediction", "ground_truth", "edit_distance",
                         _r("bleu_score").alias("bleu_score"), "input_length", "output_length", "target_length",
                         "ocr_errors", "improvement")


# ---------------------------------------------------------------------------
# AGG-11, AGG-2, AGG-15
# ---------------------------------------------------------------------------

@query("cer_before_after", with_pairs(f"""
SELECT CAST(sum(levenshtein(no, nt)) AS DOUBLE) / sum(length(nt)) AS cer_before,
       CAST(sum(d_after) AS DOUBLE) / sum(length(nt)) AS cer_after,
       CAST(sum(levenshtein(no, nt)) - sum(d_after) AS BIGINT) AS errors_removed
FROM (SELECT no, nt, {S.lev('np', 'nt')} AS d_after
      FROM (SELECT {S.norm('ocr_prediction')} AS no, {S.norm('prediction')} AS np, {S.norm('text')} AS nt FROM predicted))""",
    PRED_CTE))
def cer_before_after(spark, sf):
    p = _predicted(spark, sf, heavy=True)
    parts = p.select(D.normalized_edit_distance("ocr_prediction", "text").alias("before"),
                     D.normalized_edit_distance("prediction", "text").alias("ed_norm"),
                     F.length(ws_normalize("text")).alias("ref_norm_len"))
    return parts.agg(M.cer("before").alias("cer_before"), M.cer().alias("cer_after"),
                     (F.sum("before") - F.sum("ed_norm")).cast("bigint").alias("errors_removed"))


@query("wer_char_numerator", with_pairs(f"""
SELECT lang, CAST(sum(levenshtein({S.norm('ocr_prediction')}, {S.norm('text')})) AS BIGINT) AS char_errors,
       CAST(sum(len({S.words('text')})) AS BIGINT) AS ref_words,
       coalesce(CAST(sum(levenshtein({S.norm('ocr_prediction')}, {S.norm('text')})) AS DOUBLE)
                / nullif(sum(len({S.words('text')})), 0), 0.0) AS word_error_rate
FROM pairs GROUP BY lang"""))
def wer_char_numerator(spark, sf):
    parts = _pairs(spark, sf, heavy=True).select("lang", D.normalized_edit_distance("ocr_prediction", "text").alias("ed_norm"),
                                     F.size(words("text")).alias("ref_words"))
    return parts.groupBy("lang").agg(F.sum("ed_norm").cast("bigint").alias("char_errors"),
                                     F.sum("ref_words").cast("bigint").alias("ref_words"),
                                     M.wer_reference().alias("word_error_rate"))


def _word_codes_sql(ws: str, vocab: str) -> str:
    return f"array_to_string(list_transform({ws}, lambda w: chr(CAST(list_position({vocab}, w) AS INTEGER))), '')"


@query("wer_standard", with_pairs(f"""
SELECT lang, CAST(sum(levenshtein({_word_codes_sql('wp', 'v')}, {_word_codes_sql('wr', 'v')})) AS BIGINT) AS word_errors,
       CAST(sum(len(wr)) AS BIGINT) AS ref_words,
       coalesce(CAST(sum(levenshtein({_word_codes_sql('wp', 'v')}, {_word_codes_sql('wr', 'v')})) AS DOUBLE)
                / nullif(sum(len(wr)), 0), 0.0) AS word_error_rate_std
FROM (SELECT lang, wp, wr, list_distinct(list_concat(wp, wr)) AS v
      FROM (SELECT lang, {S.words('ocr_prediction')} AS wp, {S.words('text')} AS wr FROM pairs))
GROUP BY lang"""))
def wer_standard(spark, sf):
    """AGG-15 (oracle codes words as ASCII characters, valid for < 128 distinct words per line pair)."""
    parts = D.with_word_edit_distance(_pairs(spark, sf, heavy=True), "ocr_prediction", "text", "word_ed") \
        .select("lang", "word_ed", F.size(words("text")).alias("ref_words"))
    return parts.groupBy("lang").agg(F.sum("word_ed").cast("bigint").alias("word_errors"),
                                     F.sum("ref_words").cast("bigint").alias("ref_words"),
                                     M.wer_standard().alias("word_error_rate_std"))


# ---------------------------------------------------------------------------
# AGG-5..8
# ---------------------------------------------------------------------------

def _stripped_chars_sql():
    return (f"SELECT {S.chars(S.strip('ocr_prediction'))} AS pc, {S.chars(S.strip('text'))} AS rc, "
            f"{S.words('ocr_prediction')} AS pw, {S.words('text')} AS rw FROM pairs")


@query("char_accuracy_padded", with_pairs(f"""
SELECT CAST(sum(m) AS BIGINT) AS matches, CAST(sum(t) AS BIGINT) AS positions,
       coalesce(CAST(sum(m) AS DOUBLE) / nullif(sum(t), 0), 0.0) AS character_accuracy
FROM (SELECT len(list_filter(range(1, greatest(len(pc), len(rc)) + 1),
                 lambda i: coalesce(pc[i], ' ') = coalesce(rc[i], ' '))) AS m,
             greatest(len(pc), len(rc)) AS t
      FROM ({_stripped_chars_sql()}))"""))
def char_accuracy_padded(spark, sf):
    p = _pairs(spark, sf).select(D.padded_char_matches("ocr_prediction", "text").alias("pad_match"),
                                 D.char_positions("ocr_prediction", "text").alias("char_total"))
    return p.agg(F.sum("pad_match").cast("bigint").alias("matches"), F.sum("char_total").cast("bigint").alias("positions"),
                 M.char_accuracy_padded().alias("character_accuracy"))


@query("char_accuracy_truncated", with_pairs(f"""
SELECT CAST(sum(m) AS BIGINT) AS matches, CAST(sum(t) AS BIGINT) AS positions,
       coalesce(CAST(sum(m) AS DOUBLE) / nullif(sum(t), 0), 0.0) AS character_accuracy
FROM (SELECT len(list_filter(range(1, least(len(pc), len(rc)) + 1), lambda i: pc[i] = rc[i])) AS m,
             greatest(len(pc), len(rc)) AS t
      FROM ({_stripped_chars_sql()}))"""))
def char_accuracy_truncated(spark, sf):
    p = _pairs(spark, sf).select(D.truncated_char_matches("ocr_prediction", "text").alias("trunc_match"),
                                 D.char_positions("ocr_prediction", "text").alias("char_total"))
    return p.agg(F.sum("trunc_match").cast("bigint").alias("matches"), F.sum("char_total").cast("bigint").alias("positions"),
                 M.char_accuracy_truncated().alias("character_accuracy"))


@query("word_accuracy", with_pairs(f"""
SELECT CAST(sum(m) AS BIGINT) AS matches, CAST(sum(t) AS BIGINT) AS positions,
       coalesce(CAST(sum(m) AS DOUBLE) / nullif(sum(t), 0), 0.0) AS word_accuracy
FROM (SELECT len(list_filter(range(1, least(len(pw), len(rw)) + 1), lambda i: pw[i] = rw[i])) AS m,
             greatest(len(pw), len(rw)) AS t
      FROM ({_stripped_chars_sql()}))"""))
def word_accuracy(spark, sf):
    p = _pairs(spark, sf).select(D.word_matches("ocr_prediction", "text").alias("word_match"),
                                 D.word_positions("ocr_prediction", "text").alias("word_total"))
    return p.agg(F.sum("word_match").cast("bigint").alias("matches"), F.sum("word_total").cast("bigint").alias("positions"),
                 M.word_accuracy().alias("word_accuracy"))


@query("exact_match", with_pairs(f"""
SELECT lang, CAST(count(*) FILTER (WHERE {S.strip('ocr_prediction')} = {S.strip('text')}) AS BIGINT) AS exact_matches,
       CAST(count(*) AS BIGINT) AS total_samples,
       CAST(count(*) FILTER (WHERE {S.strip('ocr_prediction')} = {S.strip('text')}) AS DOUBLE) / count(*) AS exact_match_accuracy
FROM pairs GROUP BY lang"""))
def exact_match(spark, sf):
    p = _pairs(spark, sf).select("lang", D.exact_match("ocr_prediction", "text").alias("exact"))
    return p.groupBy("lang").agg(F.count_if("exact").cast("bigint").alias("exact_matches"),
                                 F.count(F.lit(1)).cast("bigint").alias("total_samples"),
                                 M.exact_match_rate().alias("exact_match_accuracy"))


# ---------------------------------------------------------------------------
# AGG-4, SCA-8, AGG-3, AGG-21
# ---------------------------------------------------------------------------

@query("edit_distance_stats", with_pairs("""
SELECT lang, round(avg(d), 6) AS edit_distance_mean, round(stddev_pop(d), 6) AS edit_distance_std,
       CAST(median(d) AS DOUBLE) AS edit_distance_median, CAST(min(d) AS BIGINT) AS edit_distance_min,
       CAST(max(d) AS BIGINT) AS edit_distance_max
FROM (SELECT lang, CAST(levenshtein(ocr_prediction, text) AS DOUBLE) AS d FROM pairs) GROUP BY ROLLUP (lang)"""))
def edit_distance_stats(spark, sf):
    p = _pairs(spark, sf, heavy=True).select("lang", D.edit_distance("ocr_prediction", "text").cast("double").alias("d"))
    return p.rollup("lang").agg(_r(F.avg("d")).alias("edit_distance_mean"), _r(F.stddev_pop("d")).alias("edit_distance_std"),
                                F.median("d").alias("edit_distance_median"), F.min("d").cast("bigint").alias("edit_distance_min"),
                                F.max("d").cast("bigint").alias("edit_distance_max"))


@query("sentence_bleu", with_pairs("SELECT page_id, line_number, round(bleu_score, 6) AS bleu_score FROM bleu",
                                   *S.bleu_ctes("pairs", "page_id,line_number", "ocr_prediction", "text")))
def sentence_bleu(spark, sf):
    b = with_sentence_bleu(_pairs(spark, sf, heavy=True).select(*KEY, "ocr_prediction", "text"), "ocr_prediction", "text")
    return b.select(*KEY, _r("bleu_score").alias("bleu_score"))


@query("bleu_stats", with_pairs("""
SELECT p.lang, round(avg(b.bleu_score), 6) AS bleu_score_mean, round(stddev_pop(b.bleu_score), 6) AS bleu_score_std,
       CAST(count(*) AS BIGINT) AS total_samples
FROM pairs p JOIN bleu b ON p.page_id = b.page_id AND p.line_number = b.line_number GROUP BY ROLLUP (p.lang)""",
    *S.bleu_ctes("pairs", "page_id,line_number", "ocr_prediction", "text")))
def bleu_stats(spark, sf):
    b = with_sentence_bleu(_pairs(spark, sf, heavy=True).select("lang", "ocr_prediction", "text"), "ocr_prediction", "text")
    return b.rollup("lang").agg(_r(F.avg("bleu_score")).alias("bleu_score_mean"),
                                _r(F.stddev_pop("bleu_score")).alias("bleu_score_std"),
                                F.count(F.lit(1)).cast("bigint").alias("total_samples"))


def _eval_sql():
    pc, rc = S.chars("sp"), S.chars("st")
    return f"""
SELECT lang,
       coalesce(CAST(sum(dn) AS DOUBLE) / nullif(sum(length(nt)), 0), 0.0) AS character_error_rate,
       coalesce(CAST(sum(dn) AS DOUBLE) / nullif(sum(len({S.words('text')})), 0), 0.0) AS word_error_rate,
       round(avg(bleu_score), 6) AS bleu_score_mean, round(stddev_pop(bleu_score), 6) AS bleu_score_std,
       CAST(count(*) FILTER (WHERE sp = st) AS DOUBLE) / count(*) AS exact_match_accuracy,
       coalesce(CAST(sum(len(list_filter(range(1, greatest(len({pc}), len({rc})) + 1),
                 lambda i: coalesce(({pc})[i], ' ') = coalesce(({rc})[i], ' ')))) AS DOUBLE)
                / nullif(sum(greatest(len({pc}), len({rc}))), 0), 0.0) AS character_accuracy,
       coalesce(CAST(sum(len(list_filter(range(1, least(len({pc}), len({rc})) + 1), lambda i: ({pc})[i] = ({rc})[i]))) AS DOUBLE)
                / nullif(sum(greatest(len({pc}), len({rc}))), 0), 0.0) AS character_accuracy_truncated,
       coalesce(CAST(sum(len(list_filter(range(1, least(len(pw), len(rw)) + 1), lambda i: pw[i] = rw[i]))) AS DOUBLE)
                / nullif(sum(greatest(len(pw), len(rw))), 0), 0.0) AS word_accuracy,
       round(avg(d), 6) AS edit_distance_mean,
       round(stddev_pop(d), 6) AS edit_distance_std,
       CAST(median(d) AS DOUBLE) AS edit_distance_median,
       CAST(count(*) AS BIGINT) AS total_samples,
       CAST(count(*) FILTER (WHERE sp = st) AS BIGINT) AS exact_matches
FROM (SELECT *, {S.lev('np', 'nt')} AS dn, {S.lev('prediction', 'text')} AS d
      FROM (SELECT p.lang, p.prediction, p.text, b.bleu_score, {S.norm('p.prediction')} AS np, {S.norm('p.text')} AS nt,
                   {S.strip('p.prediction')} AS sp, {S.strip('p.text')} AS st, {S.words('p.prediction')} AS pw, {S.words('p.text')} AS rw
            FROM predicted p JOIN bleu b ON p.page_id = b.page_id AND p.line_number = b.line_number))
GROUP BY ROLLUP (lang)"""


@query("evaluation_report", with_pairs(_eval_sql(), PRED_CTE,
                                       *S.bleu_ctes("predicted", "page_id,line_number", "prediction", "text")))
def evaluation_report(spark, sf):
    """AGG-21: the evaluator's whole metric set in one aggregate, per language plus the total row."""
    parts = score_parts(_predicted(spark, sf, heavy=True), pred="prediction", ref="text")
    rep = M.evaluate(parts, by=["lang"], rollup=True)
    return rep.select("lang", "character_error_rate", "word_error_rate", _r("bleu_score_mean").alias("bleu_score_mean"),
                      _r("bleu_score_std").alias("bleu_score_std"), "exact_match_accuracy", "character_accuracy",
                      "character_accuracy_truncated", "word_accuracy", _r("edit_distance_mean").alias("edit_distance_mean"),
                      _r("edit_distance_std").alias("edit_distance_std"), "edit_distance_median",
                      F.col("total_samples").cast("bigint").alias("total_samples"),
                      F.col("exact_matches").cast("bigint").alias("exact_matches"))


# ---------------------------------------------------------------------------
# Expansion (SCA-5, SCA-6, SCA-6b, SCA-6c, AGG-13, PRJ-9, PRJ-10)
# ---------------------------------------------------------------------------

@query("expand_literals", with_pairs(f"SELECT page_id, line_number, {S.expand_literals('text')} AS text_expanded FROM pairs"))
def expand_literals(spark, sf):
    return _pairs(spark, sf).select(*KEY, X.expand_literals("text").alias("text_expanded"))


@query("strip_marks", with_pairs(f"SELECT page_id, line_number, {S.strip_marks('text')} AS text_unmarked FROM pairs"))
def strip_marks(spark, sf):
    return _pairs(spark, sf).select(*KEY, X.strip_marks("text").alias("text_unmarked"))


@query("expand_full")
def expand_full(spark, sf):
    """SCA-6c over every line (look-around patterns: checked against a Python model in tests)."""
    return _pairs(spark, sf, heavy=True).select(*KEY, "text", X.expand_abbreviations("text").alias("text_converted"))


@query("conversion_stats")
def conversion_stats(spark, sf):
    """AGG-13: total rows, changed rows (PRJ-9), percentage changed."""
    conv = _pairs(spark, sf, heavy=True).select(X.changed_flag("text", X.expand_abbreviations("text")).alias("changed"))
    return conv.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("changed").alias("changed_rows")) \
        .select("total_rows", "changed_rows",
                F.round(F.try_divide(F.col("changed_rows") * 100.0, F.col("total_rows")), 6).alias("pct_changed"))


@query("changed_examples")
def changed_examples(spark, sf):
    """PRJ-10: among the first 10 rows in key order, those the expansion changes."""
    first = _pairs(spark, sf).select(*KEY, "text").orderBy(*KEY).limit(10)
    conv = first.withColumn("text_converted", X.expand_abbreviations("text"))
    return conv.where(F.col("text").isNotNull() & (F.col("text") != F.col("text_converted")))


# ---------------------------------------------------------------------------
# Prefixes (PRJ-3, PRJ-4)
# ---------------------------------------------------------------------------

@query("prefix_add_remove", with_pairs(f"""
SELECT page_id, line_number, {S.sql_str(PREFIX_INFER)} || ocr_prediction AS model_input,
       replace({S.sql_str(PREFIX_INFER)} || ocr_prediction, {S.sql_str(PREFIX_INFER)}, '') AS prefix_removed
FROM pairs"""))
def prefix_add_remove(spark, sf):
    p = _pairs(spark, sf).select(*KEY, add_prefix("ocr_prediction", PREFIX_INFER).alias("model_input"))
    return p.select(*KEY, "model_input", remove_prefix("model_input", PREFIX_INFER).alias("prefix_removed"))


# ---------------------------------------------------------------------------
# Byte tokens (SCA-7, SCA-7b, SCA-7c)
# ---------------------------------------------------------------------------

def _ids_sql(x: str, limit: int = 128) -> str:
    h = f"hex(encode({x}))"
    return (f"list_concat(list_transform(range(0, least(length({h}) // 2, {limit - 1})), "
            f"lambda i: CAST(('0x' || substr({h}, CAST(i * 2 + 1 AS BIGINT), 2)) AS INTEGER) + 3), [1])")


@query("byte_tokens", with_pairs(f"""
SELECT page_id, line_number, array_to_string({_ids_sql(S.sql_str(PREFIX_TRAIN) + ' || ocr_prediction')}, ',') AS input_ids,
       CAST(len({_ids_sql(S.sql_str(PREFIX_TRAIN) + ' || ocr_prediction')}) AS BIGINT) AS n_ids
FROM pairs"""))
def byte_tokens_q(spark, sf):
    ids = byte_tokens(add_prefix("ocr_prediction", PREFIX_TRAIN))
    p = _pairs(spark, sf).select(*KEY, ids.alias("ids"))
    return p.select(*KEY, F.array_join("ids", ",").alias("input_ids"), F.size("ids").cast("bigint").alias("n_ids"))


@query("byte_decode", with_pairs(f"""
SELECT page_id, line_number,
       substr(x, 1, len(list_filter(range(1, length(x) + 1), lambda k: strlen(substr(x, 1, k)) <= 127))) AS decoded
FROM (SELECT page_id, line_number, {S.sql_str(PREFIX_TRAIN)} || ocr_prediction AS x FROM pairs)"""))
def byte_decode(spark, sf):
    """Inverse of SCA-7 after the 128-id cut: a character cut in the middle is dropped."""
    ids = byte_tokens(add_prefix("ocr_prediction", PREFIX_TRAIN))
    return _pairs(spark, sf).select(*KEY, decode_tokens(ids).alias("decoded"))


@query("padded_batches", with_pairs(f"""
SELECT page_id, line_number, idx // 8 AS batch,
       CAST(max(len(ids)) OVER (PARTITION BY idx // 8) AS BIGINT) AS padded_length,
       CAST(max(len(ids)) OVER (PARTITION BY idx // 8) - len(ids) AS BIGINT) AS pad_count,
       array_to_string(list_concat(ids, list_transform(range(0, max(len(ids)) OVER (PARTITION BY idx // 8) - len(ids)), lambda i: -100)), ',') AS labels_padded
FROM (SELECT page_id, line_number, CAST(row_number() OVER (ORDER BY page_id, line_number) - 1 AS BIGINT) AS idx,
             {_ids_sql('text')} AS ids FROM pairs)"""))
def padded_batches(spark, sf):
    """SCA-7b: labels padded with -100 to the longest row of each batch of 8 (batches in key order)."""
    p = indexed_pairs(spark, sf).select(*KEY, "idx", byte_tokens("text").alias("labels")).withColumn("input_ids", F.col("labels")) \
        .withColumn("attention_mask", F.transform("labels", lambda _: F.lit(1)))
    b = TR.padded_batches(p, 8)
    return b.select(*KEY, "batch", F.size("labels_padded").cast("bigint").alias("padded_length"),
                    (F.size("labels_padded") - F.size("labels")).cast("bigint").alias("pad_count"),
                    F.array_join("labels_padded", ",").alias("labels_padded"))


@query("padded_inputs", with_pairs(f"""
SELECT page_id, line_number, idx // 8 AS batch,
       array_to_string(list_concat(ids, list_transform(range(0, longest - len(ids)), lambda i: 0)), ',') AS input_ids_padded,
       CAST(len(ids) AS BIGINT) AS mask_ones, CAST(longest AS BIGINT) AS mask_length, CAST(len(ids) AS BIGINT) AS first_zero
FROM (SELECT *, max(len(ids)) OVER (PARTITION BY idx // 8) AS longest
      FROM (SELECT page_id, line_number, CAST(row_number() OVER (ORDER BY page_id, line_number) - 1 AS BIGINT) AS idx,
                   {_ids_sql(S.sql_str(PREFIX_TRAIN) + ' || ocr_prediction')} AS ids FROM pairs))"""))
def padded_inputs(spark, sf):
    """SCA-7b: inputs padded with 0 to the longest row of each batch of 8, and the attention mask: ones, then zeros."""
    b = TR.padded_batches(TR.tokenized(_split_pairs(spark, sf), KEY), 8)
    zero = F.array_position("attention_mask_padded", 0)
    return b.select(*KEY, "batch", F.array_join("input_ids_padded", ",").alias("input_ids_padded"),
                    F.aggregate("attention_mask_padded", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("mask_ones"),
                    F.size("attention_mask_padded").cast("bigint").alias("mask_length"),
                    F.when(zero == 0, F.size("attention_mask_padded")).otherwise(zero - 1).cast("bigint").alias("first_zero"))


@query("head_rows", with_pairs("""
SELECT page_id, line_number, line_id, ocr_prediction, text FROM pairs ORDER BY page_id, line_number LIMIT 5"""))
def head_rows(spark, sf):
    """TOP-4: the first five rows in key order (a top-k)."""
    return TR.first_examples(_pairs(spark, sf), 5, KEY).select(*KEY, "line_id", "ocr_prediction", "text")


@query("greedy_argmax", """
SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings""")
def greedy_argmax(spark, sf):
    """SCA-7c: argmax over the last axis, first maximum wins."""
    return read_table(spark, sf, "embeddings").select("vec_id", "label", argmax("embedding").alias("argmax"))


# ---------------------------------------------------------------------------
# Positions (WIN-1, WIN-3a/b, AGG-20) and the training table (MOD-4)
# ---------------------------------------------------------------------------

def _split_pairs(spark, sf):
    """WIN-3a on the pairs, numbered from the page table."""
    return POS.split_by_index(indexed_pairs(spark, sf, with_total="_n").select(*KEY, "ocr_prediction", "text", "idx", "_n"))


@query("global_index", with_pairs("""
SELECT page_id, line_number, CAST(row_number() OVER (ORDER BY page_id, line_number) - 1 AS BIGINT) AS idx FROM pairs"""))
def global_index_q(spark, sf):
    return POS.global_index(_pairs(spark, sf).select(*KEY), KEY, "idx")


@query("split_3way", with_pairs("SELECT page_id, line_number, idx, split FROM labeled", SPLIT_CTE))
def split_3way(spark, sf):
    return POS.positional_split(_pairs(spark, sf).select(*KEY), KEY).select(*KEY, "idx", "split")


@query("split_2way", with_pairs("""
SELECT page_id, line_number, idx, CASE WHEN idx < CAST(floor(n * 0.8) AS BIGINT) THEN 'train' ELSE 'validation' END AS split
FROM (SELECT *, CAST(row_number() OVER (ORDER BY page_id, line_number) - 1 AS BIGINT) AS idx,
             CAST(count(*) OVER () AS DOUBLE) AS n FROM pairs)"""))
def split_2way(spark, sf):
    return POS.positional_split(_pairs(spark, sf).select(*KEY), KEY, three_way=False).select(*KEY, "idx", "split")


@query("split_report", with_pairs("""
SELECT split, CAST(count(*) AS BIGINT) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM labeled GROUP BY split""", SPLIT_CTE))
def split_report(spark, sf):
    s = POS.positional_split(_pairs(spark, sf).select(*KEY), KEY)
    return POS.split_report(s).select("split", F.col("rows").cast("bigint").alias("rows"), "share_pct")


@query("training_table", with_pairs(f"""
SELECT page_id, line_number, idx, split,
       array_to_string({_ids_sql(S.sql_str(PREFIX_TRAIN) + ' || ocr_prediction')}, ',') AS input_ids,
       CAST(len({_ids_sql(S.sql_str(PREFIX_TRAIN) + ' || ocr_prediction')}) AS BIGINT) AS mask_ones,
       array_to_string({_ids_sql('text')}, ',') AS labels
FROM labeled WHERE ocr_prediction IS NOT NULL AND text IS NOT NULL""", SPLIT_CTE))
def training_table(spark, sf):
    t = TR.tokenized(_split_pairs(spark, sf), KEY)  # the derived pairs are complete
    return t.select(*KEY, "idx", "split", F.array_join("input_ids", ",").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("mask_ones"),
                    F.array_join("labels", ",").alias("labels"))


# ---------------------------------------------------------------------------
# Learned correction (MOD-2, JOI-3, MOD-3)
# ---------------------------------------------------------------------------

LEX_CTES = [SPLIT_CTE, f"""wp AS (
  SELECT unnest(wo) AS ocr_word, unnest(wt) AS text_word
  FROM (SELECT {S.words('ocr_prediction')} AS wo, {S.words('text')} AS wt FROM labeled WHERE split = 'train')
  WHERE len(wo) = len(wt))""", """cnt AS (SELECT ocr_word, text_word, count(*) AS n FROM wp GROUP BY ALL)""",
            """lex AS (
  SELECT ocr_word, text_word, CAST(n AS BIGINT) AS support, CAST(seen AS BIGINT) AS seen FROM (
    SELECT *, row_number() OVER (PARTITION BY ocr_word ORDER BY n DESC, text_word) AS rk,
           sum(n) OVER (PARTITION BY ocr_word) AS seen FROM cnt)
  WHERE rk = 1 AND n >= 2 AND text_word <> ocr_word)""",
            f"""toks AS (
  SELECT page_id, line_number, unnest(t) AS tok, unnest(range(0, len(t))) AS pos
  FROM (SELECT page_id, line_number, regexp_extract_all(ocr_prediction, {S.sql_str(S.TOKENS_RE)}) AS t
        FROM labeled WHERE split = 'test'))""",
            """fixed AS (
  SELECT l.page_id, l.line_number, coalesce(string_agg(coalesce(x.text_word, k.tok), '' ORDER BY k.pos), '') AS prediction
  FROM labeled l LEFT JOIN toks k ON l.page_id = k.page_id AND l.line_number = k.line_number
       LEFT JOIN lex x ON k.tok = x.ocr_word
  WHERE l.split = 'test' GROUP BY l.page_id, l.line_number)"""]


def _lexicon_parts(spark, sf):
    s = _split_pairs(spark, sf)
    lex = C.learn_lexicon(s.where(F.col("split") == "train"))
    return s, lex


@query("lexicon_learn", with_pairs("SELECT ocr_word, text_word, support, seen FROM lex", *LEX_CTES[:4]))
def lexicon_learn(spark, sf):
    _, lex = _lexicon_parts(spark, sf)
    return lex.select("ocr_word", "text_word", F.col("support").cast("bigint").alias("support"),
                      F.col("seen").cast("bigint").alias("seen"))


@query("lexicon_apply", with_pairs("SELECT page_id, line_number, prediction FROM fixed", *LEX_CTES))
def lexicon_apply(spark, sf):
    s, lex = _lexicon_parts(spark, sf)
    test = s.where(F.col("split") == "test").select(*KEY, "ocr_prediction")
    out = C.apply_lexicon(test, lex, KEY)
    return out.select(*KEY, F.coalesce("prediction", F.lit("")).alias("prediction"))


@query("lexicon_evaluation", with_pairs(f"""
SELECT CAST(sum(d_before) AS DOUBLE) / sum(length(nt)) AS cer_before,
       CAST(sum(d_after) AS DOUBLE) / sum(length(nt)) AS cer_after,
       CAST(count(*) FILTER (WHERE d_after < d_before) AS BIGINT) AS lines_better,
       CAST(count(*) FILTER (WHERE d_after > d_before) AS BIGINT) AS lines_worse,
       CAST(count(*) AS BIGINT) AS lines_total
FROM (SELECT nt, levenshtein(no, nt) AS d_before, {S.lev('np', 'nt')} AS d_after
      FROM (SELECT {S.norm('l.ocr_prediction')} AS no, {S.norm('f.prediction')} AS np, {S.norm('l.text')} AS nt
            FROM labeled l JOIN fixed f ON l.page_id = f.page_id AND l.line_number = f.line_number))""", *LEX_CTES))
def lexicon_evaluation(spark, sf):
    """MOD-2 quality on the held-out test split: CER before/after, lines better/worse."""
    s, lex = _lexicon_parts(spark, sf)
    test = s.where(F.col("split") == "test").select(*KEY, "ocr_prediction", "text")
    out = C.apply_lexicon(test, lex, KEY)
    parts = out.select(D.normalized_edit_distance("ocr_prediction", "text").alias("b"),
                       D.normalized_edit_distance(F.coalesce("prediction", F.lit("")), "text").alias("a"),
                       F.length(ws_normalize("text")).alias("n"))
    return parts.agg(M.cer("b", "n").alias("cer_before"), M.cer("a", "n").alias("cer_after"),
                     F.count_if(F.col("a") < F.col("b")).cast("bigint").alias("lines_better"),
                     F.count_if(F.col("a") > F.col("b")).cast("bigint").alias("lines_worse"),
                     F.count(F.lit(1)).cast("bigint").alias("lines_total"))


@query("confusion_table", with_pairs(f"""
SELECT ocr_char, text_char, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest({S.chars('ocr_word')}) AS ocr_char, unnest({S.chars('text_word')}) AS text_char
  FROM (SELECT unnest(wo) AS ocr_word, unnest(wt) AS text_word
        FROM (SELECT {S.words('ocr_prediction')} AS wo, {S.words('text')} AS wt FROM pairs) WHERE len(wo) = len(wt))
  WHERE length(ocr_word) = length(text_word))
WHERE ocr_char <> text_char GROUP BY ALL"""))
def confusion_table(spark, sf):
    t = C.confusion_table(_pairs(spark, sf))
    return t.select("ocr_char", "text_char", F.col("n").cast("bigint").alias("n"))


# ---------------------------------------------------------------------------
# Joins (JOI-1, JOI-2, JOI-4)
# ---------------------------------------------------------------------------

PAGE_OCR_CTE = """page_ocr AS (
  SELECT page_id, unnest(l) AS ocr_prediction, CAST(unnest(range(0, len(l))) AS BIGINT) AS line_number
  FROM (SELECT doc_id AS page_id, regexp_extract_all(
          replace(replace(replace(translate(text, 'uc', 'ne'), 'm', 'rn'), 'th', 'tb'), 'li', 'h'), '.{1,48}') AS l
        FROM documents))"""


def _page_ocr_lines(spark, sf):
    """OCR of whole pages re-segmented into lines (line counts differ from the verified text)."""
    d = read_table(spark, sf, "documents")
    o = d.select(F.col("doc_id").alias("page_id"),
                 F.posexplode(F.regexp_extract_all(noise("text", F.lit(1)), F.lit(".{1,48}"), 0))
                 .alias("line_number", "ocr_prediction"))
    return o.withColumn("line_number", F.col("line_number").cast("bigint"))


@query("pair_join", with_pairs(f"""
SELECT p.page_id, p.line_number, p.prediction, r.text
FROM (SELECT page_id, line_number, {S.expand_literals('ocr_prediction')} AS prediction FROM pairs) p
JOIN (SELECT page_id, line_number, text FROM pairs) r ON p.page_id = r.page_id AND p.line_number = r.line_number"""))
def pair_join(spark, sf):
    p = _pairs(spark, sf)
    preds = p.select(*KEY, X.expand_literals("ocr_prediction").alias("prediction"))
    refs = p.select(*KEY, "text")
    return PR.pair_join(preds, refs, KEY)


@query("unpaired_lines", with_pairs("""
SELECT page_id, line_number, 'left_only' AS side FROM page_ocr o
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.page_id = o.page_id AND p.line_number = o.line_number)
UNION ALL
SELECT page_id, line_number, 'right_only' AS side FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM page_ocr o WHERE p.page_id = o.page_id AND p.line_number = o.line_number)""",
    PAGE_OCR_CTE))
def unpaired_lines(spark, sf):
    return PR.unpaired(_page_ocr_lines(spark, sf), _pairs(spark, sf), KEY)


@query("align_lines", with_pairs(f"""
SELECT page_id, line_number, aligned_line, CAST(d AS BIGINT) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, line_number
                               ORDER BY d, abs(aligned_line - line_number), aligned_line) AS rk
  FROM (SELECT o.page_id, o.line_number, p.line_number AS aligned_line, {S.lev('o.ocr_prediction', 'p.text')} AS d
        FROM page_ocr o
        JOIN (SELECT page_id, line_number, text, unnest(range(line_number - 2, line_number + 3)) AS cand FROM pairs) p
          ON o.page_id = p.page_id AND o.line_number = p.cand))
WHERE rk = 1""", PAGE_OCR_CTE))
def align_lines(spark, sf):
    return PR.align_lines(_page_ocr_lines(spark, sf), _pairs(spark, sf).select("page_id", "line_number", "text"))


# ---------------------------------------------------------------------------
# Page side (PRJ-13, PRJ-14, AGG-14, AGG-16)
# ---------------------------------------------------------------------------

@query("bbox_from_polygon", """
SELECT vec_id, list_min(xs) AS "left", list_min(ys) AS top, list_max(xs) AS "right", list_max(ys) AS bottom,
       printf('%s_%02d.png', 'page' || CAST(label AS VARCHAR), vec_id) AS image_name
FROM (SELECT vec_id, label,
             list_transform(range(0, 32), lambda k: CAST(trunc(CAST(embedding[2 * k + 1] AS DOUBLE) * 1000) AS INTEGER)) AS xs,
             list_transform(range(0, 32), lambda k: CAST(trunc(CAST(embedding[2 * k + 2] AS DOUBLE) * 1000) AS INTEGER)) AS ys
      FROM embeddings)""")
def bbox_from_polygon(spark, sf):
    """PRJ-13/14 on ``embeddings`` read as 32-point polygons (x, y scaled by 1000, truncated)."""
    e = read_table(spark, sf, "embeddings")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.array(
        (F.get("embedding", k * 2).cast("double") * 1000).cast("int"),
        (F.get("embedding", k * 2 + 1).cast("double") * 1000).cast("int")))
    b = e.select("vec_id", "label", P.bbox_from(pts, F.lit(None).cast("array<int>")).alias("bbox"))
    return b.select("vec_id", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom",
                    P.line_image_name(F.concat(F.lit("page"), F.col("label").cast("string")), "vec_id").alias("image_name"))


@query("assemble_pages", with_pairs("""
SELECT page_id, CAST(line_number // 256 AS BIGINT) AS block, min(line_number) AS first_line,
       CAST(count(*) AS BIGINT) AS n_lines, string_agg(prediction, chr(10) ORDER BY line_number) AS text
FROM predicted GROUP BY page_id, line_number // 256""", PRED_CTE))
def assemble_pages(spark, sf):
    """AGG-16: corrected lines joined in order, as bounded blocks of 256 lines per page."""
    b = P.assemble_blocks(_predicted(spark, sf, heavy=True), "page_id", "line_number", "prediction")
    return b.select("page_id", "block", "first_line", F.col("n_lines").cast("bigint").alias("n_lines"), "text")


@query("assemble_conversations", """
SELECT conv_id, CAST(turn // 256 AS BIGINT) AS block, min(turn) AS first_line, CAST(count(*) AS BIGINT) AS n_lines,
       string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id, turn // 256""")
def assemble_conversations(spark, sf):
    """AGG-16 on ``conversations``: turns joined in order per conversation."""
    c = read_table(spark, sf, "conversations")
    b = P.assemble_blocks(c, "conv_id", "turn", "text")
    return b.select("conv_id", "block", "first_line", F.col("n_lines").cast("bigint").alias("n_lines"), "text")


@query("page_results", with_pairs("""
SELECT page_id, CAST(count(DISTINCT line_number // 256) AS BIGINT) AS n_blocks, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE prediction = '') AS BIGINT) AS n_blank, min(line_number) AS first_line, max(line_number) AS last_line,
       CAST(sum(length(prediction)) + count(*) - 1 AS BIGINT) AS text_length
FROM predicted GROUP BY page_id""", PRED_CTE))
def page_results(spark, sf):
    """AGG-16 as one row per page: how many blocks hold its text, and what they hold together."""
    return P.page_results(_predicted(spark, sf), "page_id", "line_number", "prediction")


@query("page_summary", with_pairs("""
SELECT page_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(prediction)) + count(*) - 1 AS BIGINT) AS text_length,
       round((sum(length(prediction)) + count(*) - 1) / count(*), 6) AS avg_line_length
FROM predicted GROUP BY page_id""", PRED_CTE))
def page_summary(spark, sf):
    s = P.page_summary(_predicted(spark, sf), "page_id", "prediction")
    return s.select("page_id", F.col("n_lines").cast("bigint").alias("n_lines"), "text_length", "avg_line_length")


# ---------------------------------------------------------------------------
# Analysis (TOP-1, TOP-2, TOP-5, AGG-17, AGG-18, AGG-19, WIN-5)
# ---------------------------------------------------------------------------

SCORES_CTE = f"""scores AS (
  SELECT page_id, line_number, lang, source, ocr_prediction AS ocr_input, prediction, text AS ground_truth,
         CAST(ed AS BIGINT) AS edit_distance, CAST(length(ocr_prediction) AS BIGINT) AS input_length,
         CAST(oe AS BIGINT) AS ocr_errors, CAST(oe - ed AS BIGINT) AS improvement
  FROM (SELECT *, {S.lev('prediction', 'text')} AS ed, levenshtein(ocr_prediction, text) AS oe FROM predicted))"""

_TOP_COLS = "page_id, line_number, edit_distance, improvement, ocr_input, prediction, ground_truth"


def _scores(spark, sf, bleu=False):
    p = _predicted(spark, sf, heavy=True)
    s = _row_scores(p, key=KEY + ["lang", "source"], bleu=bleu)
    return s


@query("worst_rows", with_pairs(f"SELECT {_TOP_COLS} FROM scores ORDER BY edit_distance DESC, page_id, line_number LIMIT 10",
                                PRED_CTE, SCORES_CTE))
def worst_rows(spark, sf):
    """TOP-1: 10 largest edit distances, ties in row order."""
    return A.top_k(_scores(spark, sf), "edit_distance", 10).select(*_TOP_COLS.split(", "))


@query("best_improvements", with_pairs(f"SELECT {_TOP_COLS} FROM scores ORDER BY improvement DESC, page_id, line_number LIMIT 10",
                                       PRED_CTE, SCORES_CTE))
def best_improvements(spark, sf):
    """TOP-2: 10 largest improvements."""
    return A.top_k(_scores(spark, sf), "improvement", 10).select(*_TOP_COLS.split(", "))


@query("worst_per_lang", with_pairs(f"""
SELECT lang, {_TOP_COLS}, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY edit_distance DESC, page_id, line_number) AS rk FROM scores)
WHERE rk <= 3""", PRED_CTE, SCORES_CTE))
def worst_per_lang(spark, sf):
    """TOP-5: 3 worst rows per language."""
    t = A.top_k_per_group(_scores(spark, sf), "lang", "edit_distance", 3)
    return t.select("lang", *_TOP_COLS.split(", "), "rank")


def _hist_sql(col: str) -> str:
    return f"""
SELECT CAST(bin AS BIGINT) AS bin, round(lo + bin * (hi - lo) / 30, 6) AS lower, round(lo + (bin + 1) * (hi - lo) / 30, 6) AS upper,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT least(CAST(floor((x - lo) * 30 / (hi - lo)) AS BIGINT), 29) AS bin, lo, hi
      FROM (SELECT x, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
            FROM (SELECT CAST({col} AS DOUBLE) AS x, min(CAST({col} AS DOUBLE)) OVER () AS mn, max(CAST({col} AS DOUBLE)) OVER () AS mx
                  FROM scores)))
GROUP BY ALL"""


@query("hist_edit_distance", with_pairs(_hist_sql("edit_distance"), PRED_CTE, SCORES_CTE))
def hist_edit_distance(spark, sf):
    """AGG-17: 30-bin histogram of edit distances."""
    h = A.histogram(_scores(spark, sf), "edit_distance")
    return h.select("bin", "lower", "upper", F.col("n").cast("bigint").alias("n"))


@query("hist_improvement", with_pairs(_hist_sql("improvement"), PRED_CTE, SCORES_CTE))
def hist_improvement(spark, sf):
    """AGG-17: 30-bin histogram of improvements."""
    h = A.histogram(_scores(spark, sf), "improvement")
    return h.select("bin", "lower", "upper", F.col("n").cast("bigint").alias("n"))


@query("error_by_length", with_pairs("""
SELECT input_length, CAST(count(*) AS BIGINT) AS n, round(avg(edit_distance), 6) AS avg_edit_distance,
       min(edit_distance) AS min_edit_distance, max(edit_distance) AS max_edit_distance,
       round(avg(CASE WHEN length(ground_truth) = 0 THEN 0.0 ELSE CAST(edit_distance AS DOUBLE) / length(ground_truth) END), 6) AS avg_cer
FROM scores GROUP BY input_length""", PRED_CTE, SCORES_CTE))
def error_by_length(spark, sf):
    """AGG-18: error by input length (table behind the scatter plots)."""
    e = A.error_by_length(_scores(spark, sf))
    return e.select("input_length", F.col("n").cast("bigint").alias("n"), "avg_edit_distance",
                    "min_edit_distance", "max_edit_distance", "avg_cer")


LOG_CTE = f"""mlog AS (
  SELECT p.lang AS run, p.page_id // 25 AS step,
         coalesce(CAST(sum(levenshtein({S.norm('p.ocr_prediction')}, {S.norm('p.text')})) AS DOUBLE)
                  / nullif(sum(length({S.norm('p.text')})), 0), 0.0) AS cer,
         CAST(count(*) AS BIGINT) AS eval_samples
  FROM pairs p GROUP BY p.lang, p.page_id // 25)"""


def _metric_log(spark, sf):
    """Evaluation log: one row per (run = language, step = block of 25 pages)."""
    parts = _pairs(spark, sf, heavy=True).select(
        F.col("lang").alias("run"), F.floor(F.col("page_id") / 25).cast("bigint").alias("step"),
        D.normalized_edit_distance("ocr_prediction", "text").alias("ed_norm"),
        F.length(ws_normalize("text")).alias("ref_norm_len"))
    return parts.groupBy("run", "step").agg(M.cer().alias("cer"), F.count(F.lit(1)).cast("bigint").alias("eval_samples"))


@query("metric_trend", with_pairs("""
SELECT run, step, round(cer, 6) AS cer, round(lag(cer) OVER w, 6) AS prev_cer, round(cer - lag(cer) OVER w, 6) AS delta_cer,
       round(min(cer) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_cer_so_far
FROM mlog WINDOW w AS (PARTITION BY run ORDER BY step)""", LOG_CTE))
def metric_trend(spark, sf):
    """WIN-5: CER trend over evaluation steps per run."""
    return A.metric_trend(_metric_log(spark, sf))


@query("best_checkpoint", with_pairs("""
SELECT run, best_step, round(best_cer, 6) AS best_cer FROM (
  SELECT run, step AS best_step, cer AS best_cer, row_number() OVER (PARTITION BY run ORDER BY cer, step) AS rk FROM mlog)
WHERE rk = 1""", LOG_CTE))
def best_checkpoint(spark, sf):
    """AGG-19: lowest-CER step per run."""
    return A.best_checkpoint(_metric_log(spark, sf))


# ---------------------------------------------------------------------------
# Streams (STR-1..3): run to completion, then read their sinks back
# ---------------------------------------------------------------------------

from ..streaming import arrivals as SA  # noqa: E402
from ..streaming import corrections as SC  # noqa: E402
from ..streaming import streams as ST  # noqa: E402


@query("stream_metrics_log", with_pairs("""
SELECT CAST(0 AS BIGINT) AS batch_id, cer, round(bleu, 6) AS bleu, round(edit_distance, 6) AS edit_distance, eval_samples
FROM (SELECT coalesce(CAST(sum(levenshtein(no, nt)) AS DOUBLE) / nullif(sum(length(nt)), 0), 0.0) AS cer,
             avg(b.bleu_score) AS bleu, avg(levenshtein(p.ocr_prediction, p.text)) AS edit_distance,
             CAST(count(*) AS BIGINT) AS eval_samples
      FROM (SELECT *, """ + S.norm("ocr_prediction") + " AS no, " + S.norm("text") + """ AS nt FROM pairs) p
      JOIN bleu b ON p.page_id = b.page_id AND p.line_number = b.line_number)""",
    *S.bleu_ctes("pairs", "page_id,line_number", "ocr_prediction", "text")))
def stream_metrics_log(spark, sf):
    """STR-1: metric log written per micro-batch (one file per trigger; one table here -> batch 0)."""
    log = spark.read.parquet(ST.stream_metrics_log(spark, sf))
    return log.select(F.col("batch_id").cast("bigint").alias("batch_id"), "cer", _r("bleu").alias("bleu"),
                      _r("edit_distance").alias("edit_distance"), F.col("eval_samples").cast("bigint").alias("eval_samples"))


@query("stream_expand", with_pairs(f"SELECT page_id, line_number, {S.expand_literals('ocr_prediction')} AS prediction FROM pairs"))
def stream_expand(spark, sf):
    """STR-2: streamed expansion equals the batch expansion."""
    return spark.read.parquet(ST.stream_expand(spark, sf)).select(*KEY, "prediction")


@query("stream_correct", with_pairs("""
SELECT CAST(1 AS BIGINT) AS version, l.page_id, l.line_number, coalesce(string_agg(coalesce(x.text_word, k.tok), '' ORDER BY k.pos), '') AS prediction
FROM pairs l LEFT JOIN exptoks k ON l.page_id = k.page_id AND l.line_number = k.line_number LEFT JOIN lex x ON k.tok = x.ocr_word
GROUP BY l.page_id, l.line_number""", *LEX_CTES[:4], f"""exptoks AS (
  SELECT page_id, line_number, unnest(t) AS tok, unnest(range(0, len(t))) AS pos
  FROM (SELECT page_id, line_number, regexp_extract_all({S.expand_literals('ocr_prediction')}, {S.sql_str(S.TOKENS_RE)}) AS t FROM pairs))"""))
def stream_correct(spark, sf):
    """STR-2 with MOD-2: streamed expansion and correction by the published lexicon equals the batch result."""
    lexicons = f"{ST._work_dir(spark, 'lexicons')}/words"
    SC.publish_lexicon(_lexicon_parts(spark, sf)[1], lexicons)
    data = SC.stream_correct(spark, sf, lexicons, conversion=X.expand_literals)
    return spark.read.parquet(data).select("version", *KEY, "prediction")


@query("stream_window_cer", with_pairs(f"""
SELECT strftime(time_bucket(INTERVAL 1 day, CAST(e.ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL 1 day, CAST(e.ts AS TIMESTAMP)) + INTERVAL 1 day, '%Y-%m-%d %H:%M:%S') AS window_end,
       CAST(count(*) AS BIGINT) AS events, CAST(sum(d.errors) AS BIGINT) AS errors, CAST(sum(d.chars) AS BIGINT) AS chars,
       coalesce(CAST(sum(d.errors) AS DOUBLE) / nullif(sum(d.chars), 0), 0.0) AS cer
FROM events e JOIN docerr d ON e.event_id % (SELECT count(*) FROM documents) = d.page_id
GROUP BY ALL""", f"""docerr AS (SELECT page_id, sum(levenshtein({S.norm('ocr_prediction')}, {S.norm('text')})) AS errors,
                           sum(length({S.norm('text')})) AS chars FROM pairs GROUP BY page_id)"""))
def stream_window_cer(spark, sf):
    """STR-3: watermarked tumbling-window CER over event time (last state of each window = batch result)."""
    return ST.latest_windows(spark, ST.stream_window_cer(spark, sf))


@query("stream_arrivals_cer", with_pairs(f"""
SELECT strftime(time_bucket(INTERVAL 1 day, CAST(e.ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL 1 day, CAST(e.ts AS TIMESTAMP)) + INTERVAL 1 day, '%Y-%m-%d %H:%M:%S') AS window_end,
       CAST(count(*) AS BIGINT) AS events, CAST(sum(d.errors) AS BIGINT) AS errors, CAST(sum(d.chars) AS BIGINT) AS chars,
       coalesce(CAST(sum(d.errors) AS DOUBLE) / nullif(sum(d.chars), 0), 0.0) AS cer
FROM events e JOIN arrived d ON e.user_id = d.page_id AND CAST(e.ts AS TIMESTAMP) >= d.at AND CAST(e.ts AS TIMESTAMP) < d.at + INTERVAL 7 day
GROUP BY ALL""", f"""docerr AS (SELECT page_id, sum(levenshtein({S.norm('ocr_prediction')}, {S.norm('text')})) AS errors,
                           sum(length({S.norm('text')})) AS chars FROM pairs GROUP BY page_id)""",
    """arrived AS (SELECT doc_id AS page_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS at,
                   coalesce(errors, 0) AS errors, coalesce(chars, 0) AS chars
            FROM documents LEFT JOIN docerr ON docerr.page_id = doc_id)"""))
def stream_arrivals_cer(spark, sf):
    """STR-3 with both sides moving: watermarked stream-stream join, CER per day."""
    return SA.window_totals(spark, SA.stream_arrivals_cer(spark, sf))


@query("score_correlations", with_pairs("""
SELECT round(corr(CAST(input_length AS DOUBLE), CAST(edit_distance AS DOUBLE)), 6) AS corr_length_edit_distance,
       round(corr(CAST(input_length AS DOUBLE), CASE WHEN length(ground_truth) = 0 THEN 0.0
                  ELSE CAST(edit_distance AS DOUBLE) / length(ground_truth) END), 6) AS corr_length_cer,
       round(corr(CAST(s.edit_distance AS DOUBLE), b.bleu_score), 6) AS corr_edit_distance_bleu
FROM scores s JOIN bleu b ON s.page_id = b.page_id AND s.line_number = b.line_number""",
    PRED_CTE, SCORES_CTE, *S.bleu_ctes("predicted", "page_id,line_number", "prediction", "text")))
def score_correlations(spark, sf):
    """AGG-18: correlations behind the scatter plots (length vs distance, length vs CER, distance vs BLEU)."""
    return A.correlations(_scores(spark, sf, bleu=True))


@query("hist_bleu", with_pairs(_hist_sql("bleu_score").replace("FROM scores", "FROM (SELECT round(bleu_score, 12) AS bleu_score FROM bleu)"),
                               PRED_CTE, *S.bleu_ctes("predicted", "page_id,line_number", "prediction", "text")))
def hist_bleu(spark, sf):
    """AGG-17: 30-bin histogram of sentence BLEU (scores rounded to 12 places before binning)."""
    s = _scores(spark, sf, bleu=True).select(F.round("bleu_score", 12).alias("bleu_score"))
    h = A.histogram(s, "bleu_score")
    return h.select("bin", "lower", "upper", F.col("n").cast("bigint").alias("n"))


@query("decoded_examples", with_pairs(f"""
SELECT page_id, line_number, idx, split,
       substr(x, 1, len(list_filter(range(1, length(x) + 1), lambda k: strlen(substr(x, 1, k)) <= 127))) AS input_text,
       y AS label_text
FROM (SELECT page_id, line_number, idx, split, {S.sql_str(PREFIX_TRAIN)} || ocr_prediction AS x,
             substr(text, 1, len(list_filter(range(1, length(text) + 1), lambda k: strlen(substr(text, 1, k)) <= 127))) AS y
      FROM labeled WHERE split = 'train' ORDER BY idx LIMIT 2)""", SPLIT_CTE))
def decoded_examples(spark, sf):
    """TOP-3: the first 2 training examples decoded back from their byte tokens (a top-k by position)."""
    t = TR.tokenized(_split_pairs(spark, sf), KEY).where(F.col("split") == "train")
    first = TR.first_examples(t, 2)
    return first.select(*KEY, "idx", "split", decode_tokens("input_ids").alias("input_text"),
                        decode_tokens("labels").alias("label_text"))
