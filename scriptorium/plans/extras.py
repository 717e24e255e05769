"""Registered queries for operators that the derived line pairs alone do not exercise.

Each takes whole driver tables and derives the missing feature (NULLs, blank
lines, combining marks, abbreviation keys, missing ids) by a rule that both
Spark and the SQL evaluate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expand as X
from ..functions.bitdistance import page_edit_distance
from ..functions.text import base_name, ws_normalize
from ..functions.tokens import argmax, decode_tokens, greedy_ids, greedy_text
from ..operators import metrics as M
from ..operators import pages as P
from ..operators import pairs as PR
from ..operators import spell as SP
from ..operators import training as TR
from ..operators.align import align_pages
from ..operators.correct import BatchCorrector, apply_lexicon, correct
from ..operators.scores import blank_short_circuit, fallback
from ..sources.fixture import evenly, load_pairs, noise, read_table
from ..session import ensure_checkpoint_dir
from ..sources.pagefiles import read_pages, write_pages
from ..sources.readers import na_to_null, read_csv_strings
from ..sources.sinks import append_metric_log, read_metric_log, write_rows_csv
from ..streaming.streams import utc_event_time, utc_text
from ..functions.distance import normalized_edit_distance
from . import sqlparts as S
from .catalogue import LEX_CTES, _split_pairs
from .registry import query

KEY = ["page_id", "line_number"]


@query("url_base_names", """
SELECT page_id, CASE WHEN seg = '' THEN 'image' ELSE regexp_replace(seg, '(.)\\.[^.]+$', '\\1') END AS base_name
FROM (SELECT page_id, list_extract(string_split(url, '/'), -1) AS seg FROM pages)""")
def url_base_names(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-6 on page addresses."""
    return read_table(spark, sf, "pages").select("page_id", base_name("url").alias("base_name"))


@query("na_strings", """
SELECT event_id, CASE WHEN x IN ('', 'NA', 'null', 'N/A', 'None', 'nan') THEN NULL ELSE x END AS cell
FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN 'N/A ' WHEN 4 THEN 'None'
                            WHEN 5 THEN 'nan' WHEN 6 THEN 'N/A' WHEN 7 THEN 'na' ELSE event_type END AS x FROM events)""")
def na_strings(spark, sf):
    """SRC-8: cells read as missing become NULL, others stay."""
    cells = F.array(*[F.lit(x) for x in ("NA", "", "null", "N/A ", "None", "nan", "N/A", "na")])
    cell = F.coalesce(F.get(cells, (F.col("event_id") % 9).cast("int")), F.col("event_type"))
    return na_to_null(read_table(spark, sf, "events").select("event_id", cell.alias("cell")))


@query("corrected_or_kept", S.with_pairs(f"""
SELECT page_id, line_number,
       CASE WHEN {S.strip('o')} = '' THEN '' WHEN line_number % 3 = 0 THEN o ELSE '<' || o || '>' END AS prediction
FROM (SELECT page_id, line_number, CASE WHEN line_number % 5 = 2 THEN ' ' || chr(9) ELSE ocr_prediction END AS o FROM pairs)"""))
def corrected_or_kept(spark, sf):
    """PRJ-5 and PRJ-6: blank lines become empty, lines without a correction keep their input."""
    lines = load_pairs(spark, sf).withColumn("o", F.when(F.col("line_number") % 5 == 2, F.lit(" \t")).otherwise(F.col("ocr_prediction")))
    some = lines.withColumn("prediction", F.when(F.col("line_number") % 3 != 0, F.concat(F.lit("<"), F.col("o"), F.lit(">"))))
    return fallback(blank_short_circuit(some, "o", "prediction"), "o", "prediction").select(*KEY, "prediction")


@query("sample_ids", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'sample_' || CAST(doc_id AS VARCHAR) ELSE lang || CAST(doc_id AS VARCHAR) END AS line_id FROM documents""")
def sample_ids(spark, sf):
    """PRJ-8: numbered ids where none is given."""
    given = F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.col("doc_id").cast("string")))
    return PR.default_line_ids(read_table(spark, sf, "documents").select("doc_id", given.alias("line_id")), idx="doc_id")


@query("event_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def event_times(spark, sf):
    """SCA-16: time stamps as text, whatever the session's time zone."""
    return read_table(spark, sf, "events").select("event_id", utc_text(utc_event_time("ts")).alias("at"))


@query("event_properties", """
SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k,
       '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS as_json FROM events""")
def event_properties(spark, sf):
    """SCA-17: JSON read and written."""
    return read_table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"),
                                                  F.to_json(F.struct("event_id", "event_type")).alias("as_json"))


def _load_example_model():
    def fix(texts):
        if any("qu" in t for t in texts):
            raise ValueError("the example model does not know this pair of letters")
        return [t.replace("tb", "th") + " " for t in texts]
    return fix


@query("batch_correction", S.with_pairs(f"""
SELECT page_id, line_number, strpos(ocr_prediction, 'qu') > 0 AS correction_failed,
       CASE WHEN {S.strip('ocr_prediction')} = '' THEN '' WHEN strpos(ocr_prediction, 'qu') > 0 THEN ocr_prediction
            ELSE {S.strip("replace(ocr_prediction, 'tb', 'th')")} END AS prediction
FROM pairs"""))
def batch_correction(spark, sf):
    """MOD-1 with a batch model that fails on some lines: those alone keep their input."""
    lines = load_pairs(spark, sf, keep=()).select(*KEY, "ocr_prediction")
    return correct(lines, BatchCorrector(_load_example_model, 64)).select(*KEY, "correction_failed", "prediction")


@query("strip_injected_marks", S.with_pairs("""
SELECT page_id, line_number, text AS text_unmarked,
       CAST(2 * (length(text) - length(replace(text, 'e', ''))) + length(text) - length(replace(text, 'a', '')) AS BIGINT) AS marks_removed
FROM pairs"""))
def strip_injected_marks(spark, sf):
    """SCA-6b on lines whose letters e and a carry combining marks."""
    marked = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("e\u0301\u0304")), F.lit("a"), F.lit("a\u0303"))
    lines = load_pairs(spark, sf, keep=()).select(*KEY, marked.alias("marked"))
    return lines.select(*KEY, X.strip_marks("marked").alias("text_unmarked"),
                        (F.length("marked") - F.length(X.strip_marks("marked"))).cast("bigint").alias("marks_removed"))


# Some abbreviation keys, with what the literal rules make of each.
INJECTED = [("ṽ", "ṽ"), ("xpo", "cristo"), ("ꝑ", "per"), ("dñs", "dnns"), ("nō", "non"), ("ſ", "s"), ("&c", "etc"), ("ꝯ", "con"), ("q̄", "que"), ("ł", "l")]


@query("expand_injected", S.with_pairs(f"""
SELECT page_id, line_number, ([{', '.join(S.sql_str(v) for _, v in INJECTED)}])[CAST(line_number % {len(INJECTED)} AS INTEGER) + 1] AS expanded,
       CAST(line_number % {len(INJECTED)} <> 0 AS BOOLEAN) AS changed
FROM pairs"""))
def expand_injected(spark, sf):
    """SCA-5 and PRJ-9 on an abbreviation key per line."""
    key = F.get(F.array(*[F.lit(k) for k, _ in INJECTED]), (F.col("line_number") % len(INJECTED)).cast("int"))
    lines = load_pairs(spark, sf, keep=()).select(*KEY, key.alias("key"))
    return lines.select(*KEY, X.expand_literals("key").alias("expanded"), X.changed_flag("key", X.expand_literals("key")).alias("changed"))


@query("segmentation_branches", """
SELECT vec_id, CAST(1 AS INTEGER) AS line_number, least(a, c) AS "left", least(b, d) AS top, greatest(a, c) AS "right", greatest(b, d) AS bottom
FROM (SELECT vec_id, CAST(trunc(CAST(embedding[1] AS DOUBLE) * 1000) AS INTEGER) AS a, CAST(trunc(CAST(embedding[2] AS DOUBLE) * 1000) AS INTEGER) AS b,
             CAST(trunc(CAST(embedding[3] AS DOUBLE) * 1000) AS INTEGER) AS c, CAST(trunc(CAST(embedding[4] AS DOUBLE) * 1000) AS INTEGER) AS d FROM embeddings)
UNION ALL
SELECT vec_id, CAST(3 AS INTEGER), 1, 2, 3, CAST(4 + vec_id % 5 AS INTEGER) FROM embeddings""")
def segmentation_branches(spark, sf):
    """PRJ-7, PRJ-12, PRJ-13: a line with a polygon, one without anything (skipped, its number kept), one with a box only."""
    at = lambda i: (F.get("embedding", F.lit(i)).cast("double") * 1000).cast("int")
    none = F.lit(None).cast("array<array<int>>")
    line = lambda boundary, box: F.struct(boundary.alias("boundary"), none.alias("baseline"), box.alias("bbox"))
    no_box = F.lit(None).cast("array<int>")
    box = F.array(F.lit(1), F.lit(2), F.lit(3), (4 + F.col("vec_id") % 5).cast("int"))
    seg = read_table(spark, sf, "embeddings").select(
        "vec_id", F.lit(None).cast("string").alias("text_direction"), F.lit(None).cast("string").alias("type"),
        F.array(line(F.array(F.array(at(0), at(1)), F.array(at(2), at(3))), no_box), line(none, no_box), line(none, box)).alias("lines"))
    return P.segmentation_lines(seg, "vec_id").select("vec_id", "line_number", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom")


RAW_CTE = f"""raw AS (
  SELECT lang, {S.norm('t')} AS nt, {S.norm("replace(replace(replace(translate(t, 'uc', 'ne'), 'm', 'rn'), 'th', 'tb'), 'li', 'h')")} AS np
  FROM (SELECT lang, unnest(string_split(text, chr(10))) AS t FROM documents))"""


@query("cer_raw_lines", f"""WITH {RAW_CTE}
SELECT lang, CAST(sum({S.lev('np', 'nt')}) AS BIGINT) AS total_errors, CAST(sum(length(nt)) AS BIGINT) AS total_chars, CAST(max(length(nt)) AS BIGINT) AS longest,
       coalesce(CAST(sum({S.lev('np', 'nt')}) AS DOUBLE) / nullif(sum(length(nt)), 0), 0.0) AS cer
FROM raw GROUP BY lang""")
def cer_raw_lines(spark, sf):
    """SCA-1 and AGG-1 on lines of any length, as the texts have them."""
    documents = evenly(read_table(spark, sf, "documents").select("lang", "text"))
    lines = documents.select("lang", F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.select("lang", ws_normalize(noise("text", F.lit(1))).alias("np"), ws_normalize("text").alias("nt"))
    scored = lines.select("lang", page_edit_distance("np", "nt").alias("ed_norm"), F.length("nt").alias("ref_norm_len"))
    return scored.groupBy("lang").agg(F.sum("ed_norm").cast("bigint").alias("total_errors"), F.sum("ref_norm_len").cast("bigint").alias("total_chars"),
                                      F.max("ref_norm_len").cast("bigint").alias("longest"), M.cer().alias("cer"))


@query("align_drift", S.with_pairs("""
SELECT page_id, CAST(count(*) FILTER (WHERE paired) AS BIGINT) AS n_paired, CAST(coalesce(sum(CASE WHEN paired THEN 0 WHEN lost THEN 1 ELSE 2 END), 0) AS BIGINT) AS n_alone,
       CAST(sum(CASE WHEN paired THEN d WHEN lost THEN length(text) ELSE length(text) + length(ocr_prediction) END) AS BIGINT) AS distance
FROM (SELECT *, NOT lost AND 2 * d <= greatest(length(text), length(ocr_prediction)) AS paired
      FROM (SELECT page_id, text, ocr_prediction, levenshtein(ocr_prediction, text) AS d, (line_number + page_id) % 17 = 5 AS lost FROM pairs))
GROUP BY page_id"""))
def align_drift(spark, sf):
    """JOI-2 on pages whose recognition lost every 17th line, so that the others move up.

    The SQL knows which lines were lost; the operator has to find out.  A page
    whose lines allow a cheaper alignment than the true one differs from the SQL.
    """
    pairs = load_pairs(spark, sf, keep=())
    page, n = F.col("page_id"), F.col("line_number")
    lost_before = F.floor((n + page + 11) / 17) - F.floor((page + 11) / 17)
    left = pairs.where((n + page) % 17 != 5).select(page, (n - lost_before).cast("bigint").alias("line_number"), "ocr_prediction")
    both = F.col("line_number").isNotNull() & F.col("aligned_line").isNotNull()
    return (align_pages(left, pairs.select(*KEY, "text")).groupBy("page_id")
            .agg(F.count_if(both).alias("n_paired"), F.count_if(~both).alias("n_alone"), F.sum("distance").cast("bigint").alias("distance")))


def _letters_sql(pick: str) -> str:
    """Eight letters of an embedding: per eight components the place of the first largest or smallest, none for place 0."""
    part = "embedding[CAST(p * 8 + 1 AS BIGINT):CAST(p * 8 + 8 AS BIGINT)]"
    return f"list_transform(range(0, 8), lambda p: CAST(list_position({part}, {pick}({part})) - 1 AS INTEGER))"


def _text_sql(ids: str) -> str:
    return f"array_to_string(list_transform({ids}, lambda i: CASE WHEN i = 0 THEN '' ELSE chr(CAST(96 + i AS INTEGER)) END), '')"


LOGIT_CTE = f"""logit_texts AS (SELECT vec_id, label, {_text_sql(_letters_sql('list_max'))} AS prediction, {_text_sql(_letters_sql('list_min'))} AS text FROM embeddings)"""


def _logits(spark, sf):
    """``embeddings`` as 8 positions x 107 ids, seven of which are letters and one the pad; label ids with -100 for the pad."""
    eight = lambda p: F.slice("embedding", p * 8 + 1, 8)
    low = F.array_repeat(F.lit(-9.0).cast("float"), 99)
    scores = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.concat(F.slice(eight(p), 1, 1), low, F.slice(eight(p), 2, 7)))
    least = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: argmax(F.transform(eight(p), lambda x: -x)))
    labels = F.transform(least, lambda i: F.when(i == 0, F.lit(-100)).otherwise(99 + i))
    return read_table(spark, sf, "embeddings").select("vec_id", "label", "embedding", scores.alias("logits"), labels.alias("labels"))


@query("greedy_text", f"""WITH {LOGIT_CTE}
SELECT t.vec_id, prediction, text, array_to_string({_letters_sql('list_max')}, ',') AS packed_ids FROM logit_texts t JOIN embeddings e ON t.vec_id = e.vec_id""")
def greedy_text_q(spark, sf):
    """SCA-7c on positions x vocabulary, nested and packed, to ids and to text."""
    return _logits(spark, sf).select("vec_id", greedy_text("logits").alias("prediction"), decode_tokens("labels").alias("text"),
                                     F.array_join(greedy_ids("embedding", 8), ",").alias("packed_ids"))


@query("logit_metrics", "WITH " + ",\n".join([LOGIT_CTE, *S.bleu_ctes("logit_texts", "vec_id", "prediction", "text")]) + """
SELECT label, coalesce(CAST(sum(levenshtein(prediction, text)) AS DOUBLE) / nullif(sum(length(text)), 0), 0.0) AS cer, round(avg(bleu_score), 6) AS bleu,
       round(avg(levenshtein(prediction, text)), 6) AS edit_distance, CAST(count(*) AS BIGINT) AS eval_samples
FROM logit_texts JOIN bleu USING (vec_id) GROUP BY label""")
def logit_metrics(spark, sf):
    """Metrics of model output given as scores and padded labels."""
    m = TR.evaluate_logits(_logits(spark, sf), "logits", "labels", by=["label"])
    return m.select("label", "cer", F.round("bleu", 6).alias("bleu"), F.round("edit_distance", 6).alias("edit_distance"), F.col("eval_samples").cast("bigint").alias("eval_samples"))


def _char_codes(x: str) -> str:
    """A word whose letters beyond ASCII are single bytes: they are at most 31 in these texts."""
    return f"translate({x}, (SELECT letters FROM beyond), (SELECT codes FROM beyond))"


#: Verified words of the training split, unseen words of the test split, and all candidates by comparing every pair of suitable length.
SPELL_CTES = [*LEX_CTES[:4], f"""voc AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS word FROM labeled WHERE split = 'train') GROUP BY word)""",
              f"""unseen AS MATERIALIZED (
  SELECT DISTINCT word FROM (SELECT unnest({S.words('ocr_prediction')}) AS word FROM labeled WHERE split = 'test')
  WHERE word NOT IN (SELECT ocr_word FROM lex) AND word NOT IN (SELECT word FROM voc))""",
              """beyond AS MATERIALIZED (
  SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS letters, coalesce(string_agg(chr(CAST(i AS INTEGER)), '' ORDER BY c), '') AS codes FROM (
    SELECT c, row_number() OVER (ORDER BY c) AS i FROM (
      SELECT DISTINCT unnest(string_split(word, '')) AS c FROM (SELECT word FROM voc UNION ALL SELECT word FROM unseen)) WHERE ord(c) > 127))""",
              f"""asked AS MATERIALIZED (SELECT word, {_char_codes('word')} AS w, least(2, length(word) // 3) AS k FROM unseen WHERE length(word) >= 3)""",
              f"""offered AS MATERIALIZED (SELECT word AS candidate, {_char_codes('word')} AS v, n FROM voc WHERE n >= 2)""",
              """found AS MATERIALIZED (
  SELECT word, candidate, n, levenshtein(w, v) AS distance, k FROM asked JOIN offered ON abs(length(w) - length(v)) <= k WHERE levenshtein(w, v) <= k)"""]


def _spelling(spark, sf):
    s = _split_pairs(spark, sf)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    learned = SP.learn(train)
    unknown = SP.unknown_words(test, learned.lexicon, learned.vocabulary)
    return learned, test, SP.candidates(unknown, learned.vocabulary.where(F.col("n") >= SP.MIN_SEEN))


@query("spell_candidates", S.with_pairs("SELECT word, candidate, CAST(n AS BIGINT) AS n, CAST(distance AS BIGINT) AS distance FROM found", *SPELL_CTES))
def spell_candidates(spark, sf):
    """MOD-2 for unseen words: the verified words within the allowed edits of each."""
    return _spelling(spark, sf)[2].select("word", "candidate", "n", "distance")


def _prefix_sql(a: str, b: str) -> str:
    return f"coalesce(list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)), true) - 1, least(length({a}), length({b})))"


def _parts_sql(src: str, a: str, b: str, more: str) -> str:
    """Two words without their common start and end."""
    return f"""SELECT {more}, substr(a, 1, length(a) - e) AS a, substr(b, 1, length(b) - e) AS b FROM (
  SELECT *, {_prefix_sql('reverse(a)', 'reverse(b)')} AS e FROM (
    SELECT *, substr({a}, p + 1) AS a, substr({b}, p + 1) AS b FROM (SELECT *, {_prefix_sql(a, b)} AS p FROM {src})))"""


RANK_CTES = [f"""chars AS (
  SELECT a, b, count(*) AS n FROM (SELECT unnest(string_split(ocr_word, '')) AS a, unnest(string_split(text_word, '')) AS b FROM wp WHERE length(ocr_word) = length(text_word))
  WHERE a <> b GROUP BY a, b)""",
             f"""swaps AS (
  SELECT a, b, count(*) AS n FROM ({_parts_sql('(SELECT * FROM wp WHERE ocr_word <> text_word)', 'ocr_word', 'text_word', 'ocr_word')})
  WHERE length(a) <= 3 AND length(b) <= 3 AND NOT (length(a) = 1 AND length(b) = 1) GROUP BY a, b)""",
             "weights AS MATERIALIZED (SELECT a, b, CAST(floor(100 * ln(1.0 + n)) AS BIGINT) AS known FROM (SELECT * FROM chars UNION ALL SELECT * FROM swaps))",
             "every AS MATERIALIZED (SELECT CAST(floor(100 * ln(1.0 + coalesce(sum(n), 0))) AS BIGINT) AS total FROM (SELECT n FROM chars UNION ALL SELECT n FROM swaps))",
             f"""pieces AS (
  SELECT word, candidate, n, distance, 1 AS how, a, b, distance AS edits FROM ({_parts_sql('found', 'word', 'candidate', 'word, candidate, n, distance')})
  UNION ALL
  SELECT word, candidate, n, distance, 2, a, b, 1 FROM (
    SELECT *, unnest(string_split(word, '')) AS a, unnest(string_split(candidate, '')) AS b FROM found
    WHERE length(word) = length(candidate)
      AND distance = len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr(candidate, i, 1)))) WHERE a <> b)""",
             """priced AS (
  SELECT word, candidate, n, distance, min(cost) AS cost FROM (
    SELECT word, candidate, n, distance, how, sum(CASE WHEN known IS NULL THEN edits * total ELSE total - known END) AS cost
    FROM pieces LEFT JOIN weights USING (a, b), every GROUP BY word, candidate, n, distance, how) GROUP BY word, candidate, n, distance)""",
             """chosen AS (
  SELECT word AS ocr_word, candidate AS text_word, score FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, distance, n DESC, candidate) AS r
    FROM (SELECT *, CAST(floor(100 * ln(1.0 + n)) AS BIGINT) - cost AS score FROM priced)) WHERE r = 1 AND score > 0)"""]


@query("spell_corrections", S.with_pairs("SELECT ocr_word, text_word, CAST(score AS BIGINT) AS score FROM chosen", *SPELL_CTES, *RANK_CTES))
def spell_corrections(spark, sf):
    """MOD-2 and MOD-3 together: what unseen words are corrected to."""
    learned, _, found = _spelling(spark, sf)
    return SP.corrections(found, learned.weights).select("ocr_word", "text_word", "score")


@query("spell_evaluation", S.with_pairs(f"""
SELECT CAST(sum(before) AS DOUBLE) / sum(length(nt)) AS cer_lexicon, CAST(sum(after) AS DOUBLE) / sum(length(nt)) AS cer_spelled,
       CAST(count(*) FILTER (WHERE after < before) AS BIGINT) AS lines_better, CAST(count(*) FILTER (WHERE after > before) AS BIGINT) AS lines_worse
FROM (SELECT nt, {S.lev('nl', 'nt')} AS before, {S.lev('ns', 'nt')} AS after FROM (
  SELECT {S.norm('any_value(l.text)')} AS nt,
         {S.norm("coalesce(string_agg(coalesce(x.text_word, k.tok), '' ORDER BY k.pos), '')")} AS nl,
         {S.norm("coalesce(string_agg(coalesce(x.text_word, c.text_word, k.tok), '' ORDER BY k.pos), '')")} AS ns
  FROM labeled l LEFT JOIN toks k ON l.page_id = k.page_id AND l.line_number = k.line_number
       LEFT JOIN lex x ON k.tok = x.ocr_word LEFT JOIN chosen c ON k.tok = c.ocr_word
  WHERE l.split = 'test' GROUP BY l.page_id, l.line_number))""", *SPELL_CTES, LEX_CTES[4], *RANK_CTES))
def spell_evaluation(spark, sf):
    """Error rate of the held-out split with the lexicon alone and with corrected unseen words."""
    learned, test, _ = _spelling(spark, sf)
    both = SP.extended(learned.lexicon, learned, test)
    out = apply_lexicon(apply_lexicon(test.select(*KEY, "ocr_prediction", "text"), learned.lexicon, KEY, out="by_lexicon"), both, KEY)
    parts = out.select(normalized_edit_distance("by_lexicon", "text").alias("before"), normalized_edit_distance("prediction", "text").alias("after"),
                       F.length(ws_normalize("text")).alias("n"))
    return parts.agg(M.cer("before", "n").alias("cer_lexicon"), M.cer("after", "n").alias("cer_spelled"),
                     F.count_if(F.col("after") < F.col("before")).cast("bigint").alias("lines_better"),
                     F.count_if(F.col("after") > F.col("before")).cast("bigint").alias("lines_worse"))


@query("packed_pages", S.with_pairs("""
SELECT page_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM pairs GROUP BY page_id"""))
def packed_pages(spark, sf):
    """SNK-1: all pages written into packed files and read back through their offset index."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/packed-pages-{uuid.uuid4().hex}"
    write_pages(load_pairs(spark, sf, keep=()), out, "page_id", ["line_number"], "text")
    parts = read_pages(spark, out)
    return parts.groupBy(F.col("page").cast("bigint").alias("page_id")).agg(
        F.sum(F.regexp_count("text", F.lit("\n"))).cast("bigint").alias("n_lines"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"))


@query("metric_log_append", S.with_pairs("""
SELECT lang AS batch, CAST(count(*) AS VARCHAR) AS eval_samples, CAST(sum(length(text)) AS VARCHAR) AS chars FROM pairs GROUP BY lang"""))
def metric_log_append(spark, sf):
    """SNK-6: one batch per language appended to a log, all of them twice; each is one row."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/metric-log-{uuid.uuid4().hex}"
    rows = load_pairs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("eval_samples"), F.sum(F.length("text")).alias("chars"))
    for _ in range(2):
        append_metric_log(rows, out, F.col("lang"))
    return read_metric_log(spark, out).select("batch", "eval_samples", "chars")


@query("quoted_csv", """
SELECT doc_id, CAST(length(cell) AS BIGINT) AS chars, md5(cell) AS text_md5
FROM (SELECT doc_id, CASE WHEN text IN ('', 'NA', 'null', 'N/A', 'None', 'nan') THEN NULL
                          ELSE replace(text, chr(13) || chr(10), chr(10)) END AS cell FROM documents)""")
def quoted_csv(spark, sf):
    """SRC-1: whole texts, line breaks and quotes included, written as CSV and read back by byte ranges."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quoted-csv-{uuid.uuid4().hex}"
    write_rows_csv(read_table(spark, sf, "documents").select("doc_id", "text"), out)
    rows = read_csv_strings(spark, out, ",", ["doc_id", "text"], by_ranges=True)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


@query("segmentation_defaults", """
SELECT vec_id, CAST(1 AS INTEGER) AS line_number, CASE WHEN vec_id % 3 = 0 THEN 'vertical-rl' ELSE 'horizontal-lr' END AS text_direction,
       CASE WHEN vec_id % 2 = 0 THEN 'polygon' ELSE 'baseline' END AS type, vec_id % 5 = 0 AS has_baseline, TRUE AS no_boundary
FROM embeddings""")
def segmentation_defaults(spark, sf):
    """PRJ-12: direction and type as given, or their defaults; parts that a line does not have are NULL."""
    given = lambda n, value: F.when(F.col("vec_id") % n == 0, F.lit(value))
    baseline = F.when(F.col("vec_id") % 5 == 0, F.array(F.array(F.lit(1), F.lit(2))))
    seg = read_table(spark, sf, "embeddings").select(
        "vec_id", given(3, "vertical-rl").alias("text_direction"), given(2, "polygon").alias("type"),
        F.array(F.struct(F.lit(None).cast("array<array<int>>").alias("boundary"), baseline.alias("baseline"),
                         F.array(*map(F.lit, (1, 2, 3, 4))).alias("bbox"))).alias("lines"))
    lines = P.segmentation_lines(seg, "vec_id")
    return lines.select("vec_id", "line_number", "text_direction", "type", F.col("baseline").isNotNull().alias("has_baseline"),
                        F.col("boundary").isNull().alias("no_boundary"))
