"""End-to-end jobs: the reference's entry points as Spark jobs.

* :func:`evaluation_job`   test CSV -> correct -> row scores -> metrics, error table, examples
* :func:`training_table_job` pair CSV -> profile -> training table (partitioned by split) + summary
* :func:`conversion_job`   CSV -> abbreviation expansion -> converted CSV + statistics
* :func:`inference_eval_job` JSONL -> prefix removal -> correct -> accuracies + results
* :func:`page_job`         segmentation + recognised lines -> corrected pages + reports

The row-score table is checkpointed once (shared checkpoint folder) because
the metrics, the error table, histograms and the top-k reports all read it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.expand import changed_flag, expand_abbreviations
from ..functions.text import remove_prefix, ws_strip
from ..operators import analysis as A
from ..operators import metrics as M
from ..operators import pages as P
from ..operators.correct import correct
from ..operators.pairs import default_line_ids, drop_incomplete
from ..operators.positions import global_index, split_report
from ..operators.scores import blank_short_circuit, fallback, score_parts
from ..operators.training import training_table
from ..schema import PREFIX_INFER
from ..session import ensure_checkpoint_dir
from ..sources import readers as R
from ..sources import sinks as K


def evaluation_job(spark: SparkSession, test_csv: str, out_dir: str, corrector=None, run: str | None = None) -> DataFrame:
    """Evaluate a corrector on a test CSV; writes metrics JSON, error CSV and examples; returns metrics.

    Without a corrector nothing is predicted, and the times are NULL.
    ``run`` names the evaluation in the metric log: repeated under its name, it replaces its row.
    """
    ensure_checkpoint_dir(spark)
    pairs = drop_incomplete(R.read_test_csv(spark, test_csv)).select(R.POSITION, "ocr_prediction", "text")
    indexed = global_index(pairs, [R.POSITION], "sample_id").drop(R.POSITION)
    t0 = time.time()  # AGG-10 times the prediction alone
    if corrector is None:
        fixed = indexed.withColumn("prediction", F.col("ocr_prediction"))
    else:
        fixed = correct(indexed, corrector, "ocr_prediction", "prediction").withColumn("prediction", ws_strip("prediction"))
    fixed = fallback(blank_short_circuit(fixed, "ocr_prediction", "prediction"), "ocr_prediction", "prediction")
    if corrector is not None:
        fixed = fixed.checkpoint(eager=True)
    elapsed = time.time() - t0 if corrector is not None else None
    scored = score_parts(fixed, "prediction", "text", ocr="ocr_prediction").checkpoint(eager=True)
    metrics = M.evaluate(scored).select("*", F.lit(elapsed).cast("double").alias("evaluation_time_seconds"),
                                        F.try_divide(F.col("total_samples").cast("double"), F.lit(elapsed).cast("double")).alias("samples_per_second"))
    K.write_evaluation_json(metrics, scored.select("sample_id", "bleu_score", F.col("ed").alias("edit_distance")), out_dir,
                            {"test_data": test_csv, "corrector": "none" if corrector is None else type(corrector).__name__, "run": run})
    K.append_metric_log(metrics.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("character_error_rate").alias("cer"),
                                       F.col("bleu_score_mean").alias("bleu"), F.col("edit_distance_mean").alias("edit_distance"),
                                       F.col("total_samples").alias("eval_samples")), f"{out_dir}/metrics_log", run)
    rows = scored.select("sample_id", F.col("ocr_prediction").alias("ocr_input"), "prediction",
                         F.col("text").alias("ground_truth"), F.col("ed").alias("edit_distance"), "bleu_score",
                         F.length("ocr_prediction").alias("input_length"), F.length("prediction").alias("output_length"),
                         F.length("text").alias("target_length"), F.col("ocr_ed").alias("ocr_errors"),
                         (F.col("ocr_ed") - F.col("ed")).alias("improvement"))
    K.write_rows_csv(rows.select("sample_id", "ocr_input", "prediction", "ground_truth", "edit_distance", "bleu_score",
                                 "input_length", "output_length", "target_length", "ocr_errors", "improvement"),
                     f"{out_dir}/detailed_error_analysis")
    worst = A.top_k(rows, "edit_distance", 10, tie=("sample_id",)).withColumn("rank", F.monotonically_increasing_id())
    best = A.top_k(rows, "improvement", 10, tie=("sample_id",)).withColumn("rank", F.monotonically_increasing_id())
    K.write_examples(worst, best, f"{out_dir}/error_examples")
    A.histogram(rows, "edit_distance").write.mode("overwrite").json(f"{out_dir}/hist_edit_distance")
    A.histogram(rows, "bleu_score").write.mode("overwrite").json(f"{out_dir}/hist_bleu")
    A.histogram(rows, "improvement").write.mode("overwrite").json(f"{out_dir}/hist_improvement")
    A.error_by_length(rows).write.mode("overwrite").json(f"{out_dir}/error_by_length")
    return metrics


def training_table_job(spark: SparkSession, pair_csv: str, out_dir: str, max_len: int = 128) -> DataFrame:
    """MOD-4 job: writes Parquet partitioned by split and a one-row summary; returns the split report."""
    raw = R.read_pair_csv(spark, pair_csv).select(R.POSITION, "ocr_prediction", "text")
    profile = M.dataset_profile(raw)
    t0 = time.time()
    table = training_table(raw, [R.POSITION], max_len=max_len).drop(R.POSITION)
    table.write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/training_table")
    written = spark.read.parquet(f"{out_dir}/training_table")
    report = split_report(written)
    K.write_metrics_json(profile.select(F.lit(pair_csv).alias("dataset_path"), "*", F.lit(max_len).alias("max_length"), F.lit(time.time() - t0).alias("preparation_seconds")),
                         f"{out_dir}/training_summary/profile")
    K.write_metrics_json(report, f"{out_dir}/training_summary/splits")
    return report


def conversion_job(spark: SparkSession, input_csv: str, output_csv: str | None = None) -> DataFrame:
    """Abbreviation expansion of a CSV's ``text`` column; returns the statistics row."""
    df = R.read_converter_csv(spark, input_csv)
    conv = df.drop(R.POSITION).withColumn("text_converted", expand_abbreviations("text"))
    K.write_rows_csv(conv, output_csv or K.converted_path(input_csv))
    stats = conv.agg(F.count(F.lit(1)).alias("total_rows"),
                     F.count_if(changed_flag("text", "text_converted")).alias("changed_rows"))
    return stats.select("*", F.round(F.try_divide(F.col("changed_rows") * 100.0, F.col("total_rows")), 1)
                        .alias("pct_changed"))


def inference_eval_job(spark: SparkSession, jsonl: str, out_dir: str, corrector=None,
                       prefix: str = PREFIX_INFER) -> DataFrame:
    """JSONL evaluation: exact match, truncated character accuracy, word accuracy (SNK-4)."""
    samples = R.read_jsonl(spark, jsonl)
    samples = default_line_ids(global_index(samples, [R.POSITION], "idx"))
    base = samples.select("idx", "line_id", remove_prefix("input", prefix).alias("original_ocr"),
                          F.col("target").alias("ground_truth"))
    fixed = (base.withColumn("prediction", F.col("original_ocr")) if corrector is None
             else correct(base, corrector, "original_ocr", "prediction").withColumn("prediction", ws_strip("prediction")))
    fixed = fallback(fixed, "original_ocr", "prediction")
    parts = fixed.select("*", D.exact_match("prediction", "ground_truth").alias("exact"),
                         D.truncated_char_matches("prediction", "ground_truth").alias("trunc_match"),
                         D.char_positions("prediction", "ground_truth").alias("char_total"),
                         D.word_matches("prediction", "ground_truth").alias("word_match"),
                         D.word_positions("prediction", "ground_truth").alias("word_total"))
    metrics = parts.agg(M.exact_match_rate().alias("exact_match_accuracy"),
                        M.char_accuracy_truncated().alias("character_accuracy"),
                        M.word_accuracy().alias("word_accuracy"), F.count(F.lit(1)).alias("total_samples"))
    K.write_metrics_json(metrics, f"{out_dir}/metrics")
    K.write_correction_results(parts.select("line_id", "original_ocr", "ground_truth", "prediction",
                                            F.col("exact").alias("exact_match")), f"{out_dir}/results")
    return metrics


def page_job(spark: SparkSession, segmentation: DataFrame, recognised: DataFrame, out_dir: str,
             corrector=None) -> DataFrame:
    """Pages: segmentation lines (+bbox) joined to recognised text, corrected, assembled, written.

    ``recognised``: page_id, line_number (1-based), ocr_text.  Returns the page summary.
    """
    lines = P.segmentation_lines(segmentation)
    lines = lines.withColumn("image_path", P.line_image_name("page_id", F.col("line_number") - 1))
    joined = lines.join(recognised, ["page_id", "line_number"], "left") \
        .withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
    fixed = (joined.withColumn("corrected_text", F.col("ocr_text")) if corrector is None
             else correct(joined, corrector, "ocr_text", "corrected_text").withColumn("corrected_text", ws_strip("corrected_text")))
    fixed = fixed.withColumn("corrected_text", F.when(ws_strip("ocr_text") == "", F.lit(""))
                             .otherwise(F.coalesce("corrected_text", "ocr_text")))
    blocks = P.assemble_blocks(fixed, "page_id", "line_number", "corrected_text")
    K.write_page_text(blocks, f"{out_dir}/pages")
    K.write_line_report(fixed, f"{out_dir}/reports")
    return P.page_summary(fixed, "page_id", "corrected_text")
