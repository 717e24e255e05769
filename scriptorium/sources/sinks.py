"""Writers for the reference's outputs (SNK-1..SNK-9).

Every sink is a DataFrame write executed by tasks; nothing is gathered on the
driver.  Per-page texts and reports are packed into files with an offset index
(:mod:`.pagefiles`): the number of files follows the tasks, not the pages, and
a very large page is a sequence of parts instead of one task.
"""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pagefiles import write_pages

# Report layout.
REPORT_TITLE = "DETAILED OCR CORRECTION RESULTS"
REPORT_RULE = "=" * 50
LINE_RULE = "-" * 30
FINAL_TITLE = "FINAL COMBINED TEXT:"
FINAL_RULE = "=" * 20
EXAMPLES_RULE = "=" * 60
EXAMPLE_RULE = "-" * 40
WORST_TITLE = "WORST CORRECTION CASES (Highest Edit Distance)"
BEST_TITLE = "BEST IMPROVEMENT CASES"


def write_page_text(blocks: DataFrame, out: str, page: str = "page_id") -> None:
    """SNK-1: the corrected text of every page (blocks in order, see AGG-16); read by ``pagefiles.read_pages``."""
    write_pages(blocks, out, page, ["block"], "text")


def write_line_report(lines: DataFrame, out: str, page: str = "page_id", source: str = "image_path",
                      device: str = "spark", page_source: str | None = None) -> None:
    """SNK-2: detailed per-line report per page (header, one block per line, combined text); read by ``pagefiles.read_pages``.

    ``lines``: page, line_number, ocr_text, corrected_text, image_path, optional bbox struct.
    ``page_source`` names the column with the page's own image; without it the header shows the page.
    """
    has_bbox = "bbox" in lines.columns
    bbox_txt = (F.when(F.col("bbox").isNotNull(), F.format_string(
        "\n  Bounding Box: [%d, %d, %d, %d]", "bbox.left", "bbox.top", "bbox.right", "bbox.bottom"))
        .otherwise(F.lit("")) if has_bbox else F.lit(""))
    body = lines.select(page, F.lit(1).alias("sec"), F.col("line_number").cast("bigint").alias("o"), F.concat(
        F.format_string("Line %d:\n  Original OCR: %s\n  Corrected:    %s\n  Image:        %s",
                        "line_number", F.coalesce("ocr_text", F.lit("")), F.coalesce("corrected_text", F.lit("")),
                        F.coalesce(F.col(source), F.lit(""))), bbox_txt, F.lit("\n" + LINE_RULE)).alias("t"))
    stats = lines.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.min(page_source or page).cast("string").alias("src"))
    head = stats.select(page, F.lit(0).alias("sec"), F.lit(0).cast("bigint").alias("o"), F.format_string(
        f"{REPORT_TITLE}\n{REPORT_RULE}\n\nSource Image: %s\nTotal Lines: %d\nProcessing Device: {device}\n",
        F.coalesce("src", F.lit("")), "n").alias("t"))
    foot = stats.select(page, F.lit(2).alias("sec"), F.lit(0).cast("bigint").alias("o"),
                        F.lit(f"\n{FINAL_TITLE}\n{FINAL_RULE}").alias("t"))
    final = lines.select(page, F.lit(3).alias("sec"), F.col("line_number").cast("bigint").alias("o"),
                         F.coalesce("corrected_text", F.lit("")).alias("t"))
    rows = head.unionByName(body).unionByName(foot).unionByName(final)
    write_pages(rows, out, page, ["sec", "o"], "t")


def write_metrics_json(metrics: DataFrame, out: str) -> None:
    """SNK-3 / SNK-4 metrics part / SNK-7: metric rows as JSON (non-ASCII kept)."""
    metrics.write.mode("overwrite").json(out)


def write_evaluation_json(metrics: DataFrame, scores: DataFrame, out: str, summary: dict[str, str | None]) -> None:
    """SNK-3: ``metrics`` with an ``evaluation_summary`` of the run, and the scores of every row.

    The reference's lists of row scores are JSON lines of their own under
    ``row_scores``, one per row with its ``sample_id``: one value holding them
    all would pass through one task.
    """
    about = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("evaluation_date"),
                     *[F.lit(v).cast("string").alias(k) for k, v in summary.items()])
    write_metrics_json(metrics.select("*", about.alias("evaluation_summary")), f"{out}/metrics")
    scores.write.mode("overwrite").json(f"{out}/row_scores")


def write_correction_results(results: DataFrame, out: str) -> None:
    """SNK-4 results part: line_id, original_ocr, ground_truth, prediction, exact_match."""
    results.write.mode("overwrite").json(out)


def write_rows_csv(rows: DataFrame, out: str) -> None:
    """SNK-5 / SNK-8: comma CSV with header, no index; white space around a cell's text stays."""
    rows.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(out)


def append_metric_log(row: DataFrame, out: str, batch: str | Column | None = None) -> None:
    """SNK-6: append metric rows to a CSV log.

    Rows belong to a batch, named by a key or by a column, and replace what the
    log holds of it, so an append that is repeated with its key adds nothing;
    without a key every append is a batch of its own.  Only a new log gets a header, kept apart from the rows
    under ``_header``; rows with other columns are refused.
    """
    spark = row.sparkSession
    key = batch if isinstance(batch, Column) else F.lit(batch or uuid.uuid4().hex)
    header = _log_header(spark, out)
    if header is None:
        spark.createDataFrame([(",".join(row.columns),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/_header")
    elif header != row.columns:
        raise ValueError(f"the log has the columns {header}, the rows {row.columns}")
    (row.select("*", key.alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").csv(out))


def _log_header(spark: SparkSession, out: str) -> list[str] | None:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_header/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return None
    return spark.read.text(f"{out}/_header").first()[0].split(",")


def read_metric_log(spark: SparkSession, out: str) -> DataFrame:
    """The rows of an SNK-6 log, all columns STRING, with the ``batch`` they came in."""
    columns = [*_log_header(spark, out), "batch"]
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(out)


def converted_path(input_file: str) -> str:
    """SNK-8 default name: ``<stem>_converted<suffix>`` next to the input."""
    p = PurePosixPath(input_file)
    return str(p.parent / f"{p.stem}_converted{p.suffix}")


def example_rows(worst: DataFrame, best: DataFrame) -> DataFrame:
    """SNK-9: the examples report as ordered text rows (sec, rank, text)."""
    w = worst.select(F.lit(1).alias("sec"), "rank", F.format_string(
        "Sample ID: %d\nOCR Input:    %s\nPrediction:   %s\nGround Truth: %s\nEdit Distance: %d\nBLEU Score: %.4f\n"
        + EXAMPLE_RULE + "\n", "sample_id", "ocr_input", "prediction", "ground_truth", "edit_distance",
        F.coalesce("bleu_score", F.lit(0.0))).alias("t"))
    b = best.select(F.lit(3).alias("sec"), "rank", F.format_string(
        "Sample ID: %d\nOCR Input:    %s\nPrediction:   %s\nGround Truth: %s\nImprovement: %d errors reduced\n"
        "BLEU Score: %.4f\n" + EXAMPLE_RULE + "\n", "sample_id", "ocr_input", "prediction", "ground_truth",
        "improvement", F.coalesce("bleu_score", F.lit(0.0))).alias("t"))
    spark = worst.sparkSession
    heads = spark.createDataFrame([(0, 0, f"{WORST_TITLE}\n{EXAMPLES_RULE}\n"),
                                   (2, 0, f"\n{BEST_TITLE}\n{EXAMPLES_RULE}\n")], "sec int, rank int, t string")
    return heads.unionByName(w).unionByName(b)


def write_examples(worst: DataFrame, best: DataFrame, out: str) -> None:
    """SNK-9: worst / best examples text (20 rows: a top-k, one output file)."""
    example_rows(worst, best).coalesce(1).sortWithinPartitions("sec", "rank").select("t") \
        .write.mode("overwrite").text(out)
