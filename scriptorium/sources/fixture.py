"""Line pairs derived from the ``documents`` table.

The driver data has no OCR column, so pairs are derived by a fixed rule that
both Spark and the SQL oracle evaluate identically:

* page = ``documents`` row (``page_id = doc_id``),
* lines = consecutive runs of up to 48 characters that never cross ``\\n``,
* ``line_number`` = 0-based position, ``line_id = page_id || '_line_' || n``,
* ``ocr_prediction`` = deterministic ASCII noise (substitute ``u->n``,
  ``c->e``; insert ``m->rn``; delete `` a``/``li->h``), every 4th line clean.

The explode is narrow (no shuffle).  Documents vary from one word to twenty
thousand, so a single scan task can emit most lines; ahead of CPU-heavy
scoring :func:`spread` evens lines out, with a partition count that AQE takes
from the data's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import paged_index

LINE_PATTERN = ".{1,48}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def noise(text, line_number):
    """Fixed OCR noise of the fixture (FIXTURES §2)."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.col(line_number) if isinstance(line_number, str) else line_number
    base = F.replace(F.replace(F.replace(t, F.lit("u"), F.lit("n")), F.lit("c"), F.lit("e")), F.lit("m"), F.lit("rn"))
    return (F.when(n % 4 == 0, t)
            .when(n % 7 == 0, F.replace(base, F.lit(" a"), F.lit(" ")))
            .otherwise(F.replace(F.replace(base, F.lit("th"), F.lit("tb")), F.lit("li"), F.lit("h"))))


def document_lines(documents: DataFrame, keep=("lang", "source")) -> DataFrame:
    """WIN-2 / UDF-4: page -> (page_id, line_number, text, *keep)."""
    return documents.select(
        F.col("doc_id").alias("page_id"), *keep,
        F.posexplode(F.regexp_extract_all("text", F.lit(LINE_PATTERN), 0)).alias("line_number", "text"),
    ).withColumn("line_number", F.col("line_number").cast("bigint"))


def with_noise(lines: DataFrame, keep=("lang", "source")) -> DataFrame:
    """Add ``line_id`` and ``ocr_prediction`` to (page_id, line_number, text, *keep)."""
    return lines.select(
        "page_id", "line_number", *keep,
        F.concat(F.col("page_id").cast("string"), F.lit("_line_"), F.col("line_number").cast("string")).alias("line_id"),
        "text",
        noise("text", "line_number").alias("ocr_prediction"),
    )


def line_pairs(documents: DataFrame, keep=("lang", "source")) -> DataFrame:
    """The derived line-pair table: page_id, line_number, line_id, text, ocr_prediction (+ keep)."""
    return with_noise(document_lines(documents, keep), keep)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance lines on (page_id, line_number): even tasks even when one page is huge."""
    return df.hint("rebalance", "page_id", "line_number")


def load_pairs(spark: SparkSession, sf_dir: str, keep=("lang", "source"), spread_out: bool = False) -> DataFrame:
    """Line pairs of the ``documents`` table.  With ``spread_out`` the exploded
    lines are hashed across tasks first and the noise is computed after the
    shuffle, in parallel."""
    lines = document_lines(read_table(spark, sf_dir, "documents"), keep)
    return with_noise(spread(lines) if spread_out else lines, keep)


def evenly(df: DataFrame) -> DataFrame:
    """A table's rows dealt to all cores if its scan has fewer tasks than there are cores; unchanged otherwise.

    For small files only: a large table has tasks enough, and its rows stay where they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def indexed_pairs(spark: SparkSession, sf_dir: str, keep=(), out: str = "idx", with_total: str | None = None) -> DataFrame:
    """Line pairs with their dense 0-based index in (page, line) order; no line leaves the task that explodes it."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", *keep)
    return paged_index(evenly(documents), F.regexp_count("text", F.lit(LINE_PATTERN)), lambda pages, more: with_noise(document_lines(pages, [*keep, *more]), [*keep, *more]),
                       out=out, with_total=with_total)
