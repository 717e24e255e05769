"""Streamed expansion and learned correction with a versioned lexicon (STR-2, MOD-2).

A lexicon is published as the next ``version=N`` of a folder and is complete
once its ``_SUCCESS`` marker is there.  Every micro-batch takes the newest
complete version, and writes down which one it was before it writes a line.  A
batch that is replayed after a failure finds that note and uses the same
version again, whatever has been published since, so its output (one folder per
batch, written with overwrite) does not depend on when it was run.

Batches before the first version are expanded and not corrected (version 0).
A NULL line has the prediction ''.  Repeated lines are corrected alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expand as X
from ..operators.correct import apply_lexicon
from ..sources.fixture import evenly, line_pairs
from .streams import _work_dir, table_stream

KEY = ("page_id", "line_number")


def _found(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().getParent().getName() for s in status or []]


def latest_version(spark: SparkSession, lexicons: str) -> int:
    """Newest complete version in the folder; 0 if there is none."""
    return max((int(name.split("=")[1]) for name in _found(spark, f"{lexicons}/version=*/_SUCCESS")), default=0)


def publish_lexicon(lexicon: DataFrame, lexicons: str) -> int:
    """Write ``lexicon`` (ocr_word, text_word, ...) as the next version; one publisher at a time."""
    version = latest_version(lexicon.sparkSession, lexicons) + 1
    lexicon.write.mode("overwrite").parquet(f"{lexicons}/version={version}")
    return version


def _version_of_batch(spark: SparkSession, note: str, lexicons: str) -> int:
    """The version noted for a batch, or the newest one, which is noted first."""
    if not _found(spark, f"{note}/_SUCCESS"):
        newest = latest_version(spark, lexicons)
        spark.range(1).select(F.lit(newest).cast("bigint").alias("version")).write.mode("overwrite").parquet(note)
    return spark.read.parquet(note).first()["version"]


def corrected(lines: DataFrame, lexicon: DataFrame | None, conversion=X.expand_abbreviations) -> DataFrame:
    """(page_id, line_number, ocr_prediction, prediction): expansion, then the lexicon's words."""
    expanded = lines.select(*KEY, "ocr_prediction", conversion("ocr_prediction").alias("_expanded"))
    if lexicon is None:
        return expanded.select(*KEY, "ocr_prediction", F.coalesce("_expanded", F.lit("")).alias("prediction"))
    fixed = apply_lexicon(expanded, lexicon, KEY, src="_expanded")
    return fixed.select(*KEY, "ocr_prediction", F.coalesce("prediction", F.lit("")).alias("prediction"))


def stream_correct(spark: SparkSession, sf_dir: str, lexicons: str, out: str | None = None,
                   conversion=X.expand_abbreviations) -> str:
    """Expand and correct the lines of arriving documents; returns the folder with ``batch_id`` and ``version``.

    A job started again with the same ``out`` goes on where the last one stopped.
    """
    out = out or _work_dir(spark, "correct")
    documents = table_stream(spark, sf_dir, "documents").select("doc_id", "text")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        version = _version_of_batch(session, f"{out}/versions/batch_id={batch_id}", lexicons)
        lexicon = session.read.parquet(f"{lexicons}/version={version}") if version else None
        # a batch of few files has few tasks; its lines are made and corrected by all cores
        (corrected(line_pairs(evenly(batch), keep=()), lexicon, conversion).withColumn("version", F.lit(version).cast("bigint"))
         .write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}"))

    q = (documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/data"
