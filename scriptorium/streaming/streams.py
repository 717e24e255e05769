"""Structured Streaming jobs (STR-1, STR-2, STR-3).

The same column expressions as the batch jobs run per micro-batch:

* STR-1 metric log: new documents -> line pairs -> score parts -> one
  aggregate per micro-batch, appended through ``foreachBatch``.  Each batch
  writes its own ``batch_id=N`` folder with overwrite, so a replayed batch
  (after a failure) replaces its row instead of duplicating it.
* STR-2 stateless expansion (literals, or the full conversion) of arriving
  lines into an append-only sink.
* STR-3 event-time tumbling-window CER: events (``ts`` wall clock read as
  UTC, so results do not depend on the session time zone) with a watermark,
  joined stream-static to per-document error counts, then ``groupBy(window)``
  in update mode: state ends with the watermark and later rows are dropped.
  Each batch writes the windows that it changed to its own ``batch_id=N``
  folder, so a replay replaces them; ``latest_windows`` reads their last state.

Outputs and checkpoints live under the shared checkpoint folder named by
``spark.checkpoint.dir``; triggers are ``availableNow`` (process what is
there, then stop), the same plan a continuous trigger would run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import expand as X
from ..functions.text import ws_normalize
from ..operators import metrics as M
from ..operators.scores import score_parts
from ..session import ensure_checkpoint_dir
from ..sources.fixture import line_pairs, load_pairs, read_table, spread


def _work_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1) -> DataFrame:
    """File-source stream over one table of a folder of Parquet tables.

    A table that Spark wrote is a folder ``table.parquet`` itself: all files
    present in it are one batch, whatever their number, and files that arrive
    later are further batches.  Otherwise the table is the file ``table.parquet``
    and whatever comes as ``table-*.parquet`` later, ``max_files`` a batch.
    """
    schema = read_table(spark, sf_dir, table).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{table}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if len(status) and status[0].isDirectory():
        return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path.toString())
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}{{,-*}}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def metric_row(batch: DataFrame) -> DataFrame:
    """UDF-3 / SNK-6 row: cer, bleu, edit_distance, eval_samples of one batch of pairs."""
    parts = score_parts(spread(batch), pred="ocr_prediction", ref="text", in_batches=True)
    return parts.agg(M.cer().alias("cer"), F.avg("bleu_score").alias("bleu"),
                     F.avg(F.col("ed").cast("double")).alias("edit_distance"),
                     F.count(F.lit(1)).alias("eval_samples"))


def stream_metrics_log(spark: SparkSession, sf_dir: str, out: str | None = None) -> str:
    """STR-1: run the metric-log stream to completion; returns the log folder."""
    out = out or _work_dir(spark, "metrics_log")
    pairs = line_pairs(table_stream(spark, sf_dir, "documents"))

    def write(batch: DataFrame, batch_id: int) -> None:
        row = metric_row(batch).select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "*")
        row.write.mode("overwrite").parquet(f"{out}/log/batch_id={batch_id}")

    q = (pairs.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/log"


def stream_expand(spark: SparkSession, sf_dir: str, out: str | None = None, conversion=X.expand_literals) -> str:
    """STR-2: expansion of arriving OCR lines into an append-only Parquet sink.

    ``conversion`` maps the recognised text to the prediction; the full
    conversion with patterns and marks is ``expand_abbreviations``.  A job
    restarted with the same ``out`` goes on where the last one stopped.
    """
    out = out or _work_dir(spark, "expand")
    pairs = line_pairs(table_stream(spark, sf_dir, "documents"))
    fixed = pairs.select("page_id", "line_number", "ocr_prediction",
                         conversion("ocr_prediction").alias("prediction"))
    q = (fixed.writeStream.format("parquet").option("path", f"{out}/data")
         .option("checkpointLocation", f"{out}/_checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/data"


def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static side of STR-3: per document, normalised OCR errors and reference characters."""
    pairs = load_pairs(spark, sf_dir, keep=())
    return pairs.groupBy("page_id").agg(
        F.sum(D.normalized_edit_distance("ocr_prediction", "text")).alias("errors"),
        F.sum(F.length(ws_normalize("text"))).alias("chars"))


def utc_event_time(ts) -> F.Column:
    """TIMESTAMP_NTZ wall clock read as UTC, whatever the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def utc_text(instant) -> F.Column:
    """'yyyy-MM-dd HH:mm:ss' of an instant in UTC, independent of the session time zone."""
    sec = F.unix_seconds(instant)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(sec / 86400).cast("int"))
    sod = F.pmod(sec, F.lit(86400))
    return F.concat(F.date_format(day, "yyyy-MM-dd"),
                    F.format_string(" %02d:%02d:%02d", (sod / 3600).cast("int"),
                                    ((sod % 3600) / 60).cast("int"), (sod % 60).cast("int")))


def stream_window_cer(spark: SparkSession, sf_dir: str, out: str | None = None,
                      window: str = "1 day", watermark: str = "1 hour") -> str:
    """STR-3: tumbling-window CER over event time; returns the result folder."""
    out = out or _work_dir(spark, "window_cer")
    # materialised once (shared checkpoint folder): every micro-batch joins the
    # stored table instead of recomputing it
    ensure_checkpoint_dir(spark)
    docs = document_errors(spark, sf_dir).checkpoint(eager=True)
    n_docs = read_table(spark, sf_dir, "documents").count()   # parameter of the event -> page mapping
    events = (table_stream(spark, sf_dir, "events")
              .select(F.col("event_id"), utc_event_time("ts").alias("ts"))
              .withWatermark("ts", watermark)
              .withColumn("page_id", F.col("event_id") % F.lit(n_docs)))
    joined = events.join(docs, "page_id", "inner")
    agg = joined.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("errors").alias("errors"), F.sum("chars").alias("chars"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(utc_text(F.col("w.start")).alias("window_start"),
                     utc_text(F.col("w.end")).alias("window_end"),
                     F.col("events").cast("bigint").alias("events"), F.col("errors").cast("bigint").alias("errors"),
                     F.col("chars").cast("bigint").alias("chars"),
                     F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("chars").cast("double")),
                                F.lit(0.0)).alias("cer")) \
            .write.mode("overwrite").parquet(f"{out}/result/batch_id={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/result"


def latest_windows(spark: SparkSession, result: str) -> DataFrame:
    """Last state of each window from the folders that ``stream_window_cer`` wrote."""
    values = ["events", "errors", "chars", "cer"]
    last = spark.read.parquet(result).groupBy("window_start", "window_end").agg(F.max_by(F.struct(*values), "batch_id").alias("last"))
    return last.select("window_start", "window_end", "last.*")
