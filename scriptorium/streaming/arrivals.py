"""Event-time CER over documents that go on arriving (STR-3 with a moving document side).

Documents and events are both streams with a watermark.  An event counts for
its document if it happens within ``valid`` after the document's own time; the
inner join of the two holds a document, or an event that is ahead of its
document, only until the watermark has passed that span, so its state follows
the span and not the history.  The watermark is the slower stream's; rows that
are older than it when they arrive are dropped.

A document's errors are counted in its row, so nothing is aggregated ahead of
the join.  Every pair leaves the join once: each micro-batch writes the sums of
its new pairs per window to its own ``batch_id=N`` folder, a replay replaces
them, and :func:`window_totals` adds them up.  Rows with a null id or time
match nothing; a null or empty text has no errors and no characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.text import ws_normalize
from ..sources.fixture import LINE_PATTERN, noise
from .streams import _work_dir, table_stream, utc_event_time, utc_text

FIRST_DAY, DAYS = 1_704_067_200, 30


def text_errors(text: str) -> tuple[Column, Column]:
    """Normalised errors of a text's derived recognition and its characters, summed over its lines in the row."""
    lines = F.regexp_extract_all(text, F.lit(LINE_PATTERN), F.lit(0))
    errors = F.transform(lines, lambda t, i: D.normalized_edit_distance(noise(t, i), t).cast("bigint"))
    chars = F.transform(lines, lambda t: F.length(ws_normalize(t)).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return tuple(F.coalesce(F.aggregate(x, zero, lambda a, b: a + b), zero) for x in (errors, chars))


def arriving_documents(spark: SparkSession, sf_dir: str, watermark: str) -> DataFrame:
    """Stream of (page_id, arrived, errors, chars); the table has no time, so days of a month go by document id."""
    errors, chars = text_errors("text")
    return (table_stream(spark, sf_dir, "documents")
            .select(F.col("doc_id").alias("page_id"), F.timestamp_seconds(F.lit(FIRST_DAY) + F.pmod("doc_id", F.lit(DAYS)) * 86400).alias("arrived"),
                    errors.alias("errors"), chars.alias("chars"))
            .withWatermark("arrived", watermark))


def stream_arrivals_cer(spark: SparkSession, sf_dir: str, out: str | None = None, window: str = "1 day",
                        watermark: str = "1 hour", valid: str = "7 days") -> str:
    """Join both streams to completion; returns the folder of sums per batch and window.

    A job started again with the same ``out`` goes on with the state it had.
    """
    out = out or _work_dir(spark, "arrivals")
    events = (table_stream(spark, sf_dir, "events")
              .select(F.col("user_id").alias("event_page"), utc_event_time("ts").alias("ts")).withWatermark("ts", watermark))
    within = F.expr(f"event_page = page_id AND ts >= arrived AND ts < arrived + INTERVAL {valid}")
    pairs = events.join(arriving_documents(spark, sf_dir, watermark), within)

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(F.window("ts", window).alias("w")).agg(
            F.count(F.lit(1)).alias("events"), F.sum("errors").alias("errors"), F.sum("chars").alias("chars"))
        (sums.select(utc_text(F.col("w.start")).alias("window_start"), utc_text(F.col("w.end")).alias("window_end"), "events", "errors", "chars")
         .write.mode("overwrite").parquet(f"{out}/result/batch_id={batch_id}"))

    q = (pairs.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/result"


def window_totals(spark: SparkSession, result: str) -> DataFrame:
    """Events, errors, characters and CER of every window over all batches."""
    sums = spark.read.parquet(result).groupBy("window_start", "window_end").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("events", "errors", "chars")])
    return sums.withColumn("cer", F.coalesce(F.try_divide(F.col("errors").cast("double"), F.col("chars").cast("double")), F.lit(0.0)))
