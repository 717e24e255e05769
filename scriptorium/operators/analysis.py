"""Error analysis: histograms, error by length, top-k, metric log trends.

AGG-17, AGG-18, AGG-19, TOP-1, TOP-2, TOP-5, WIN-5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import row_cer
from ..session import ensure_checkpoint_dir

BINS = 30


def histogram(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    """AGG-17: ``bins`` equal bins over [min, max], last bin closed; non-empty bins.

    min == max widens the range to +-0.5 (all rows in the middle bin); NULLs
    are in no bin.  The rows are read once: they are counted by distinct value
    (combined map-side), and both the range and the bins come from that
    shuffled table, the range as a scalar subquery that reuses its exchange.
    """
    values = df.groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # ``n`` is asked for in the range too, so that both readers of the exchange want the same columns
    ends = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("rows"))).scalar()
    ranged = values.select("x", "n", ends.alias("ends")).select("x", "n", "ends.lo", "ends.hi", "ends.rows")
    same = F.col("lo") == F.col("hi")
    ranged = ranged.select("x", "n", "rows", F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                           F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("bigint"), F.lit(bins - 1))
    width = (F.col("hi") - F.col("lo")) / bins
    # NULLs are left out by the counts: a filter on ``col`` would be pushed into
    # (and duplicate) the expression behind it
    counted = (ranged.groupBy(b.alias("bin"), "lo", "hi")
               .agg(F.sum(F.when(F.col("x").isNotNull() & (F.col("rows") > 0), F.col("n"))).alias("n")).where("n > 0"))
    return counted.select("bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("lower"),
                          F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("upper"), "n")


def error_by_length(scores: DataFrame, length: str = "input_length", ed: str = "edit_distance",
                    truth: str = "ground_truth") -> DataFrame:
    """AGG-18: per input length: rows, mean/min/max edit distance, mean row CER."""
    return scores.groupBy(length).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col(ed).cast("double")), 6).alias("avg_edit_distance"),
        F.min(ed).alias("min_edit_distance"), F.max(ed).alias("max_edit_distance"),
        F.round(F.avg(row_cer(ed, truth)), 6).alias("avg_cer"))


def correlations(scores: DataFrame) -> DataFrame:
    """AGG-18 (scatter summaries): Pearson correlations behind the three scatter plots."""
    return scores.agg(
        F.round(F.corr(F.col("input_length").cast("double"), F.col("edit_distance").cast("double")), 6)
        .alias("corr_length_edit_distance"),
        F.round(F.corr(F.col("input_length").cast("double"), row_cer("edit_distance", "ground_truth")), 6)
        .alias("corr_length_cer"),
        F.round(F.corr(F.col("edit_distance").cast("double"), F.col("bleu_score")), 6)
        .alias("corr_edit_distance_bleu"))


def top_k(scores: DataFrame, by: str, k: int = 10, tie=("page_id", "line_number")) -> DataFrame:
    """TOP-1 / TOP-2: the k largest by ``by``, ties in row order."""
    return scores.orderBy(F.col(by).desc(), *tie).limit(k)


def top_k_per_group(scores: DataFrame, group: str, by: str, k: int = 3,
                    tie=("page_id", "line_number")) -> DataFrame:
    """TOP-5: k largest per group.  ``row_number() <= k`` is planned with a partial
    per-task group limit before the shuffle, so a hot group ships k rows per task."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), *tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def metric_log(parts: DataFrame, run: str, step: str) -> DataFrame:
    """Evaluation log (one row per run and step): cer, bleu, mean edit distance, samples."""
    return parts.groupBy(run, step).agg(
        F.coalesce(F.try_divide(F.sum("ed_norm").cast("double"), F.sum("ref_norm_len").cast("double")),
                   F.lit(0.0)).alias("cer"),
        F.avg("bleu_score").alias("bleu"),
        F.avg(F.col("ed").cast("double")).alias("edit_distance"),
        F.count(F.lit(1)).alias("eval_samples"))


def step_ranges(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """(run, step, ...) checkpointed in ranges of (run, step), with the range's number ``part``."""
    spark = log.sparkSession
    ensure_checkpoint_dir(spark)
    # a number of its own keeps AQE from coalescing a long, narrow log into one task
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (log.repartitionByRange(n, "run", "step").sortWithinPartitions("run", "step")
            .checkpoint(eager=True).withColumn("part", F.spark_partition_id()))


def metric_trend(log: DataFrame, run: str = "run", step: str = "step", metric: str = "cer",
                 ranges: int | None = None) -> DataFrame:
    """WIN-5: previous value, change and running best per run, in step order.

    A run of any length is cut in ``ranges`` ranges of steps (the session's
    shuffle partitions, if not given).  Each range is scanned by itself; what
    the ranges before it hold of its first run, the last value and the best, is
    one row per range and comes back as a broadcast of that many rows.  The log
    is checkpointed once, so that its ranges stay as they are in retries.
    A NULL metric is a value like any other for its successor, and no best one.
    """
    cut = step_ranges(log.select(F.col(run).alias("run"), F.col(step).alias("step"), F.col(metric).alias("value")), ranges)
    by_run = cut.groupBy("part", "run").agg(F.min("value").alias("best"), F.max(F.struct("step", "value")).alias("last"))
    # Structs keep a NULL run comparable; within a range every run is one row here.
    edges = by_run.groupBy("part").agg(F.min(F.struct("run")).alias("first"), F.max(F.struct("run", "best", "last")).alias("end"))
    ends = edges.select("part", F.col("end.run").alias("run"), F.lit(True).alias("is_end"), F.col("end.best").alias("best"), F.col("end.last").alias("last"))
    starts = edges.select("part", F.col("first.run").alias("run"), F.lit(False).alias("is_end"),
                          F.lit(None).cast(ends.schema["best"].dataType).alias("best"), F.lit(None).cast(ends.schema["last"].dataType).alias("last"))
    before = Window.partitionBy("run").orderBy("part", "is_end").rowsBetween(Window.unboundedPreceding, -1)
    carried = (ends.unionByName(starts)
               .select("part", F.col("run").alias("carried_run"), "is_end", F.min("best").over(before).alias("carried_best"),
                       F.last("last", ignorenulls=True).over(before).alias("carried_last"))
               .where("NOT is_end AND carried_last IS NOT NULL").drop("is_end"))
    here = Window.partitionBy("part", "run").orderBy("step")
    scanned = cut.select("*", F.row_number().over(here).alias("place"), F.lag("value").over(here).alias("lagged"),
                         F.min("value").over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("least"))
    # one row per range partition: a proven bound for the broadcast
    joined = scanned.join(F.broadcast(carried), "part", "left")
    goes_on = F.col("carried_last").isNotNull() & F.col("run").eqNullSafe(F.col("carried_run"))
    prev = F.when((F.col("place") == 1) & goes_on, F.col("carried_last.value")).otherwise(F.col("lagged"))
    best = F.least("least", F.when(goes_on, F.col("carried_best")))
    return joined.select(F.col("run").alias(run), F.col("step").alias(step), F.round("value", 6).alias(metric),
                         F.round(prev, 6).alias(f"prev_{metric}"), F.round(F.col("value") - prev, 6).alias(f"delta_{metric}"),
                         F.round(best, 6).alias(f"best_{metric}_so_far"))


def best_checkpoint(log: DataFrame, run: str = "run", step: str = "step", metric: str = "cer") -> DataFrame:
    """AGG-19: the step with the lowest metric per run (ties: earliest step)."""
    b = log.groupBy(run).agg(F.min(F.struct(F.col(metric).alias("m"), F.col(step).alias("s"))).alias("b"))
    return b.select(run, F.col("b.s").alias(f"best_{step}"), F.round("b.m", 6).alias(f"best_{metric}"))
