"""Positional operators: global index (WIN-1), positional splits (WIN-3a/b), split report (AGG-20).

The reference identifies rows by list position.  Spark has no row order, so
position is defined by an explicit key order, e.g. (page_id, line_number).

WIN-1 without a single-partition window: rows are range-partitioned on the
order key (a hot page is split across ranges because the line number is part
of the key) and sorted inside each range.  ``monotonically_increasing_id``
then encodes (range number, position in range); a per-range count, a running
sum over the ranges (one row per range, broadcast with a bound equal to the
partition count) and one addition give the dense 0-based index.  Cost: one
range shuffle and one checkpoint write; no Python, no unbounded group.

When the rows are the lines of pages that are exploded in the plan anyway,
:func:`paged_index` numbers them in two levels without moving a line: lines
are counted per page on the scan side, the small page table gets its prefix
sums, and a line's index is its page's offset plus its place in the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SPLIT_TRAIN, SPLIT_VAL
from ..session import ensure_checkpoint_dir

_LOCAL_BITS = 33


def global_index(df: DataFrame, order_cols, out: str = "idx", with_total: str | None = None) -> DataFrame:
    """WIN-1: dense 0-based index in ``order_cols`` order; optional total row count column.

    All columns of ``df`` are checkpointed: select the ones needed first.  The
    number of ranges is left to AQE, which sizes them by the data.
    """
    order_cols = list(order_cols)
    # Range bounds come from a sample of the input, and the sample depends on
    # the input order; the counting branch and the numbering branch must see
    # the same ranges.  A reliable checkpoint (shared spark.checkpoint.dir)
    # fixes the ranges once and cuts lineage, so retries and lost executors
    # re-read the same partitions instead of re-sampling.
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .checkpoint(eager=True)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright(F.col("_mid"), _LOCAL_BITS)) \
                   .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias("_total"))
    # offsets has one row per range partition: a proven bound for the broadcast.
    joined = ranged.join(F.broadcast(offsets), "_part")
    cols = [F.col(c) for c in df.columns] + [(F.col("_off") + F.col("_local")).alias(out)]
    if with_total:
        cols.append(F.col("_total").alias(with_total))
    return joined.select(*cols)


#: Pages whose offsets are sent to every task (two numbers a page); more are joined by a merge join of whole pages.
MAX_BROADCAST_PAGES = 1_000_000


def prefix_sums(df: DataFrame, key: str, weight: str, out: str, total: str) -> DataFrame:
    """(key, out, total): for each key in ascending order the sum of the weights before it, and of all weights.

    Keys have to be distinct.  Two levels: a running sum inside each range of
    keys, and the ranges' totals, one row a range.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # The checkpoint fixes the sampled ranges, and whatever computed the weights runs once.
    ranged = (df.select(key, weight).repartitionByRange(key).sortWithinPartitions(key).checkpoint(eager=True)
              .withColumn("_part", F.shiftright(F.monotonically_increasing_id(), _LOCAL_BITS)))
    ranges = ranged.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias(total))
    inside = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(F.broadcast(offsets), "_part")
            .select(key, (F.col("_off") + F.col("_in")).alias(out), total))


def paged_index(documents: DataFrame, n_lines, explode: Callable[[DataFrame, list[str]], DataFrame], page: str = "doc_id",
                key=("page_id", "line_number"), out: str = "idx", with_total: str | None = None) -> DataFrame:
    """WIN-1 for lines that are exploded from pages, in (page, line) order.

    ``n_lines`` counts a page's lines; ``explode(pages, keep)`` explodes them
    with the line key ``key``, whose last column counts from 0, and the columns ``keep``.  Only (page, count)
    rows are shuffled and checkpointed, never a text.  The offsets come back by
    a broadcast while there are at most ``MAX_BROADCAST_PAGES`` pages, else by a
    merge join of the unexploded pages.  Page ids that repeat have no two-level
    order; their lines are numbered by :func:`global_index` on the line key.
    """
    counts = documents.groupBy(page).agg(F.sum(F.coalesce(n_lines, F.lit(0))).cast("bigint").alias("_lines"), F.count(F.lit(1)).alias("_rows"))
    ensure_checkpoint_dir(documents.sparkSession)
    counts = counts.checkpoint(eager=True)
    pages, most = counts.agg(F.count(F.lit(1)), F.max("_rows")).head()
    if (most or 0) > 1:
        return global_index(explode(documents, []), key, out, with_total)
    offsets = prefix_sums(counts, page, "_lines", "_first", "_all").withColumnRenamed(page, "_page")
    offsets = F.broadcast(offsets) if pages <= MAX_BROADCAST_PAGES else offsets.hint("merge")
    placed = documents.join(offsets, F.col(page).eqNullSafe(F.col("_page"))).drop("_page")
    lines = explode(placed, ["_first", "_all"])
    kept = [c for c in lines.columns if c not in ("_first", "_all")]
    more = [F.col("_all").alias(with_total)] if with_total else []
    return lines.select(*kept, (F.col("_first") + F.col(key[-1])).alias(out), *more)


def split_bounds(total) -> tuple:
    """Sizes of the positional split: train = int(n*0.8), validation = int(n*0.1)."""
    n = F.col(total).cast("double") if isinstance(total, str) else total.cast("double")
    return F.floor(n * SPLIT_TRAIN).cast("bigint"), F.floor(n * SPLIT_VAL).cast("bigint")


def positional_split(df: DataFrame, order_cols, three_way: bool = True, out: str = "split") -> DataFrame:
    """WIN-3a (train/validation/test 80/10/10) or WIN-3b (train/validation 80/20), in key order."""
    return split_by_index(global_index(df, order_cols, "idx", with_total="_n"), "idx", "_n", three_way, out)


def split_by_index(df: DataFrame, idx: str = "idx", total: str = "_n", three_way: bool = True, out: str = "split") -> DataFrame:
    """WIN-3a / WIN-3b on rows that have their index and the number of all rows; the latter is dropped."""
    n_train, n_val = split_bounds(total)
    at = F.col(idx)
    if three_way:
        split = F.when(at < n_train, "train").when(at < n_train + n_val, "validation").otherwise("test")
    else:
        split = F.when(at < n_train, "train").otherwise("validation")
    return df.withColumn(out, split).drop(total)


def split_report(split_df: DataFrame, col: str = "split") -> DataFrame:
    """AGG-20: rows and share per split."""
    total = F.sum("rows").over(Window.partitionBy())
    return (split_df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
            .select(col, "rows", F.round(F.col("rows") / total * 100.0, 6).alias("share_pct")))
