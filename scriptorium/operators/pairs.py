"""Pair-table checks and joins: PRJ-1, PRJ-2, PRJ-8, JOI-1, JOI-2, JOI-4.

JOI-2 (line alignment) is a band join without a join: OCR and verified lines
of a page meet per block of lines in one aggregate, and each OCR line is
scored against the 2k+1 lines around it in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import REQUIRED_PAIR_COLUMNS


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required=REQUIRED_PAIR_COLUMNS) -> DataFrame:
    """PRJ-1: fail at plan time, naming the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def drop_incomplete(df: DataFrame, required=REQUIRED_PAIR_COLUMNS) -> DataFrame:
    """PRJ-2: rows with NULL in any required column are dropped."""
    return df.na.drop(subset=list(required))


def incomplete_counts(df: DataFrame, required=REQUIRED_PAIR_COLUMNS) -> DataFrame:
    """PRJ-2 report: rows in, kept and dropped, in one aggregate."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(complete).alias("rows_kept"), F.count_if(~complete).alias("rows_dropped"))


def default_line_ids(df: DataFrame, idx: str = "idx", col: str = "line_id") -> DataFrame:
    """PRJ-8: ``sample_{i}`` where the line id is missing."""
    return df.withColumn(col, F.coalesce(F.col(col), F.concat(F.lit("sample_"), F.col(idx).cast("string"))))


def pair_join(preds: DataFrame, refs: DataFrame, key=("page_id", "line_number")) -> DataFrame:
    """JOI-1: predictions with their references by key (inner, like ``zip``)."""
    return preds.join(refs, list(key), "inner")


def unpaired(left: DataFrame, right: DataFrame, key=("page_id", "line_number")) -> DataFrame:
    """JOI-4: keys present on one side only, tagged with the side; one full outer join."""
    k = list(key)
    both = left.select(*k, F.lit(True).alias("_l")).join(right.select(*k, F.lit(True).alias("_r")), k, "full_outer")
    return (both.where(F.col("_l").isNull() | F.col("_r").isNull())
            .select(*k, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side")))


#: Lines of a page that are aligned in one row; verified lines near an edge belong to both sides.
ALIGN_BLOCK = 64
#: A close line's distance, tried first; from ``WIDE`` on the whole matrix costs no more than a band of it.
CLOSE, WIDE = 8, 24
#: A candidate's rank is its distance times 2^``RANK_BITS`` plus its place, so the least rank is the best candidate.
RANK_BITS = 31


def _rank(distance: Column, place: Column) -> Column:
    return F.shiftleft(distance.cast("bigint"), RANK_BITS) + place


def _better(text: Column, rank: Column, other: Column) -> Column:
    """The smaller of ``rank`` and the rank of candidate ``other`` (place i, text t)."""
    # the largest distance that would still be better; a band of that width stops early on texts farther apart
    limit = F.shiftright(rank - 1 - other["i"], RANK_BITS).cast("int")
    d = F.when(limit < WIDE, F.call_function("levenshtein", text, other["t"], limit)).otherwise(F.levenshtein(text, other["t"]))
    # a band's -1 becomes the largest int, which is better than no rank
    return F.when(other["i"] >= rank, rank).otherwise(F.least(rank, _rank(d.bitwiseAND(F.lit(0x7FFFFFFF)), other["i"])))


def align_lines(ocr_lines: DataFrame, ref_lines: DataFrame, band: int = 2, threshold: int = 16,
                page: str = "page_id", num: str = "line_number",
                ocr: str = "ocr_prediction", ref: str = "text") -> DataFrame:
    """JOI-2: best verified line (by edit distance) within +-band lines of each OCR line.

    Output: page, OCR line number, aligned reference line number, distance.
    Ties go to the nearest line number, then the smaller one.  Distances are
    exact.  Both sides meet in one aggregate per (page, block of
    ``ALIGN_BLOCK`` lines), a group of bounded size; verified lines within
    ``band`` of a block's edge are repeated in the next block.  In the row,
    nearest line first, a candidate is only compared as far as it could beat
    the best one so far: first among distances up to ``CLOSE``, and only
    without any so close among all.  Without a candidate up to ``threshold``,
    one with a missing text comes first, with no distance.
    """
    block = lambda n: F.floor(n / ALIGN_BLOCK)
    o = ocr_lines.select(page, block(F.col(num)).alias("_b"), F.struct(F.col(num).alias("n"), F.col(ocr).alias("t")).alias("_o"),
                         F.lit(None).cast("struct<n: bigint, t: string>").alias("_r"))
    r = ref_lines.select(page, F.explode(F.array_distinct(F.array(block(F.col(num) - band), block(F.col(num) + band)))).alias("_b"),
                         F.lit(None).cast("struct<n: bigint, t: string>").alias("_o"),
                         F.struct(F.col(num).alias("n"), F.col(ref).alias("t")).alias("_r"))
    blocks = o.union(r).groupBy(page, "_b").agg(F.collect_list("_o").alias("_os"), F.sort_array(F.collect_list("_r")).alias("_rs"))
    # where a block's verified lines have consecutive numbers, a line's candidates are a slice of them
    numbers = F.transform("_rs", lambda x: x["n"])
    blocks = blocks.select(page, "_os", "_rs", F.get("_rs", F.lit(0))["n"].alias("_first"),
                           (numbers == F.sequence(F.array_min(numbers), F.array_max(numbers))).alias("_dense"))
    lines = blocks.select(page, F.explode("_os").alias("_o"), "_rs", "_first", "_dense")
    n = F.col("_o.n")
    lo = F.greatest(n - band - F.col("_first"), F.lit(0))
    hi = F.least(n + band - F.col("_first"), F.size("_rs") - 1)
    in_band = lambda x: F.abs(x["n"] - n) <= band
    # a filter on the candidates themselves would collect them twice
    lines = lines.where(F.when(F.col("_dense"), hi >= lo).otherwise(F.exists("_rs", in_band)))
    around = F.when(F.col("_dense"), F.slice("_rs", (lo + 1).cast("int"), (hi - lo + 1).cast("int"))).otherwise(F.filter("_rs", in_band))
    near = lines.select(page, "_o", around.alias("_near"))
    ordered = F.sort_array(F.transform("_near", lambda x: F.struct(F.abs(x["n"] - n).alias("gap"), x["n"].alias("r"), x["t"].alias("t"))))
    placed = F.transform(ordered, lambda x, i: F.struct(i.cast("bigint").alias("i"), x["r"].alias("r"), x["t"].alias("t")))
    near = near.select(page, "_o", placed.alias("_near"))

    text, beyond, none = F.col("_o.t"), F.lit((CLOSE + 1) << RANK_BITS), F.lit(1 << 2 * RANK_BITS)
    best = lambda worst: F.aggregate("_near", worst, lambda rank, x: _better(text, rank, x))
    first = near.select(page, "_o", "_near", best(beyond).alias("_close"))
    ranked = first.select(page, "_o", "_near", F.when(F.col("_close") < beyond, F.col("_close")).otherwise(best(none)).alias("_rank"))
    unknown = F.filter("_near", lambda x: x["t"].isNull() | text.isNull())
    ranked = ranked.select(page, "_o", "_near", "_rank", F.when(F.shiftright("_rank", RANK_BITS) > threshold, F.get(unknown, F.lit(0))["r"]).alias("_unknown"))
    place = F.col("_rank").bitwiseAND(F.lit((1 << RANK_BITS) - 1)).cast("int")
    return ranked.select(page, n.alias(num), F.coalesce("_unknown", F.get("_near", place)["r"]).alias("aligned_line"),
                         F.when(F.col("_unknown").isNull(), F.shiftright("_rank", RANK_BITS)).alias("distance"))
