"""Page side: segmentation lines, boxes, image names, page assembly and summary.

SRC-7 / UDF-4 / PRJ-7 / PRJ-12 / PRJ-13 / PRJ-14, AGG-14, AGG-16.

Page assembly keeps every group bounded: a page is emitted as ordered blocks
of at most ``block_lines`` lines (``block = line_number div block_lines``).
Joining a page's blocks with ``\\n`` in block order gives the page text; the
sink writes blocks in that order.  The page summary (line count, text
length, mean line length) is pure aggregation, so a page holding a third of
all lines costs one partial count per task, never one huge row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_SEG_TYPE, DEFAULT_TEXT_DIRECTION

BLOCK_LINES = 256


def segmentation_lines(seg: DataFrame, page_col: str = "page_id") -> DataFrame:
    """SRC-7 + PRJ-12/13: one row per usable line, 1-based number, bbox from polygon or given box.

    A line with neither polygon nor box is skipped; numbering keeps the gap.
    """
    lines = seg.select(
        page_col,
        F.coalesce("text_direction", F.lit(DEFAULT_TEXT_DIRECTION)).alias("text_direction"),
        F.coalesce("type", F.lit(DEFAULT_SEG_TYPE)).alias("type"),
        F.posexplode_outer("lines").alias("pos", "line"))
    lines = lines.where(F.col("line").isNotNull())
    out = lines.select(page_col, "text_direction", "type",
                       (F.col("pos") + 1).alias("line_number"),
                       F.col("line.boundary").alias("boundary"), F.col("line.baseline").alias("baseline"),
                       bbox_from(F.col("line.boundary"), F.col("line.bbox")).alias("bbox"))
    return out.where(F.col("bbox").isNotNull())


def bbox_from(boundary, bbox) -> F.Column:
    """PRJ-13: min/max of polygon x/y when the polygon is non-empty, else the given box."""
    xs = F.transform(boundary, lambda p: p[0])
    ys = F.transform(boundary, lambda p: p[1])
    from_poly = F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"),
                         F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))
    from_box = F.struct(F.get(bbox, 0).alias("left"), F.get(bbox, 1).alias("top"),
                        F.get(bbox, 2).alias("right"), F.get(bbox, 3).alias("bottom"))
    has_poly = boundary.isNotNull() & (F.size(boundary) > 0)
    has_box = bbox.isNotNull() & (F.size(bbox) >= 4)
    return F.when(has_poly, from_poly).when(has_box, from_box)


def line_image_name(base, index) -> F.Column:
    """PRJ-14: ``{base}_{i:02d}.png``."""
    b = F.col(base) if isinstance(base, str) else base
    i = F.col(index) if isinstance(index, str) else index
    return F.format_string("%s_%02d.png", b, i)


def assemble_blocks(lines: DataFrame, page: str = "page_id", order: str = "line_number",
                    text: str = "text", block_lines: int = BLOCK_LINES) -> DataFrame:
    """AGG-16: (page, block, first_line, n_lines, text) with lines joined by ``\\n`` in order.

    Blank lines stay as empty strings.
    """
    blocked = lines.select(page, order, F.coalesce(F.col(text), F.lit("")).alias("_t"),
                           F.floor(F.col(order) / block_lines).cast("bigint").alias("block"))
    return blocked.groupBy(page, "block").agg(
        F.min(order).alias("first_line"),
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))),
                                 lambda s: s["t"]), "\n").alias("text"))


def page_results(lines: DataFrame, page: str = "page_id", order: str = "line_number",
                 text: str = "text", block_lines: int = BLOCK_LINES) -> DataFrame:
    """AGG-16 page level: (page, n_blocks, n_lines, n_blank, first_line, last_line, text_length), one row per page.

    ``n_blocks`` is the number of rows that :func:`assemble_blocks` has for the
    page.  Lines are counted per block first, so a page of any size reaches the
    second aggregate as its blocks.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blocks = lines.groupBy(page, F.floor(F.col(order) / block_lines).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t == "").alias("blank"), F.sum(F.length(t)).alias("chars"),
        F.min(order).alias("lo"), F.max(order).alias("hi"))
    return blocks.groupBy(page).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("n_lines"), F.sum("blank").alias("n_blank"),
        F.min("lo").alias("first_line"), F.max("hi").alias("last_line"), (F.sum("chars") + F.sum("n") - 1).alias("text_length"))


def page_summary(lines: DataFrame, page: str = "page_id", text: str = "text") -> DataFrame:
    """AGG-14: lines, length of the joined text (newlines included), length / lines."""
    agg = lines.groupBy(page).agg(F.count(F.lit(1)).alias("n_lines"),
                                  F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("_chars"))
    total = (F.col("_chars") + F.col("n_lines") - 1).cast("bigint")
    return agg.select(page, "n_lines", total.alias("text_length"),
                      F.round(total / F.col("n_lines"), 6).alias("avg_line_length"))
