"""CSV with quoted line breaks, one file read by many tasks (SRC-1).

A line break ends a record exactly where the number of quotes before it in the
file is even.  Files are read as physical lines, by byte ranges as Spark cuts
them.  A first narrow pass counts each range's quotes; the prefix sums of that
small table tell for every range whether it begins inside a quoted cell.  With
that, a second narrow pass joins the lines of each range to records on its own;
only the pieces of records that cross a border (two a range at most) are
shuffled.  ``from_csv`` then cuts records into cells.

Quotes must be balanced as RFC 4180 has them: a cell with quotes is quoted and
its quotes are doubled.  A file whose quotes do not add up raises.  Line breaks
are ``\\n`` or ``\\r\\n``, which is ``\\n`` inside a cell; empty lines between
records are no rows; an empty file has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

MAX_RANGES = 1_000_000

_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
WHOLE, CLOSES, OPENS, INSIDE = 0, 1, 2, 3


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _quotes(value: str = "value") -> Column:
    return F.length(value) - F.length(F.replace(F.col(value), F.lit('"'), F.lit("")))


def range_states(spark: SparkSession, path) -> DataFrame:
    """(file, block, inside): whether a byte range of the files begins inside a quoted cell; one row per range."""
    odd = _lines(spark, path).groupBy("file", "block").agg((F.sum(_quotes()) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("odd").over(Window.partitionBy("file")) % 2
    unbalanced = F.raise_error(F.concat(F.lit("odd number of quotes in "), F.col("file")))
    return odd.select("file", "block", F.when(left == 1, unbalanced).otherwise(F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _join_lines(batches):
    """Physical lines of whole ranges, in order -> pieces; what a range holds open is one string in memory."""
    key, row, inside, first, held = None, 0, False, False, []

    def end():
        # What is left at the end of a range: a record that goes on in the next one.
        if held:
            yield (*key, row, INSIDE if first else OPENS, "\n".join(held))

    for batch in batches:
        values, files, blocks = batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist()
        odd = np.asarray(pc.count_substring(values, '"')) % 2
        out = []
        for text, file, block, begins, flips in zip(values.to_pylist(), files, blocks, batch.column("inside").to_pylist(), odd.tolist()):
            if (file, block) != key:
                out.extend(end())
                key, row, inside, first, held = (file, block), 0, begins, begins, []
            if not held and not inside and text in ("", "\r"):
                continue
            held.append(text)
            inside ^= bool(flips)
            if not inside:
                out.append((*key, row, CLOSES if first else WHOLE, "\n".join(held)))
                row, first, held = row + 1, False, []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)
    rest = list(end())
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest), _PIECES)], schema=_PIECES)


def records(spark: SparkSession, path) -> DataFrame:
    """(file, block, row, record): the records of the files, without empty ones, with their place in file order."""
    ensure_checkpoint_dir(spark)
    states = range_states(spark, path).checkpoint(eager=True)
    n = states.count()
    if n > MAX_RANGES:
        raise ValueError(f"{n} byte ranges, at most {MAX_RANGES}: raise spark.sql.files.maxPartitionBytes")
    # One row per range, counted above; a broadcast keeps the lines in the order of the scan.
    lines = _lines(spark, path).join(F.broadcast(states), ["file", "block"])
    pieces = lines.select("value", "file", "block", "inside").mapInArrow(_join_lines, "file string, block bigint, row bigint, kind int, record string")
    whole = pieces.where(F.col("kind") == WHOLE).drop("kind")
    # Pieces of records that cross borders: each opening piece starts one, what follows belongs to it.
    so_far = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = pieces.where(F.col("kind") != WHOLE).select("*", F.count_if(F.col("kind") == OPENS).over(so_far).alias("nth"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "record")))
    joined = (cut.groupBy("file", "nth").agg(parts.alias("parts"))
              .select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["row"].alias("row"),
                      F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    text = F.regexp_replace(F.regexp_replace("record", "\r\n", "\n"), "\r$", "")
    return whole.unionByName(joined).withColumn("record", text)


def read_quoted_csv(spark: SparkSession, path, sep: str, columns: list[str], position: str) -> DataFrame:
    """The rows below the header of each file, all ``columns`` STRING, with ``position`` as their place in file order."""
    rows = records(spark, path).where("NOT (block = 0 AND row = 0)")
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    cells = rows.select(F.from_csv("record", schema, options).alias("cells"), F.struct("file", "block", "row").alias(position))
    return cells.select(*[F.col("cells")[c].alias(c) for c in columns], position)
