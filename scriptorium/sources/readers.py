"""Readers for the reference's input formats (SRC-1..SRC-8).

Only a header line or a file name is ever looked at on the driver (to fix
column names or the separator); all rows are read by Spark tasks.  Text
columns are read as STRING with an explicit schema, so a line such as "12"
is never turned into a number.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_name
from ..operators.pairs import MissingColumns, require_columns
from .quoted import read_quoted_csv
from ..schema import JSONL_SCHEMA, NA_STRINGS, REQUIRED_PAIR_COLUMNS, SEGMENTATION_SCHEMA

SEPARATORS = (";", ",", "\t")


def header_line(spark: SparkSession, path: str) -> str:
    """First line of a text file (a one-row read; Spark raises PATH_NOT_FOUND, SRC-5)."""
    rows = spark.read.text(path).limit(1).collect()
    if not rows:
        raise ValueError(f"empty file: {path}")
    return rows[0][0].lstrip("﻿")


def _columns(header: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(header), delimiter=sep))


def na_to_null(df: DataFrame, cols=None) -> DataFrame:
    """SRC-8: the strings pandas reads as missing become NULL."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    na = list(NA_STRINGS)
    return df.select(*[F.when(F.col(c).isin(na), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


POSITION = "_position"


def file_position() -> F.Column:
    """A row's place in file order: file, offset of the split in it, place in the split; only valid on a scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_csv_strings(spark: SparkSession, path: str, sep: str, columns: list[str] | None = None, multi_line: bool = True,
                     by_ranges: bool = False) -> DataFrame:
    """CSV with header, every column STRING, pandas-compatible quoting; ``POSITION`` holds the file order.

    A row with more cells than the header raises, as it would in pandas.
    ``multi_line=False`` is for files whose cells hold no line breaks: Spark
    can then split a file over many tasks.  ``by_ranges=True`` splits files whose
    cells do hold them; their quotes must be balanced (:mod:`.quoted`).
    """
    columns = columns or _columns(header_line(spark, path), sep)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_surplus"]])
    if by_ranges:
        return _checked(read_quoted_csv(spark, path, sep, schema.names, POSITION), columns, F.col(POSITION))
    df = (spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"')
          .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE")
          .option("encoding", "UTF-8").csv(path))
    return _checked(df, columns, file_position())


def _checked(df: DataFrame, columns: list[str], position) -> DataFrame:
    """Missing cells as NULL, and an error for a row with a surplus cell."""
    message = F.concat(F.lit("more cells than columns, first surplus cell: "), F.col("_surplus"))
    checked = [F.when(F.col("_surplus").isNotNull(), F.raise_error(message)).otherwise(F.col(columns[0])).alias(columns[0]), *columns[1:]]
    return na_to_null(df.select(*checked, position.alias(POSITION)), columns)


def read_pair_csv(spark: SparkSession, path: str, sep: str = ";",
                  required=REQUIRED_PAIR_COLUMNS, multi_line: bool = True, by_ranges: bool = False) -> DataFrame:
    """SRC-1: line-pair CSV (``;``), required columns checked at plan time (PRJ-1)."""
    df = require_columns(read_csv_strings(spark, path, sep, multi_line=multi_line, by_ranges=by_ranges), required)
    if "line_number" in df.columns:
        df = df.withColumn("line_number", F.col("line_number").cast("int"))
    return df


def sniff_separator(header: str, required=REQUIRED_PAIR_COLUMNS) -> str:
    """SRC-2: first of ``;``, ``,``, tab under which all required columns appear."""
    for sep in SEPARATORS:
        if set(required) <= set(_columns(header, sep)):
            return sep
    raise MissingColumns(f"no separator among {SEPARATORS!r} yields columns {list(required)}")


def read_test_csv(spark: SparkSession, path: str, required=REQUIRED_PAIR_COLUMNS, by_ranges: bool = False) -> DataFrame:
    """SRC-2: test CSV with the separator detected from the header line."""
    header = header_line(spark, path)
    sep = sniff_separator(header, required)
    return read_pair_csv(spark, path, sep, required, by_ranges=by_ranges)


def read_converter_csv(spark: SparkSession, path: str, by_ranges: bool = False) -> DataFrame:
    """SRC-3: comma CSV for the expansion job; only ``text`` is required."""
    return require_columns(read_csv_strings(spark, path, ",", by_ranges=by_ranges), ("text",))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: JSONL test samples ``{input, target, line_id?}`` in file order; a malformed line fails the read."""
    return spark.read.schema(JSONL_SCHEMA).option("mode", "FAILFAST").json(path).select("*", file_position().alias(POSITION))


def list_pages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-6: page files with their base names (file name without the last extension)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return files.select("path", base_name("path").alias("base_name"))


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: segmentation JSON documents (one per file); ``page_id`` from the file name."""
    seg = spark.read.schema(SEGMENTATION_SCHEMA).option("multiLine", True).json(path)
    return seg.select(base_name(F.input_file_name()).alias("page_id"), "*")
