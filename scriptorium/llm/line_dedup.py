"""Line dedup by site-relative frequency (operator 9).

For each host, the pages that hold a line are divided by the host's pages; a
line on more than ``RATIO`` of them, and on at least ``LEAST_PAGES``, is
boilerplate there and dropped from that host's pages.  Pages are counted by
content: exact copies of a page on a host are one page, so that mass copies of
an article do not turn its lines into boilerplate.

``RATIO`` is set from the shares of all lines on all hosts, not from the few at
the top.  Lines on more than 5 % are one or two in the whole corpus; those on
0.5 to 5 % stand on most hosts in documents that have little else in common;
below 0.3 % the holders begin to be near copies of each other.  Near copies
are different pages, though: a group of them that is larger than the ratio of
its host loses the lines it shares.  README has what each setting catches.

Only hashes travel: lines are counted as (host, line, page) triples, first
made distinct and then counted, both with partial aggregation, so a host or
line with a third of all rows is spread over the tasks.  Texts are shuffled
once, to meet the lines that go.

Semantics: lines are what ``\\n`` separates, compared without blanks at their
ends; blank lines are never dropped.  Every row is kept, a text of boilerplate
alone becomes empty; null texts stay null and count no page; a null host is a
host of its own; repeated rows and ids are treated alike; all other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import unused

RATIO = 0.005
LEAST_PAGES = 5


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_table(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, page, lines): content hash and distinct hashes of the lines that are not blank, of rows with a text."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != "")
    return (df.where(F.col(text).isNotNull())
            .select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.array_distinct(F.transform(lines, _line_hash)).alias("lines")))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line): the lines that are boilerplate on each host."""
    table = line_table(df, host, text)
    pages = table.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (table.select("host", "page", F.explode("lines").alias("line")).distinct()
              .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages))
    return (counts.join(pages.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
            .where(F.col("n") > ratio * F.col("pages")).select("host", "line"))


def drop_boilerplate(df: DataFrame, id_col: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO,
                     least_pages: int = LEAST_PAGES, dropped: str | None = None) -> DataFrame:
    """``df`` with the boilerplate lines of each row's host gone from its text; ``dropped`` names a column for their number."""
    # Rows meet their lines by id and host; a null id, which many rows may share, is told apart by the text.
    own, other, site, gone, line, known_host = (unused(df, c) for c in ("_id", "_text", "_host", "_gone", "_line", "_known"))
    apart = F.when(F.col(id_col).isNull(), F.xxhash64(text))
    known = boilerplate(df, host, text, ratio, least_pages).select(F.col("host").alias(known_host), F.col("line").alias(line))
    rows = (df.where(F.col(text).isNotNull())
            .select(F.col(id_col).alias(own), apart.alias(other), F.col(host).alias(site),
                    F.explode(F.array_distinct(F.transform(F.split(text, "\n", -1), _line_hash))).alias("hash")))
    lost = (rows.join(known, (F.col(line) == F.col("hash")) & F.col(known_host).eqNullSafe(F.col(site)))
            .groupBy(own, other, site).agg(F.collect_set("hash").alias(gone)))
    joined = df.join(lost, F.col(id_col).eqNullSafe(F.col(own)) & apart.eqNullSafe(F.col(other)) & F.col(host).eqNullSafe(F.col(site)), "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(gone, _line_hash(x)))
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    columns = [cleaned.alias(c) if c == text else F.col(c) for c in df.columns]
    if dropped:
        columns.append(F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("bigint").alias(dropped))
    return joined.select(*columns)


#: The same for documents, in DuckDB SQL; line and page hashes are replaced by the strings themselves.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT DISTINCT source AS host, text AS page, trim(line) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
  WHERE trim(line) <> ''
), pages AS (
  SELECT source AS host, count(DISTINCT text) AS pages FROM documents WHERE text IS NOT NULL GROUP BY source
), counts AS (
  SELECT host, line, count(*) AS n FROM lines GROUP BY host, line
), gone AS (
  SELECT c.host, c.line FROM counts c JOIN pages p ON c.host IS NOT DISTINCT FROM p.host
  WHERE c.n >= {LEAST_PAGES} AND c.n > {RATIO} * p.pages
), numbered AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), marked AS (
  SELECT n.doc_id, n.i, n.line, g.line IS NOT NULL AS boiler
  FROM numbered n LEFT JOIN gone g ON trim(n.line) = g.line AND n.source IS NOT DISTINCT FROM g.host
), cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT boiler), '') AS text,
         count(*) FILTER (WHERE boiler) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, c.text, coalesce(c.n_dropped, 0) AS n_dropped FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""
