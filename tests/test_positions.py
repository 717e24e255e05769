"""Global index and positional splits (WIN-1, WIN-3, AGG-20)."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from tables import SF_SMALL

from scriptorium.operators import positions
from scriptorium.operators.positions import global_index, paged_index, positional_split, split_report


@pytest.mark.parametrize("n,want", [(10643, (8514, 1064, 1065)), (7, (5, 0, 2)), (9, (7, 0, 2)), (11, (8, 1, 2))])
def test_split_sizes(spark, n, want):
    df = spark.range(n).select(F.col("id").alias("k"))
    s = positional_split(df, ["k"])
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert (counts.get("train", 0), counts.get("validation", 0), counts.get("test", 0)) == want
    # in key order: every train key precedes every validation key precedes every test key
    b = {r["split"]: (r["lo"], r["hi"]) for r in s.groupBy("split").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
    if want[1]:
        assert b["train"][1] < b["validation"][0]
    assert b["train"][1] < b["test"][0]


def test_global_index_dense_on_skewed_pages(spark):
    # one page holds a third of all rows; input arrives hash-shuffled
    hot = spark.range(3000).select(F.lit(7).alias("page_id"), F.col("id").alias("line_number"))
    rest = spark.range(6000).select((F.col("id") % 500 + 100).alias("page_id"), (F.col("id") / 500).cast("long").alias("line_number"))
    df = hot.unionByName(rest).repartition(5)
    g = global_index(df, ["page_id", "line_number"], "idx")
    chk = g.withColumn("want", F.row_number().over(Window.orderBy("page_id", "line_number")) - 1)
    assert chk.where("want != idx").count() == 0
    assert g.count() == 9000


def test_split_report_and_union(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    s = positional_split(df, ["k"])
    rep = {r["split"]: (r["rows"], r["share_pct"]) for r in split_report(s).collect()}
    assert rep == {"train": (80, 80.0), "validation": (10, 10.0), "test": (10, 10.0)}
    parts = [s.where(F.col("split") == x).select("k") for x in ("train", "validation", "test")]
    assert parts[0].intersect(parts[1]).count() == 0
    assert parts[0].unionByName(parts[1]).unionByName(parts[2]).exceptAll(df).count() == 0


def _lines(pages, more):
    lines = pages.select(F.col("doc_id").alias("page_id"), *more, F.posexplode(F.split("text", "\n")).alias("line_number", "text"))
    return lines.withColumn("line_number", F.col("line_number").cast("bigint"))


def _pages(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def _numbered_by_window(df):
    w = Window.orderBy("page_id", "line_number")
    return sorted((r["page_id"], r["line_number"], r["i"] - 1) for r in df.select("page_id", "line_number", F.row_number().over(w).alias("i")).collect())


ROWS = [(i * 7 % 101, "\n".join(["x"] * (1 + i % 5))) for i in range(100)] + [(1000, "\n".join("abc" for _ in range(3000))), (2000, None), (3000, "")]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_paged_index_equals_the_line_order(spark, monkeypatch, most):
    monkeypatch.setattr(positions, "MAX_BROADCAST_PAGES", most)
    n = F.size(F.split("text", "\n"))
    got = paged_index(_pages(spark, ROWS), F.when(F.col("text").isNotNull(), n), _lines, with_total="n")
    assert sorted((r["page_id"], r["line_number"], r["idx"]) for r in got.collect()) == _numbered_by_window(_lines(_pages(spark, ROWS), []))
    assert {r["n"] for r in got.select("n").distinct().collect()} == {got.count()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (most == 0)


def test_paged_index_with_a_null_page_and_with_repeated_pages(spark):
    n = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n")))
    for rows in ([*ROWS, (None, "a\nb")], [*ROWS, ROWS[3], (7, "p\nq\nr")], []):
        got = paged_index(_pages(spark, rows), n, _lines).collect()
        assert sorted(r["idx"] for r in got) == list(range(len(got)))
        order = sorted(got, key=lambda r: r["idx"])
        keys = [(r["page_id"] is not None, r["page_id"] or 0, r["line_number"]) for r in order]
        assert keys == sorted(keys) and len(got) == _lines(_pages(spark, rows), []).count()


@pytest.mark.parametrize("name", ["row_scores", "training_table", "padded_batches"])
def test_numbering_shuffles_no_lines(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    # documents of a file with one row group are dealt out before the explode; nothing after it but the batch of padded rows
    after = plan.split("Generate")[0]
    assert "rangepartitioning" not in after and ("Exchange" not in after or name == "padded_batches")
