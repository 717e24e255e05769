"""Pages packed into files: read back by id, and nothing visible of what failed."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import pagefiles as PF
from scriptorium.sources.fixture import load_pairs

from tables import SF_SMALL


def _texts(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["part"]):
        out[r["page"]] = out.get(r["page"], "") + r["text"]
    return out


def test_pages_are_read_back_by_id(spark, tmp_path):
    out = str(tmp_path / "pages")
    pairs = load_pairs(spark, SF_SMALL).select("page_id", "line_number", "text")
    PF.write_pages(pairs, out, "page_id", ["line_number"], "text")
    want = {}
    for r in pairs.orderBy("page_id", "line_number").collect():
        want[str(r["page_id"])] = want.get(str(r["page_id"]), "") + r["text"] + "\n"
    assert _texts(PF.read_pages(spark, out)) == want
    some = spark.createDataFrame([(3,), (17,), (17,), (10 ** 9,)], "id long")
    assert _texts(PF.read_pages(spark, out, some)) == {k: want[k] for k in ("3", "17")}
    assert len(glob.glob(f"{out}/data/*.txt")) <= spark.sparkContext.defaultParallelism * 4   # tasks, not pages
    # A second write replaces the first.
    PF.write_pages(pairs.where("page_id = 5"), out, "page_id", ["line_number"], "text")
    assert _texts(PF.read_pages(spark, out)) == {"5": want["5"]}


def test_one_large_page_is_cut_and_stays_in_order(spark, tmp_path):
    out = str(tmp_path / "large")
    lines = spark.range(40_000).select(F.lit("p").alias("page"), "id", F.format_string("line %05d ü", "id").alias("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        PF.write_pages(lines, out, "page", ["id"], "t")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert PF.page_index(spark, out).count() > 1
    assert _texts(PF.read_pages(spark, out)) == {"p": "".join(f"line {i:05d} ü\n" for i in range(40_000))}


def test_null_ids_null_lines_and_no_rows(spark, tmp_path):
    out = str(tmp_path / "odd")
    rows = spark.createDataFrame([(None, 1, "x"), ("a", 2, None), ("a", 1, "y"), ("ü/../", 1, "z")], "page string, n int, t string")
    PF.write_pages(rows, out, "page", ["n"], "t")
    assert _texts(PF.read_pages(spark, out)) == {None: "x\n", "a": "y\n\n", "ü/../": "z\n"}
    assert _texts(PF.read_pages(spark, out, rows.where("page IS NULL").select("page"))) == {None: "x\n"}
    PF.write_pages(rows.where("false"), out, "page", ["n"], "t")
    assert PF.read_pages(spark, out).collect() == []


def test_a_failed_write_leaves_the_earlier_pages(spark, tmp_path):
    out = str(tmp_path / "failed")
    rows = spark.range(2000).select(F.col("id").alias("page"), F.lit(1).alias("n"), F.lit("first").alias("t"))
    PF.write_pages(rows, out, "page", ["n"], "t")
    names = json.load(open(f"{out}/{PF.MANIFEST}"))

    @F.udf("string")
    def fails_late(page):
        if page == 1999:
            raise ValueError("lost")
        return "second"

    with pytest.raises(Exception):
        PF.write_pages(rows.withColumn("t", fails_late("page")), out, "page", ["n"], "t")
    assert json.load(open(f"{out}/{PF.MANIFEST}")) == names
    assert set(_texts(PF.read_pages(spark, out)).values()) == {"first\n"}


def test_a_damaged_file_is_noticed(spark, tmp_path):
    out = str(tmp_path / "damaged")
    PF.write_pages(spark.createDataFrame([("a", 1, "text")], "page string, n int, t string"), out, "page", ["n"], "t")
    path = glob.glob(f"{out}/data/*.txt")[0]
    with open(path, "r+b") as f:
        f.write(b"T")
    with pytest.raises(Exception, match="damaged"):
        PF.read_pages(spark, out).collect()
