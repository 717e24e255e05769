"""The correcting stream equals the batch across a change of the lexicon, a failure and a restart."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import expand as X
from scriptorium.operators.correct import apply_lexicon
from scriptorium.sources.fixture import line_pairs
from scriptorium.streaming import corrections as SC

from tables import SF_SMALL

COLUMNS = ["page_id", "line_number", "ocr_prediction", "prediction"]


def _lexicon(spark, **words):
    return spark.createDataFrame(list(words.items()), "ocr_word string, text_word string")


def _broken(col):
    return F.raise_error(F.lit("a lost worker")).cast("string")


def test_stream_equals_batch_across_lexicons_failure_and_restart(spark, tmp_path):
    folder, lexicons, out = tmp_path / "tables", str(tmp_path / "lexicons"), str(tmp_path / "out")
    folder.mkdir()
    documents = pq.read_table(f"{SF_SMALL}/documents.parquet")
    parts = [documents.slice(i * 20, 20) for i in range(4)]
    pq.write_table(parts[0], folder / "documents.parquet")
    words = line_pairs(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).select(F.explode(F.split("ocr_prediction", " ")).alias("w"))
    a, b = (r["w"] for r in words.where("length(w) > 3 AND w RLIKE '^[a-z]+$'").groupBy("w").count().orderBy(F.desc("count"), "w").limit(2).collect())
    first, second = _lexicon(spark, **{a: "ONE"}), _lexicon(spark, **{a: "TWO", b: "THREE"})

    data = SC.stream_correct(spark, str(folder), lexicons, out)              # batch 0: no lexicon yet
    assert SC.publish_lexicon(first, lexicons) == 1
    pq.write_table(parts[1], folder / "documents-1.parquet")
    with pytest.raises(Exception):                                           # batch 1 sees version 1 and fails
        SC.stream_correct(spark, str(folder), lexicons, out, conversion=_broken)
    assert SC.publish_lexicon(second, lexicons) == 2
    pq.write_table(parts[2], folder / "documents-2.parquet")
    SC.stream_correct(spark, str(folder), lexicons, out)                     # batch 1 again, by version 1; batch 2 by version 2
    # A version without its marker is not there yet.
    (tmp_path / "lexicons" / "version=3").mkdir()
    assert SC.latest_version(spark, lexicons) == 2
    SC.stream_correct(spark, str(folder), lexicons, out)                     # nothing left to do

    got = spark.read.parquet(data)
    for batch, lexicon in ((0, None), (1, first), (2, second)):
        pairs = line_pairs(spark.read.parquet(str(folder / ("documents.parquet" if batch == 0 else f"documents-{batch}.parquet"))))
        expanded = pairs.withColumn("x", X.expand_abbreviations("ocr_prediction"))
        want = expanded.withColumn("prediction", F.col("x")) if lexicon is None else apply_lexicon(expanded, lexicon, src="x")
        mine = got.where(F.col("batch_id") == batch)
        assert [r["version"] for r in mine.select("version").distinct().collect()] == [batch]
        assert mine.count() == want.count() > 0
        assert mine.select(COLUMNS).exceptAll(want.select(COLUMNS)).isEmpty()
    assert not got.where("batch_id = 1 AND prediction LIKE '%ONE%'").isEmpty()
    assert got.where("batch_id < 2 AND prediction LIKE '%TWO%'").isEmpty()


def test_repeated_and_null_lines(spark):
    lines = spark.createDataFrame([(1, 0, "tbe cat tbe"), (1, 0, "tbe cat tbe"), (1, 0, "dog tbe"), (2, 0, None), (3, 0, "")],
                                  "page_id long, line_number long, ocr_prediction string")
    got = sorted(tuple(r) for r in SC.corrected(lines, _lexicon(spark, tbe="the", dog="hound"), X.expand_literals)
                 .select("page_id", "prediction").collect())
    assert got == [(1, "hound the"), (1, "the cat the"), (1, "the cat the"), (2, ""), (3, "")]


def test_a_batch_of_one_file_is_corrected_by_all_cores(spark, tmp_path, monkeypatch):
    (tmp_path / "tables").mkdir()
    pq.write_table(pq.read_table(f"{SF_SMALL}/documents.parquet").slice(0, 20), tmp_path / "tables" / "documents.parquet")
    seen, corrected = [], SC.corrected
    monkeypatch.setattr(SC, "corrected", lambda lines, *more: seen.append(lines.rdd.getNumPartitions()) or corrected(lines, *more))
    SC.stream_correct(spark, str(tmp_path / "tables"), str(tmp_path / "lexicons"), str(tmp_path / "out"))
    assert min(seen) >= spark.sparkContext.defaultParallelism > 1
