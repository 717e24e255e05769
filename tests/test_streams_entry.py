"""Streams equal their batch equivalents; the driver contract runs; oracle agreement at sf0.001."""

import math
import os
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from scriptorium.functions import expand as X
from scriptorium.operators.scores import score_parts
from scriptorium.sources.fixture import load_pairs
from scriptorium.streaming import streams as ST

from tables import SF_SMALL


def test_stream_metric_log_equals_batch(spark):
    log = spark.read.parquet(ST.stream_metrics_log(spark, SF_SMALL)).first()
    batch = ST.metric_row(load_pairs(spark, SF_SMALL)).first()
    assert log["eval_samples"] == batch["eval_samples"]
    assert log["cer"] == pytest.approx(batch["cer"], abs=1e-12)
    assert log["bleu"] == pytest.approx(batch["bleu"], abs=1e-9)


def test_stream_window_sums_equal_totals(spark):
    res = ST.latest_windows(spark, ST.stream_window_cer(spark, SF_SMALL))
    tot = res.agg(F.sum("events").alias("e")).first()["e"]
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert tot == events


def test_window_stream_updates_windows_and_drops_late_rows(spark, tmp_path):
    folder, out = tmp_path / "tables", str(tmp_path / "out")
    folder.mkdir()
    os.symlink(f"{SF_SMALL}/documents.parquet", folder / "documents.parquet")
    events = pq.read_table(f"{SF_SMALL}/events.parquet").slice(0, 3)

    def put(name, *times):
        stamps = pa.array([datetime.fromisoformat(t) for t in times]).cast(events.schema.field("ts").type)
        at = events.schema.get_field_index("ts")
        pq.write_table(events.slice(0, len(times)).set_column(at, events.schema.field("ts"), stamps), folder / name)

    def counts(result):
        return {r.window_start[:10]: r.events for r in ST.latest_windows(spark, result).collect()}

    put("events.parquet", "2024-01-05 10:00:00", "2024-01-07 10:00:00", "2024-01-07 11:00:00")
    assert counts(ST.stream_window_cer(spark, str(folder), out)) == {"2024-01-05": 1, "2024-01-07": 2}
    # A restarted job: one more row for the open day, and one for a day that the watermark has closed.
    put("events-2.parquet", "2024-01-07 12:00:00", "2024-01-05 11:00:00")
    assert counts(ST.stream_window_cer(spark, str(folder), out)) == {"2024-01-05": 1, "2024-01-07": 3}


def test_stream_full_expansion_equals_batch_and_restarts(spark, tmp_path):
    out = str(tmp_path / "expand")
    data = ST.stream_expand(spark, SF_SMALL, out, conversion=X.expand_abbreviations)
    columns = ["page_id", "line_number", "ocr_prediction", "prediction"]
    batch = load_pairs(spark, SF_SMALL).withColumn("prediction", X.expand_abbreviations("ocr_prediction")).select(columns)
    streamed = spark.read.parquet(data).select(columns)
    n = batch.count()
    assert streamed.count() == n > 0
    assert batch.exceptAll(streamed).isEmpty()
    # Started again on the same folder, nothing is left to do and nothing is written twice.
    ST.stream_expand(spark, SF_SMALL, out, conversion=X.expand_abbreviations)
    assert spark.read.parquet(data).count() == n


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "character_error_rate" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return v


@pytest.mark.parametrize("name", ["cer_by_lang", "evaluation_report", "lexicon_learn", "split_report",
                                  "align_lines", "page_summary", "byte_decode"])
def test_oracle_agreement_small(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == want


def test_streams_over_tables_that_are_folders(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = str(tmp_path)
    key = ["page_id", "line_number", "prediction"]
    got = spark.read.parquet(ST.stream_expand(spark, folder)).select(*key)
    want = load_pairs(spark, SF_SMALL).select("page_id", "line_number", X.expand_literals("ocr_prediction").alias("prediction"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert spark.read.parquet(ST.stream_metrics_log(spark, folder)).first()["eval_samples"] == want.count()
    a, b = (sorted(map(tuple, ST.latest_windows(spark, ST.stream_window_cer(spark, d)).collect())) for d in (folder, SF_SMALL))
    assert a == b and a


def test_entry_works_without_the_optional_parts(spark, monkeypatch):
    import sys

    base = set(E.QUERIES)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in E.queries() and base <= set(E.queries())
    monkeypatch.setitem(sys.modules, "scriptorium.llm", None)
    monkeypatch.setitem(sys.modules, "scriptorium.llm.queries", None)
    assert set(E.queries()) == base and set(E.oracle_sql()) <= base
