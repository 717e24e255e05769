"""Histograms that read their rows once, and metric trends over runs cut in ranges."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import analysis as A


def _bins(values, bins):
    seen = [v for v in values if v is not None]
    lo, hi = min(seen), max(seen)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    out = {}
    for v in seen:
        b = min(int((v - lo) * bins / (hi - lo)), bins - 1)
        out[b] = out.get(b, 0) + 1
    return out


@pytest.mark.parametrize("values", [[0.0, 100.0, 50.0, None, 33.3, 33.4, 99.99, 0.0], [7.5, 7.5, None], [-3.0, 4.0, 4.0]])
def test_histogram_equals_model(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["bin"]: r["n"] for r in A.histogram(df, "v", 10).collect()}
    assert got == _bins(values, 10)
    whole = df.select(F.floor("v").cast("int").alias("v"))
    assert {r["bin"]: r["n"] for r in A.histogram(whole, "v", 10).collect()} == _bins([None if v is None else int(v // 1) for v in values], 10)


def test_histogram_without_values(spark):
    for rows in ([], [(None,), (None,)]):
        df = A.histogram(spark.createDataFrame(rows, "v double"), "v")
        assert df.columns == ["bin", "lower", "upper", "n"] and df.collect() == []


def test_histogram_computes_its_column_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        calls.add(1)
        return float(x % 7)

    h = A.histogram(spark.range(0, 1000, 1, 4).select(slow("id").alias("v")), "v", 7)
    assert sum(r["n"] for r in h.collect()) == 1000
    assert calls.value == 1000
    assert "ReusedExchange" in h._jdf.queryExecution().executedPlan().toString()


def _trend(rows):
    out, prev, best = set(), {}, {}
    for run, step, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if v is not None:
            best[run] = min(best.get(run, v), v)
        p = prev.get(run)
        out.add((run, step, v, p, None if v is None or p is None else round(v - p, 6), best.get(run)))
        prev[run] = v
    return out


@pytest.mark.parametrize("ranges", [1, 3, 16, 64])
def test_metric_trend_equals_model_however_it_is_cut(spark, ranges):
    rnd = random.Random(5)
    rows = [(run, step, None if rnd.random() < 0.1 else round(rnd.random(), 4))
            for run, n in (("long", 400), ("a", 1), ("b", 3), ("z", 40), (None, 30)) for step in range(n)]
    df = spark.createDataFrame(rows, "run string, step long, cer double")
    got = {tuple(r) for r in A.metric_trend(df, ranges=ranges).collect()}
    assert got == _trend(rows)


def test_metric_trend_spreads_one_run(spark):
    one = spark.range(100_000).select(F.lit("r").alias("run"), F.col("id").alias("step"), (F.col("id") % 997 / 997.0).alias("cer"))
    sizes = [r["count"] for r in A.step_ranges(one, 8).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 25_000
    trend = A.metric_trend(one, ranges=8)
    assert trend.count() == 100_000 and trend.where("best_cer_so_far <> 0").isEmpty()
    assert trend.where("step > 0 AND prev_cer IS NULL").isEmpty()


def test_metric_trend_of_an_empty_log(spark):
    assert A.metric_trend(spark.createDataFrame([], "run string, step long, cer double")).collect() == []
