"""Operator 8: language identification."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import language_id as li
from scriptorium.llm.queries import QUERIES

from helpers import HARD_TEXTS, table

SF = "/root/testdata/sf0.01"


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for _ in range(30):
        score = rng.normal(size=(6, 3)) * 3
        value = lambda path: sum(score[i, k] for i, k in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(3), repeat=6), key=value)
        assert np.isclose(value(tuple(li.viterbi(score, 2.5))), value(best))


def test_whole_slices_equal_single_rows():
    """The test for one language throughout never changes a labelling."""
    rng = np.random.default_rng(2)
    model = li.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.ones((3, li.SCRIPTS), bool), 0, switch=3.0)
    sizes = rng.integers(0, 9, 200)
    score = rng.normal(size=(int(sizes.sum()), 3)) * 1.5

    class Runs:
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        inverse = np.arange(len(score))
        text = [""] * len(score)

    model.scores = lambda runs: score
    labels, _ = model.label(Runs)
    for lo, hi in zip(Runs.bounds[:-1], Runs.bounds[1:]):
        if hi > lo:
            value = lambda path: score[np.arange(lo, hi), path].sum() - 3.0 * (np.diff(path) != 0).sum()
            assert np.isclose(value(labels[lo:hi]), value(li.viterbi(score[lo:hi], 3.0)))


def test_held_out_accuracy(spark):
    got = QUERIES["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").cache()
    assert got.count() == 1000
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()


def model_of(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    russian = spark.createDataFrame([("Съешь ещё этих мягких французских булок да выпей чаю " * 20, "ru"), (None, "en"), ("x", None)], "text string, lang string")
    return li.fit(docs.unionByName(russian))


def test_mixed_texts_scripts_and_hard_texts(spark):
    model = model_of(spark)
    by_lang = {r.lang: r.t for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 900).groupBy("lang").agg(F.min("text").alias("t")).collect()}
    mixed = by_lang["en"][:400] + " " + by_lang["de"][:300]
    texts = [mixed, "выпей чаю", by_lang["fr"][:300] + " выпей этих булок", "ααα βββ", "123 !!", *HARD_TEXTS, "mit der und", "mit der und"]
    got = {r.doc_id: r for r in li.identify(table(spark, texts, score=["clash"] * len(texts)), model).collect()}
    assert got[0].lang_pred == "en" and [s.lang for s in got[0].spans] == ["en", "de"] and abs(got[0].spans[1].start - 401) < 40
    assert (got[1].lang_pred, got[1].spans[0].start, got[1].spans[0].end) == ("ru", 0, 9)
    assert got[2].lang_pred == "fr" and got[2].spans[-1].lang == "ru"
    assert got[3].lang_pred == model.languages[model.most_letters]
    assert (got[4].lang_pred, got[4].score, got[4].spans) == ("und", 0.0, [])
    assert got[5].lang_pred == "und"
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert got[len(texts) - 1].lang_pred == got[len(texts) - 2].lang_pred == "de"


def test_no_training_rows(spark):
    docs = table(spark, ["a b", None])
    assert li.fit(spark.createDataFrame([], "text string, lang string")) is None
    assert {r.lang_pred for r in li.identify(docs, None).collect()} == {"und"}
    assert li.identify(docs.limit(0), None).count() == 0
