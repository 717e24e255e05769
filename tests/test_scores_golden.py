"""Golden vectors (FIXTURES §3.1) and Python-model checks for the row scores."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import distance as D
from scriptorium.functions.bleu import with_sentence_bleu
from scriptorium.functions.text import words, ws_normalize, ws_strip
from scriptorium.operators import metrics as M
from scriptorium.operators.scores import score_parts

import models

GOLDEN = [
    ("Ius dei occultare. la terza un tẽtatis fa", "Ius dei occultaret. la terza ut tetatis fa",
     3, 3, 42, 8, (17, 42), (17, 42), (5, 8), 0.233569),
    ("ti perlo peccato:cessi uolse esser tenta", "ti per lo peccato: Cossi uolse esser tenta",
     4, 4, 42, 8, (8, 42), (8, 42), (1, 8), 0.238752),
    ("Uctus ẽ iesus in desertũ a sai", "Vctus est iesus in desertum a spi",
     7, 7, 33, 7, (8, 33), (8, 33), (3, 7), 0.145358),
    ("", "abc", 3, 3, 3, 1, (0, 3), (0, 3), (0, 1), 0.0),
    ("abc", "", 3, 3, 0, 0, (0, 3), (0, 3), (0, 1), 0.0),
    ("  a  b ", "a b", 4, 0, 3, 2, (2, 4), (2, 4), (2, 2), 1.0),
    ("ab", "ab  c", 3, 2, 4, 2, (4, 5), (2, 5), (1, 2), 0.367879),
    ("ab", "a b", 1, 1, 3, 2, (1, 3), (1, 3), (0, 2), 0.0),
    ("a", "a b", 2, 2, 3, 2, (2, 3), (1, 3), (1, 2), 0.367879),
]


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(GOLDEN)], "i int, p string, r string")
    return df


def test_golden_pair_scores(spark, golden):
    out = score_parts(golden, pred="p", ref="r").orderBy("i").collect()
    for row, g in zip(out, GOLDEN):
        assert row["ed"] == g[2]
        assert row["ed_norm"] == g[3]
        assert row["ref_norm_len"] == g[4]
        assert row["ref_words"] == g[5]
        assert (row["pad_match"], row["char_total"]) == g[6]
        assert (row["trunc_match"], row["char_total"]) == g[7]
        assert (row["word_match"], row["word_total"]) == g[8]
        assert row["bleu_score"] == pytest.approx(g[9], abs=1e-6)


def test_corpus_cer_wer(spark, golden):
    parts = score_parts(golden.where("i < 3"), pred="p", ref="r", bleu=False)
    r = parts.agg(M.cer().alias("cer"), M.wer_reference().alias("wer"),
                  F.sum("ed_norm").alias("e"), F.sum("ref_norm_len").alias("n"), F.sum("ref_words").alias("w")).first()
    assert (r["e"], r["n"], r["w"]) == (14, 117, 23)
    assert r["cer"] == pytest.approx(0.1196581, abs=1e-7)
    assert r["wer"] == pytest.approx(0.6086957, abs=1e-7)


def test_empty_input_metrics_are_zero(spark):
    empty = spark.createDataFrame([], "p string, r string")
    r = score_parts(empty, pred="p", ref="r").agg(M.cer().alias("c"), M.exact_match_rate().alias("e")).first()
    assert (r["c"], r["e"]) == (0.0, 0.0)


def _random_text(rng, n):
    alphabet = "abcde ẽũñ\t　 .,;-'\"()0123456789Aé"
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))


def test_against_python_model(spark):
    rng = random.Random(7)
    rows = [(i, _random_text(rng, 30), _random_text(rng, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p string, r string")
    got = with_sentence_bleu(df.select(
        "i", "p", "r",
        D.edit_distance("p", "r").alias("ed"), ws_normalize("p").alias("np"), ws_strip("p").alias("sp"),
        D.padded_char_matches("p", "r").alias("pm"), D.truncated_char_matches("p", "r").alias("tm"),
        D.char_positions("p", "r").alias("ct"), D.word_matches("p", "r").alias("wm"),
        D.word_positions("p", "r").alias("wt"),
        F.size(words("p")).alias("nw")), "p", "r")
    got = D.with_word_edit_distance(got, "p", "r", "wed").collect()
    for row in got:
        p, r = row["p"], row["r"]
        assert row["ed"] == models.lev(p, r)
        assert row["np"] == models.norm(p)
        assert row["sp"] == p.strip()
        assert (row["pm"], row["ct"]) == models.padded(p, r)
        assert (row["tm"], row["ct"]) == models.truncated(p, r)
        assert (row["wm"], row["wt"]) == models.word_acc(p, r)
        assert row["wed"] == models.word_lev(p, r)
        assert row["nw"] == len(p.split())
        assert row["bleu_score"] == pytest.approx(models.bleu(p, r), abs=1e-9)


def test_levenshtein_properties(spark):
    rng = random.Random(3)
    rows = [(_random_text(rng, 20), _random_text(rng, 20)) for _ in range(100)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select(D.edit_distance("a", "b").alias("ab"), D.edit_distance("b", "a").alias("ba"),
                       D.edit_distance("a", "a").alias("aa"), (F.col("a") == F.col("b")).alias("eq")).collect():
        assert r["ab"] == r["ba"]
        assert r["aa"] == 0
        assert (r["ab"] == 0) == r["eq"]


def test_std_and_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    r = df.agg(F.stddev_pop("x").alias("s"), F.median("x").alias("m")).first()
    assert r["s"] == pytest.approx(1.2472191289, abs=1e-9)
    assert r["m"] == 2.0
