"""Correction of unseen words: candidates against brute force, ranking by a plain model, quality on held-out lines."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_align import plain

from scriptorium.operators import correct as C
from scriptorium.operators import spell as SP
from scriptorium.operators.metrics import cer
from scriptorium.functions.distance import normalized_edit_distance
from scriptorium.functions.text import ws_normalize


def make_words(n, seed):
    rng = random.Random(seed)
    base = {"".join(rng.choice("abdeñ") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 18, 19, 20, 21, 22, 23, 24, 40]))) for _ in range(n)}
    out = set(base)
    for w in list(base):
        x = list(w)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(x) + 1)
            rng.choice([lambda: x.insert(at, "d"), lambda: x.pop() if len(x) > 1 else None, lambda: x.__setitem__(at % len(x), "e")])()
        out.add("".join(x))
    return sorted(out)


@pytest.mark.parametrize("per_edit", [3, 1])
def test_candidates_equal_brute_force(spark, per_edit):
    every = make_words(150, 1)
    unknown, known = every[::3], [w for k, w in enumerate(every) if k % 3 or k % 9 == 0]
    u = spark.createDataFrame([(w,) for w in unknown], "word string")
    v = spark.createDataFrame([(w, len(w)) for w in known], "word string, n bigint")
    got = Counter(tuple(r) for r in SP.candidates(u, v, per_edit).select("word", "candidate", "n", "distance").collect())
    want = Counter((a, b, len(b), d) for a in unknown for b in known if a != b and abs(len(a) - len(b)) <= 2
                   and (d := plain(a, b)) <= min(2, len(a) // per_edit))
    assert got == want and any(len(a) > SP.LONG for a, *_ in want)


def test_empty_tables_and_very_long_words(spark):
    u = spark.createDataFrame([("x" * 5000,), ("",), ("ab",)], "word string")
    v = spark.createDataFrame([("x" * 4999 + "y", 3)], "word string, n bigint")
    assert [tuple(r)[1:] for r in SP.candidates(u, v).select("word", "n", "distance").collect()] == [(3, 1)]
    assert SP.candidates(u, v.limit(0)).collect() == [] and SP.candidates(u.limit(0), v).collect() == []
    weights = spark.createDataFrame([], "a_part string, b_part string, n bigint")
    assert SP.ranked(SP.candidates(u, v), weights).first()["score"] == math.floor(100 * math.log(4))


def test_parts_that_differ(spark):
    rows = [("rnap", "map"), ("abc", "abc"), ("", "x"), ("aa", "aaa"), ("tbe", "the"), ("ab", "ba"), ("ñx", "ñy")]
    df = SP.differing_parts(spark.createDataFrame(rows, "a string, b string"), "a", "b")
    assert [(r["a_part"], r["b_part"]) for r in df.collect()] == [("rn", "m"), ("", ""), ("", "x"), ("", "a"), ("b", "h"), ("ab", "ba"), ("x", "y")]


def test_ranking_prefers_known_confusions_and_frequent_words(spark):
    found = spark.createDataFrame([("rnat", "mat", 50, 2), ("rnat", "brat", 900, 2), ("cnt", "cut", 20, 1), ("cnt", "cat", 400, 1), ("zzz", "zzy", 3, 1), ("ncn", "uen", 30, 2)],
                                  "word string, candidate string, n bigint, distance bigint")
    weights = spark.createDataFrame([("rn", "m", 300), ("n", "u", 500), ("c", "e", 200)], "a_part string, b_part string, n bigint")
    lg = lambda n: math.floor(100 * math.log(1 + n))
    got = {(r["word"], r["candidate"]): r["score"] for r in SP.ranked(found, weights).collect()}
    assert got["rnat", "mat"] == lg(50) - (lg(1000) - lg(300)) and got["rnat", "brat"] == lg(900) - 2 * lg(1000)
    assert got["cnt", "cat"] == lg(400) - lg(1000)
    assert got["ncn", "uen"] == lg(30) - (lg(1000) - lg(500)) - (lg(1000) - lg(200))
    best = {r["ocr_word"]: r["text_word"] for r in SP.corrections(found, weights).collect()}
    assert best == {"rnat": "mat", "cnt": "cut", "ncn": "uen"}  # zzz: too costly for a rare word


def test_held_out_error_falls_below_the_lexicons(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("mnprstul") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(400)]

    def line(p):
        text = " ".join(rng.choice(vocabulary) for _ in range(6))
        ocr = "".join({"m": "rn", "u": "n", "l": "i"}.get(c, c) if rng.random() < p else c for c in text)
        return ocr, text

    train = spark.createDataFrame([line(0.1) for _ in range(900)], "ocr_prediction string, text string")
    test = spark.createDataFrame([(k, 0, *line(0.3)) for k in range(200)], "page_id bigint, line_number bigint, ocr_prediction string, text string")
    lexicon = C.learn_lexicon(train)

    def error(lex):
        out = C.apply_lexicon(test, lex)
        parts = out.select(normalized_edit_distance("prediction", "text").alias("ed_norm"), F.length(ws_normalize("text")).alias("ref_norm_len"))
        return parts.agg(cer().alias("c")).first()["c"]

    assert error(SP.extend_lexicon(lexicon, train, test)) < 0.7 * error(lexicon)


def test_one_pass_teaches_what_three_did(spark):
    rows = [("tbe cat", "the cat"), ("tbe rnan", "the man"), ("a tbe rnan", "the man"), (None, "the end"), ("x", None), ("", ""), ("tbe", "tie"), ("tbe", "the")]
    pairs = spark.createDataFrame(rows, "ocr_prediction string, text string")
    learned = SP.learn(pairs)
    sets = lambda df: Counter(tuple(r) for r in df.collect())
    assert sets(learned.vocabulary) == sets(SP.word_counts(pairs, "text")) == Counter([("the", 5), ("cat", 1), ("man", 2), ("end", 1), ("tie", 1)])
    assert sets(learned.lexicon) == sets(C.learn_lexicon(pairs)) == Counter([("tbe", "the", 3, 4)])
    assert sets(learned.weights) == Counter([("b", "h", 3), ("b", "i", 1), ("rn", "m", 1)])
