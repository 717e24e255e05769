"""Short ways of per-row measures: taken where they hold, and with the results of the long ones."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.bleu import ngram_stats, tokens_13a
from scriptorium.functions.distance import NEAR, edit_distance, normalized_edit_distance
from scriptorium.functions.expand import ABBREVIATIONS, ANY_KEY, expand_literals
from scriptorium.functions.text import is_blank, ws_strip
from scriptorium.operators.scores import row_scores
from scriptorium.plans.catalogue import _prediction


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_band_before_the_whole_matrix(spark):
    rows = [("abc", "abc"), ("", ""), ("", "x" * 30), ("a" * NEAR, ""), ("a" * (NEAR + 1), ""), ("kitten ñ", "sitting n"),
            ("the quick brown fox", "a lazy dog jumps over it"), ("  a   b ", "a b"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(edit_distance("a", "b").alias("d"), edit_distance(F.upper("a"), F.upper("b")).alias("u"), normalized_edit_distance("a", "b").alias("n"))
    got = [(r["d"], r["u"], r["n"]) for r in out.collect()]
    words = lambda s: " ".join(s.split())
    assert got == [(None, None, None) if a is None or b is None else (_distance(a, b), _distance(a.upper(), b.upper()), _distance(words(a), words(b))) for a, b in rows]
    assert f"Some({NEAR})" in _plan(df.select(edit_distance("a", "b").alias("d")))


def test_texts_without_a_key_pass_the_replacements(spark):
    rows = [(k,) for k, _ in ABBREVIATIONS] + [("plain text, no key: xp & c",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", F.col("t").rlike(ANY_KEY).alias("key"), expand_literals("t").alias("e")).collect()
    assert all(r["key"] for r in got[:len(ABBREVIATIONS)])
    assert [(r["key"], r["e"]) for r in got[-3:]] == [(False, "plain text, no key: xp & c"), (False, ""), (None, None)]
    assert "RLIKE" in _plan(df.select(expand_literals("t").alias("e"))).upper()


def test_ngram_counts(spark):
    rows = [("a b a b a", "a b a c a b"), ("a a a a a", "a a"), ("x y", "p q"), ("", "a"), ("a", ""), ("a b c d e f", "a b c d e f"), ("a b c d", "b c d a b c d"), ("ab c", "a bc")]
    df = spark.createDataFrame(rows, "h string, r string").select(F.filter(F.split("h", " "), lambda w: w != "").alias("h"), F.filter(F.split("r", " "), lambda w: w != "").alias("r"))
    out = ngram_stats(df, "h", "r")
    grams = lambda t, n: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    for row, (h, r) in zip(out.collect(), rows, strict=True):
        h, r = h.split(), r.split()
        for n in range(1, 5):
            assert row[f"_bl_c{n}"] == sum((grams(h, n) & grams(r, n)).values()), (h, r, n)
            assert row[f"_bl_t{n}"] == max(len(h) - n + 1, 0)
    assert "array_sort" not in _plan(out)


def test_tokens_with_and_without_punctuation(spark):
    rows = [("it's plain text",), ("a. .b , c.,1 1,2 3.x 5-6 x-7",), ("end-\n",), ("a-\nb\nc &quot;d&amp; <skipped>",), ("  ",), ("(a) [b] {c}/d",), ("a..b 1..2",)]
    got = [r["t"] for r in spark.createDataFrame(rows, "t string").select(tokens_13a("t").alias("t")).collect()]
    assert got == [["it's", "plain", "text"], "a . . b , c . ,1 1,2 3 . x 5 - 6 x-7".split(), ["end-"], ["ab", "c", '"', "d", "&"], [],
                   "( a ) [ b ] { c } / d".split(), "a . . b 1 . . 2".split()]


def test_blank_lines_without_stripping(spark):
    spaces = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = ["", "".join(spaces), *spaces, *(s + "a" + s for s in spaces), "​", "a", " é", "\x00", "퟿", "\U0001F600 "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "ocr_prediction string")
    got = df.select(is_blank("ocr_prediction").alias("b"), (ws_strip("ocr_prediction") == "").alias("s"), _prediction().alias("p")).collect()
    assert [r["b"] for r in got] == [not t.strip() for t in texts] + [None] == [r["s"] for r in got]
    assert [r["p"] for r in got] == [t if t.strip() else "" for t in texts] + [None]
    assert "regexp_replace" not in _plan(df.select(_prediction().alias("p")))


@pytest.mark.parametrize("bleu", [False, True])
def test_lines_left_as_they_were_have_one_distance(spark, bleu):
    rows = [(1, "abc", "abc", "abd"), (2, "abc", "xbc", "abd"), (3, None, "a", "b"), (4, "a", None, "b"), (5, "a", "a", None), (6, "", "", "abc"), (7, None, None, "a")]
    out = row_scores(spark.createDataFrame(rows, "i int, o string, p string, t string"), "o", "p", "t", key=("i",), bleu=bleu)
    d = lambda a, b: None if a is None or b is None else _distance(a, b)
    assert [(r["i"], r["edit_distance"], r["ocr_errors"]) for r in out.orderBy("i").collect()] == [(i, d(p, t), d(o, t)) for i, o, p, t in rows]
    assert re.search(r"\((ocr_input|o)#\d+ = (prediction|p)#\d+\)", _plan(out))
