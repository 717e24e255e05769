"""Lexicon corrector, confusion table and the corrector seam (MOD-1..3, JOI-3)."""

from pyspark.sql import functions as F

from scriptorium.functions.text import words
from scriptorium.operators.correct import BatchCorrector, apply_lexicon, confusion_table, correct, learn_lexicon, tokens, word_pairs


def _pairs(spark):
    rows = [(1, 0, "tbe cat", "the cat"), (1, 1, "tbe dog", "the dog"), (1, 2, "a tbe", "a the"),
            (2, 0, "rnan  tbe", "man  the"), (2, 1, "rnan", "man"), (2, 2, "odd words here", "odd")]
    return spark.createDataFrame(rows, "page_id long, line_number long, ocr_prediction string, text string")


def test_learn_and_apply(spark):
    p = _pairs(spark)
    lex = {r["ocr_word"]: (r["text_word"], r["support"]) for r in learn_lexicon(p).collect()}
    assert lex == {"tbe": ("the", 4), "rnan": ("man", 2)}
    lines = spark.createDataFrame([(9, 0, "  tbe rnan\tx "), (9, 1, "")], "page_id long, line_number long, ocr_prediction string")
    out = {r["line_number"]: r["prediction"] for r in apply_lexicon(lines, learn_lexicon(p)).collect()}
    assert out[0] == "  the man\tx "          # whitespace kept verbatim
    assert out[1] == ""


def test_confusion(spark):
    t = {(r["ocr_char"], r["text_char"]): r["n"] for r in confusion_table(_pairs(spark)).collect()}
    assert t[("b", "h")] == 4


def test_batch_corrector_falls_back_line_by_line(spark):
    df = spark.createDataFrame([("abc",), ("  ",), (None,), ("boom",), ("xyz",), ("short",)], "ocr_prediction string")

    def load():
        def upper(texts):
            if "boom" in texts:
                raise RuntimeError("model failure")
            return [f" {t.upper()} " for t in texts if t != "short"]
        return upper

    for size in (1, 2, 100):
        out = correct(df.repartition(1), BatchCorrector(load, size)).collect()
        got = {r["ocr_prediction"]: (r["prediction"], r["correction_failed"]) for r in out}
        assert got == {"abc": ("ABC", False), "  ": ("", False), None: (None, False), "boom": ("boom", True),
                       "xyz": ("XYZ", False), "short": ("short", True)}


def test_whitespace_and_repeated_words_in_application(spark):
    lex = spark.createDataFrame([("a", "b"), ("b", "c")], "ocr_word string, text_word string")
    lines = spark.createDataFrame([(1, 0, " a  a b\ta "), (1, 1, "z"), (1, 2, None), (1, 3, "  ")], "page_id long, line_number long, ocr_prediction string")
    out = {r["line_number"]: r["prediction"] for r in apply_lexicon(lines, lex).collect()}
    assert out == {0: " b  b c\tb ", 1: "z", 2: "", 3: "  "}


def test_words_of_a_line_are_found_once(spark):
    plan = word_pairs(_pairs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4 and "Filter" not in plan  # two ways a side, no filter that finds them again


def test_whitespace_that_java_does_not_know(spark):
    odd = [chr(c) for c in (0x1c, 0x1f, 0x85, 0xa0, 0x1680, 0x2003, 0x2028, 0x202f, 0x205f, 0x3000)]
    rows = [f"a{c}b {c}ñ" for c in odd] + ["a\tb  c\n", " ", "", "᠎ x​", "ñ\x0bé", "😀 a😀"]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "t string")
    got = df.select("t", words("t").alias("w"), tokens("t").alias("k")).collect()
    assert [r["w"] for r in got[:-1]] == [r.split() for r in rows] and got[-1]["w"] is None and got[-1]["k"] is None
    assert all("".join(r["k"]) == r["t"] and [k for k in r["k"] if k.split()] == r["w"] for r in got[:-1])
