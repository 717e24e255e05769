"""Byte tokens, decoding, argmax, names and base names (FIXTURES §3.3)."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import base_name
from scriptorium.functions.tokens import argmax, byte_tokens, decode_tokens, pad_to
from scriptorium.operators.pages import line_image_name


def test_byte_token_golden(spark):
    df = spark.createDataFrame([("correct OCR: lã", 128), ("abcdef", 4), ("", 128)], "t string, n int")
    got = [r[0] for r in df.select(F.array_join(byte_tokens("t", 128), ",")).collect()]
    assert got[0] == "102,114,117,117,104,102,119,35,82,70,85,61,35,111,198,166,1"
    assert got[2] == "1"
    four = df.where("n = 4").select(F.array_join(byte_tokens("t", 4), ",")).first()[0]
    assert four == "100,101,102,1"


def test_decode_roundtrip_and_cut(spark):
    rng = random.Random(11)
    alphabet = "abc ãé€😀ſꝑ"
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for r in df.select("t", decode_tokens(byte_tokens("t", 512)).alias("full"),
                       decode_tokens(byte_tokens("t", 16)).alias("cut")).collect():
        assert r["full"] == r["t"]
        b = r["t"].encode()[:15]
        assert r["cut"] == b.decode("utf-8", errors="ignore")


def test_decode_skips_special_and_label_pad(spark):
    df = spark.createDataFrame([([100, 101, 1, 0, -100],)], "ids array<int>")
    assert df.select(decode_tokens("ids")).first()[0] == "ab"


def test_pad_and_argmax(spark):
    df = spark.createDataFrame([([5, 6], [0.1, 0.9, 0.9, 0.2])], "ids array<int>, v array<float>")
    r = df.select(pad_to("ids", 4, -100).alias("p"), argmax("v").alias("a")).first()
    assert r["p"] == [5, 6, -100, -100]
    assert r["a"] == 1


def test_names(spark):
    df = spark.createDataFrame([("/a/b.c/im.x.png",), (None,), ("plain",)], "p string")
    assert [r[0] for r in df.select(base_name("p")).collect()] == ["im.x", "image", "plain"]
    assert spark.range(1).select(line_image_name(F.lit("b"), F.lit(3))).first()[0] == "b_03.png"


def test_greedy_decoding_of_positions(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from scriptorium.functions.tokens import greedy_ids, greedy_text
    from scriptorium.operators.training import evaluate_logits

    rng = np.random.default_rng(1)
    logits = rng.normal(size=(30, 6, 300)).round(1).astype(np.float32)  # rounded: ties
    logits[0, 0, 17] = logits[0, 0, 200] = 99.0
    logits[1, 2, 40] = np.nan
    rows = [(i, x.tolist(), x.ravel().tolist()) for i, x in enumerate(logits)] + [(30, [], []), (31, None, None), (32, [[None, 1.0], [None], []], None)]
    df = spark.createDataFrame(rows, "i int, nested array<array<float>>, packed array<float>")
    got = {r["i"]: r for r in df.select("i", greedy_ids("nested").alias("a"), greedy_ids("packed", 300).alias("b"), greedy_text("nested").alias("t")).collect()}
    for i, x in enumerate(logits):
        want = np.argmax(x, -1).tolist()
        assert got[i]["a"] == got[i]["b"] == want
        text = bytes(k - 3 for k in want if 3 <= k < 259).decode("utf-8", "replace")
        assert got[i]["t"].replace("�", "") == text.replace("�", "")
    assert got[0]["a"][0] == 17 and got[1]["a"][2] == 40
    assert got[30]["a"] == got[30]["b"] == [] and got[30]["t"] == "" and got[31]["a"] is got[31]["b"] is got[31]["t"] is None
    assert got[32]["a"] == [1, None, None]
    with pytest.raises(Exception, match="whole number"):
        df.where("i = 2").select(greedy_ids("packed", 7)).collect()
    one = lambda t: [[1.0 if k == b + 3 else 0.0 for k in range(259)] for b in t.encode()]
    model = spark.createDataFrame([(one("abc"), [100, 101, 102, 1, -100, -100]), (one("a"), [100, 101, -100])], "logits array<array<float>>, labels array<int>")
    m = evaluate_logits(model.withColumn("prediction", F.lit(1)), "logits", "labels").first()
    assert (m["cer"], m["edit_distance"], m["eval_samples"]) == (1 / 5, 0.5, 2)
    assert evaluate_logits(model.limit(0), "logits", "labels").first()["eval_samples"] == 0
