"""Tokens and n-gram counts of whole batches: equal to the rules applied to one text after the other."""

import random
import re
from collections import Counter

import models
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import bleu, ngramcounts
from scriptorium.functions.bleu import tokens_13a, with_sentence_bleu
from scriptorium.functions.ngramcounts import pair_counts
from scriptorium.plans import catalogue  # noqa: F401  (registers queries)
from scriptorium.plans.registry import QUERIES

ODD = ["1,2,3 4,,5 a..b 1..2 c.,1 .5 6. 7.8", "x-1 1-x 5-6 5--6 -- 3-", "end-\n", "a-\nb\nc &quot;d&amp; <skipped>.", "(a)[b]{c}/d it's", "1&lt;2 &gt;3",
       "a　b c\u0085d e f g h", "é — ñ ’x’ 。 ê", "  ", "", "\x1c \x1f", "a a a a a a", "a a", "<skipped>", "&amp;quot;"]


def _counts(a, b):
    h, r = models.tok13a(a), models.tok13a(b)
    grams = lambda t, n: Counter(zip(*(t[k:] for k in range(n))))
    return [len(h), len(r), *(sum((grams(h, n) & grams(r, n)).values()) for n in range(1, 5))]


def _pairs():
    rng = random.Random(11)
    pieces = list("ab1 2.,.,-&;'\"(é   ") + ["\n", "-\n", "&lt;", "ab ", "1,2"]
    some = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(0, n)))
    pairs = [(a, b) for a in ODD for b in ODD]
    for n in (4, 15, 30, 70, 300):
        for _ in range(150):
            a = some(n)
            pairs.append((a, some(n) if rng.random() < 0.4 else a[: len(a) // 2] + some(3) + a[len(a) // 2 + 1:]))
    return pairs


@pytest.mark.parametrize("slice_bytes", [1, 1 << 19])
def test_counts_of_pairs(monkeypatch, slice_bytes):
    monkeypatch.setattr(ngramcounts, "SLICE_BYTES", slice_bytes)
    pairs = _pairs()
    # a null hypothesis stands for the reference; the arrays begin inside their buffers
    hyp = pa.array(["x", *(None if a == b and i % 2 else a for i, (a, b) in enumerate(pairs))])[1:]
    ref = pa.array(["y z", *(b for _, b in pairs)])[1:]
    got = pair_counts(hyp, ref).tolist()
    assert [(p, g) for p, g in zip(pairs, got, strict=True) if g != _counts(*p)] == []
    assert max(g[0] for g in got) > 64 and any(16 < g[0] <= 32 for g in got) and any(32 < g[0] <= 64 for g in got)
    assert pair_counts(pa.array([], pa.string()), pa.array([], pa.string())).shape == (0, 6)


def test_tokens_without_batches(spark):
    texts = sorted({t for p in _pairs() for t in p} | {"\x01a\x7f'b-c_d 1-2 -3 4.5", "1," * 700 + " a.b", "x" * 5000 + "."})
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens_13a("t").alias("k")).collect()
    assert [(r["t"], r["k"]) for r in got if r["k"] != models.tok13a(r["t"])] == []
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(tokens_13a("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert bleu._13A_TOKEN in plan


def test_equal_bytes_are_equal_tokens_only():
    # one number a token, whatever hashes there are: words of two letters in every order
    words = [f"{a:b}".translate({48: "a", 49: "b"}) for a in range(1, 3000)]
    numbers, first = ngramcounts.token_numbers(pa.array([" ".join(words), " ".join(words[::-1])]))
    assert first.tolist() == [0, len(words), 2 * len(words)]
    assert len(set(numbers.tolist())) == len(words) and np.array_equal(numbers[: len(words)], numbers[len(words):][::-1])


def test_sentence_bleu_runs_no_rule_by_itself(spark):
    df = spark.createDataFrame([("a, b. c", "a, b c"), (None, "a"), ("a", None), ("a b.", "a b."), ("", "")], "h string, r string")
    out = with_sentence_bleu(df, "h", "r")
    assert [r["bleu_score"] for r in out.collect()] == pytest.approx([models.bleu(a or "", b or "") for a, b in df.collect()], abs=1e-12)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan and "array_intersect" not in plan


def test_bleu_stats_of_own_documents(spark, tmp_path):
    texts = [(1, "the cat, much unlike a clam, sat. It was 1,200 years old and not amused by music.\nmum", "en"), (2, "un coucou a chanté; mamma mia!", "fr"), (3, None, "fr"), (4, "", None)]
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in texts], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def noisy(t, n):
        base = t.replace("u", "n").replace("c", "e").replace("m", "rn")
        return t if n % 4 == 0 else base.replace(" a", " ") if n % 7 == 0 else base.replace("th", "tb").replace("li", "h")

    scores = [(lang, models.bleu(noisy(line, n), line)) for _, t, lang in texts if t for n, line in enumerate(re.findall(".{1,48}", t))]
    out = QUERIES["bleu_stats"](spark, str(tmp_path))
    got = {r["lang"]: (r["bleu_score_mean"], r["bleu_score_std"], r["total_samples"]) for r in out.collect()}
    of = {lang: [s for x, s in scores if lang in (None, x)] for lang in ("en", "fr", None)}
    assert got == {lang: (pytest.approx(np.mean(s), abs=1e-6), pytest.approx(np.std(s), abs=1e-6), len(s)) for lang, s in of.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp") == 1 and "rlike" not in plan  # that of the lines
