"""Operators 4 and 7: quality rules and quality classifier."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import quality_classifier as qc
from scriptorium.llm import quality_rules as qr
from scriptorium.llm.queries import QUERIES

from helpers import COMPLEMENT, HARD_TEXTS, WORD, documents, prose, table, thue_morse

SF = "/root/testdata/sf0.01"


def counts(text):
    words = WORD.findall(text or "")
    times = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if times[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_of_hard_texts(spark):
    texts = HARD_TEXTS + ["a b c a b c a", "x\nx\n\nx\ny #|", "é ü <b>", prose(1, 80), prose(1, 80)]
    got = {r.doc_id: r for r in qr.judge(table(spark, texts, kept=["clash"] * len(texts)), np.zeros(qr.BUCKETS, np.float32)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), repr((t or "")[:40])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)


def test_counts_add_up_and_ratio_is_the_mean(spark):
    raw = table(spark, [prose(i, 100) for i in range(30)] + ["zz## " * 60, None])
    target = raw.where("doc_id < 20")
    counted = {r.bucket: r.n for r in qr.count_buckets(raw).collect()}
    n = sum(2 * len(WORD.findall(r.text or "")) - 1 for r in raw.where("text IS NOT NULL").collect())
    assert sum(counted.values()) == n
    ratios = qr.log_ratios(raw, target)
    t, w = np.zeros(qr.BUCKETS), np.zeros(qr.BUCKETS)
    for r in qr.count_buckets(target).collect():
        t[r.bucket] = r.n
    for b, k in counted.items():
        w[b] = k
    assert np.allclose(ratios, np.log((t + qr.SMOOTHING) / (t.sum() * w / n + qr.SMOOTHING)), atol=1e-5)
    got = {r.doc_id: r for r in qr.judge(raw, ratios).collect()}
    assert got[0].kept and not got[30].kept and got[30].ratio < got[0].ratio
    assert not qr.log_ratios(raw, target.limit(0)).any()


def test_rules_keep_good_documents(spark):
    rules = QUERIES["op4_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    found = {(r.quality, r.kept): r["count"] for r in rules.groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) == 0
    assert found.get((0, False), 0) >= 0.6 * sum(n for (q, _), n in found.items() if q == 0)


def test_classifier_on_the_held_out_fold(spark):
    scored = QUERIES["op7_quality_classifier"](spark, SF).cache()
    assert scored.count() == 1000 and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert scored.where("predicted <> CAST(score >= 0.7 AS INT)").count() == 0
    assert scored.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) != F.col("held_out")).count() == 0
    held = scored.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    right, total = held.where("predicted = quality").count(), held.count()
    assert right >= 0.95 * total


def test_fit_equals_plain_statistics(spark):
    texts = [prose(i, 100) for i in range(40)] + [f"{prose(i, 40)} ### $$$ && {prose(i, 5).upper()}!!" for i in range(30)]
    docs = table(spark, texts).repartition(5)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(70)] + [(3, 1), (500, 0), (None, 1)], "doc_id bigint, quality int")
    model = qc.fit(docs, labels)
    from scriptorium.llm.batches import utf8
    import pyarrow as pa

    x = qc.statistics(*utf8(pa.array(texts)))
    assert np.allclose(model.means[1], x[:40].mean(0)) and np.allclose(model.means[0], x[40:].mean(0))
    got = {r.doc_id: r.score for r in qc.classify(docs, model).collect()}
    assert min(got[i] for i in range(40)) > 0.7 > max(got[i] for i in range(40, 70))


def test_classifier_bears_hard_texts(spark):
    docs = documents(spark, HARD_TEXTS + [prose(1, 50), prose(1, 50)])
    nothing = spark.createDataFrame([], "doc_id bigint, quality int")
    assert qc.fit(docs, nothing) is None
    assert {r.score for r in qc.classify(docs, None).collect()} == {0.5}
    assert qc.keep_good(docs, None).count() == docs.count()
    good = spark.createDataFrame([(i, i % 2) for i in range(len(HARD_TEXTS))], "doc_id bigint, quality int")
    model = qc.fit(docs, good)
    scores = [r.score for r in qc.classify(docs, model).collect()]
    assert len(scores) == len(HARD_TEXTS) + 2 and all(0 <= s <= 1 for s in scores)
    assert qc.keep_good(docs, model).columns == docs.columns
    assert qc.classify(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("bound", [10, 20])
def test_labelled_rows_are_bounded(spark, bound):
    docs = table(spark, [prose(i, 30 + i % 2) for i in range(50)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    assert np.allclose(qc.fit(docs, labels, max_labelled=bound).means, qc.fit(docs, chosen).means)


def test_lines_that_defeat_polynomial_hashes(spark):
    line = thue_morse(2048)
    texts = [f"{line}\n{line.translate(COMPLEMENT)}", f"{line}\n{line}"]
    got = {r.doc_id: r.n_dup_lines for r in qr.judge(table(spark, texts), np.zeros(qr.BUCKETS, np.float32)).collect()}
    assert got == {0: 0, 1: 1}


def test_contradicting_labels(spark):
    docs = table(spark, [prose(i, 80) if i % 2 else "## " * 30 + str(i) for i in range(40)])
    labels = [(i, i % 2) for i in range(40)] + [(1, 1), (1, 0), (3, 0)]  # 1: two to one, 3: undecided
    clear = [(i, i % 2) for i in range(40) if i != 3]
    models = [qc.fit(docs, spark.createDataFrame(x, "doc_id bigint, quality int")) for x in (labels, clear)]
    a, b = ({r.doc_id: r.score for r in qc.classify(docs, m).collect()} for m in models)
    assert a == b
