"""Measures of whole batches of pairs: equal to those of one pair after the other."""

import random

import models
import pyarrow as pa
import pytest

from scriptorium.functions import ngramcounts, pairparts
from scriptorium.functions.pairparts import batch_parts, text_distances
from scriptorium.operators.scores import PART_COLUMNS, score_parts
from scriptorium.streaming.streams import metric_row


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _model(a, b):
    both = lambda f: None if a is None or b is None else f()
    one = lambda s, f: None if s is None else f(s)
    return {"ed": both(lambda: _lev(a, b)), "ed_norm": both(lambda: _lev(models.norm(a), models.norm(b))), "exact": both(lambda: a.strip() == b.strip()),
            "pad_match": both(lambda: models.padded(a, b)[0]), "trunc_match": both(lambda: models.truncated(a, b)[0]), "word_match": both(lambda: models.word_acc(a, b)[0]),
            "pred_chars": one(a, lambda s: len(s.strip())), "pred_words": one(a, lambda s: len(s.split())), "ref_chars": one(b, lambda s: len(s.strip())),
            "ref_words": one(b, lambda s: len(s.split())), "ref_norm_len": one(b, lambda s: len(models.norm(s)))}


def _pairs(alphabet):
    rng = random.Random(len(alphabet))
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    pairs = [("", ""), (None, None), (None, " a "), (" a b", None), ("   ", ""), ("", "abc"), ("a b", "a  b "), (" a", "a"), ("x" * 64, "x" * 63 + "y"), ("x" * 65, "y" * 65), ("a" * 200, "b")]
    for n in (3, 20, 50, 70, 150):
        for _ in range(60):
            a = some(n)
            pairs.append((a, a if rng.random() < 0.2 else some(n) if rng.random() < 0.3 else a[: len(a) // 2] + some(4) + a[len(a) // 2 + 1:]))
    return pairs


@pytest.mark.parametrize("alphabet", ["ab cd  ", "abé c\u0085 　\x1c\t", "ab ñ\U0001F600 　"])
@pytest.mark.parametrize("slice_bytes, together", [(1 << 19, 4096), (300, 7)])
def test_measures_of_pairs(monkeypatch, alphabet, slice_bytes, together):
    monkeypatch.setattr(ngramcounts, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(pairparts, "TOGETHER", together)
    pairs = _pairs(alphabet)
    # the arrays begin inside their buffers
    pred, ref = pa.array(["x", *(a for a, _ in pairs)])[1:], pa.array(["y z", *(b for _, b in pairs)])[1:]
    got = batch_parts(pred, ref).to_pylist()
    assert [(p, g, _model(*p)) for p, g in zip(pairs, got, strict=True) if g != _model(*p)] == []
    assert len(batch_parts(pa.array([], pa.string()), pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("in_batches", [False, True])
def test_score_parts_with_and_without_batches(spark, in_batches):
    rows = [(1, "a  b, c", " a b c "), (2, None, "a b"), (3, "a", None), (4, "same text", "same text"), (5, "", "")]
    rows += [(i, a, b) for i, (a, b) in enumerate(_pairs("ab é1.,-'&_\t ")[:150], 6)]
    out = score_parts(spark.createDataFrame(rows, "i int, prediction string, text string"), in_batches=in_batches)
    assert set(out.columns[3:-1]) <= set(PART_COLUMNS)
    assert out.columns == ["i", "prediction", "text", "ed", "ed_norm", "ref_norm_len", "ref_words", "exact", "char_total", "word_match", "word_total", "pad_match", "trunc_match", "bleu_score"]
    assert [t for _, t in out.dtypes[3:]] == ["bigint"] * 4 + ["boolean"] + ["bigint"] * 5 + ["double"]
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert any(f in plan for f in ("regexp", "levenshtein", "zip_with", "split(")) is not in_batches and ("_batch_parts" in plan) is in_batches
    for row in out.collect():
        m = _model(row["prediction"], row["text"])
        assert {k: row[k] for k in m if k in out.columns} == {k: v for k, v in m.items() if k in out.columns}, row
        assert row["char_total"] == max((x for x in (m["pred_chars"], m["ref_chars"]) if x is not None), default=None)
        assert row["word_total"] == max((x for x in (m["pred_words"], m["ref_words"]) if x is not None), default=None)
        assert row["bleu_score"] == pytest.approx(models.bleu(row["prediction"] or "", row["text"] or ""), abs=1e-9)


def test_ocr_distances_beside_the_parts(spark):
    rows = [(" a  b", "a b", "a c"), ("a", None, "b "), (None, "a", "b"), ("a", "b", None)]
    out = score_parts(spark.createDataFrame(rows, "o string, p string, t string"), "p", "t", ocr="o", bleu=False).collect()
    want = [(None, None) if o is None or t is None else (_lev(o, t), _lev(models.norm(o), models.norm(t))) for o, _, t in rows]
    assert [(r["ocr_ed"], r["ocr_ed_norm"]) for r in out] == want


def test_metric_row_of_a_micro_batch(spark):
    rows = [(1, n, o, t) for n, (o, t) in enumerate([("a  b, c.", " a b c "), ("same", "same"), ("x y z", "x y q"), ("", "abc"), ("tbe cat", "the cat")])]
    batch = spark.createDataFrame(rows, "page_id int, line_number int, ocr_prediction string, text string")
    frame = metric_row(batch)
    row, parts = frame.first(), [(_model(o, t), models.bleu(o, t)) for _, _, o, t in rows]
    assert row["eval_samples"] == len(rows) and row["edit_distance"] == pytest.approx(sum(m["ed"] for m, _ in parts) / len(rows))
    assert row["cer"] == pytest.approx(sum(m["ed_norm"] for m, _ in parts) / sum(m["ref_norm_len"] for m, _ in parts))
    assert row["bleu"] == pytest.approx(sum(b for _, b in parts) / len(rows), abs=1e-12)
    plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "levenshtein" not in plan


def test_distances_of_texts(monkeypatch):
    monkeypatch.setattr(ngramcounts, "SLICE_BYTES", 500)
    pairs = _pairs("abé c ")
    got = text_distances(*(pa.array(["x", *side])[1:] for side in zip(*pairs, strict=True)))
    assert got.type == pa.int64() and got.to_pylist() == [_model(a, b)["ed"] for a, b in pairs]
    assert len(text_distances(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
