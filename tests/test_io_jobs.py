"""Readers, sinks and end-to-end jobs through temporary folders (SRC-1..8, SNK-1..9)."""

import json
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scriptorium.operators.pairs import MissingColumns
from scriptorium.plans import jobs
from scriptorium.sources import readers as R
from scriptorium.sources import sinks as K
from scriptorium.sources.pagefiles import read_pages


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _page(spark, out, page):
    parts = read_pages(spark, out, spark.createDataFrame([(page,)], "page string")).orderBy("part").collect()
    return "".join(r["text"] for r in parts)


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="scriptorium-test-")


def test_pair_csv_strings_and_na(spark, tmp):
    p = _write(f"{tmp}/pairs.csv", 'line_id;image_path;text;ocr_prediction;page_id;line_number\n'
               'a_1;img.png;12;"x;y";a;1\n'
               'a_2;img.png;NA;"multi\nline";a;2\n'
               'a_3;img.png;ok;N/A;a;3\n')
    df = R.read_pair_csv(spark, p)
    rows = {r["line_id"]: r for r in df.collect()}
    assert rows["a_1"]["text"] == "12" and rows["a_1"]["ocr_prediction"] == "x;y"
    assert rows["a_2"]["text"] is None and rows["a_2"]["ocr_prediction"] == "multi\nline"
    assert rows["a_3"]["ocr_prediction"] is None
    assert dict(df.dtypes)["line_number"] == "int"


def test_separator_sniffing(spark, tmp):
    assert R.sniff_separator("text;ocr_prediction") == ";"
    assert R.sniff_separator("ocr_prediction,text,x") == ","
    assert R.sniff_separator("text\tocr_prediction") == "\t"
    with pytest.raises(MissingColumns):
        R.sniff_separator("text|ocr_prediction")
    p = _write(f"{tmp}/t.tsv", "text\tocr_prediction\nab\tab\n")
    assert R.read_test_csv(spark, p).count() == 1


def test_missing_column_and_file(spark, tmp):
    p = _write(f"{tmp}/bad.csv", "line_id;text\n1;x\n")
    with pytest.raises(MissingColumns):
        R.read_pair_csv(spark, p)
    with pytest.raises(AnalysisException):
        R.read_pair_csv(spark, f"{tmp}/nope.csv")


def test_jsonl(spark, tmp):
    p = _write(f"{tmp}/s.jsonl", '{"input": "correct ocr: ab", "target": "ab", "line_id": "x"}\n'
               '{"input": "correct ocr: correct ocr: cd", "target": "cd"}\n')
    out = jobs.inference_eval_job(spark, p, f"{tmp}/inf").first()
    assert out["exact_match_accuracy"] == 1.0 and out["total_samples"] == 2
    res = spark.read.json(f"{tmp}/inf/results").orderBy("line_id").collect()
    assert [r["line_id"] for r in res] == ["sample_1", "x"]
    assert res[0]["original_ocr"] == "cd"          # prefix removed twice
    bad = _write(f"{tmp}/bad.jsonl", '{"input": "a", "target": "b"}\nnot json\n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, bad).collect()


def test_segmentation_lines_and_pages(spark, tmp):
    doc = {"lines": [
        {"boundary": [[10, 5], [30, 9], [20, 2]], "baseline": [[10, 8], [30, 8]], "bbox": [0, 0, 1, 1]},
        {"boundary": [], "bbox": [1, 2, 3, 4]},
        {"boundary": None},
        {"bbox": [5, 6, 7, 8]}]}
    os.makedirs(f"{tmp}/seg")
    _write(f"{tmp}/seg/page1.json", json.dumps(doc))
    seg = R.read_segmentation(spark, f"{tmp}/seg")
    from scriptorium.operators.pages import segmentation_lines
    lines = {r["line_number"]: r for r in segmentation_lines(seg).collect()}
    assert sorted(lines) == [1, 2, 4]                         # line 3 skipped, numbering keeps the gap
    assert tuple(lines[1]["bbox"]) == (10, 2, 30, 9)          # from the polygon
    assert tuple(lines[2]["bbox"]) == (1, 2, 3, 4)            # empty polygon -> given box
    assert lines[1]["text_direction"] == "horizontal-lr" and lines[1]["type"] == "baseline"
    rec = spark.createDataFrame([("page1", 1, "tbe"), ("page1", 2, "  "), ("page1", 4, "end")],
                                "page_id string, line_number int, ocr_text string")
    summary = jobs.page_job(spark, seg, rec, f"{tmp}/out").first()
    assert (summary["n_lines"], summary["text_length"]) == (3, 3 + 0 + 3 + 2)
    text = _page(spark, f"{tmp}/out/pages", "page1")
    assert text == "tbe\n\nend\n"
    report = _page(spark, f"{tmp}/out/reports", "page1")
    assert report.startswith("DETAILED OCR CORRECTION RESULTS") and "Line 4:" in report
    assert "Bounding Box: [10, 2, 30, 9]" in report


def test_conversion_job(spark, tmp):
    p = _write(f"{tmp}/in.csv", 'text,other\n"dñs, xpo",1\nplain,2\n,3\n')
    stats = jobs.conversion_job(spark, p).first()
    assert (stats["total_rows"], stats["changed_rows"]) == (3, 2)
    assert K.converted_path(p) == f"{tmp}/in_converted.csv"
    out = spark.read.option("header", True).csv(K.converted_path(p)).orderBy("other").collect()
    assert out[0]["text_converted"] == "dnns, cristo"


def test_evaluation_and_training_jobs(spark, tmp):
    rows = ["line_id;text;ocr_prediction;page_id;line_number"]
    for i in range(40):
        rows.append(f"p_{i};the cat sat {i};tbe cat sat {i};p{i // 10};{i % 10}")
    p = _write(f"{tmp}/pairs.csv", "\n".join(rows) + "\n")
    m = jobs.evaluation_job(spark, p, f"{tmp}/eval").first()
    assert m["total_samples"] == 40 and 0 < m["character_error_rate"] < 1
    assert m["samples_per_second"] is None                    # nothing was predicted
    saved = spark.read.json(f"{tmp}/eval/metrics").first()
    assert saved["evaluation_summary"]["test_data"] == p and saved["evaluation_summary"]["evaluation_date"]
    scores = spark.read.json(f"{tmp}/eval/row_scores").collect()
    assert sorted(r["sample_id"] for r in scores) == list(range(40)) and all(r["edit_distance"] == 1 for r in scores)
    assert sum(r["bleu_score"] for r in scores) / 40 == pytest.approx(m["bleu_score_mean"])
    assert spark.read.option("header", True).csv(f"{tmp}/eval/detailed_error_analysis").count() == 40
    assert "WORST CORRECTION CASES" in spark.read.text(f"{tmp}/eval/error_examples").first()[0]
    rep = {r["split"]: r["rows"] for r in jobs.training_table_job(spark, p, f"{tmp}/train").collect()}
    assert rep == {"train": 32, "validation": 4, "test": 4}
    t = spark.read.parquet(f"{tmp}/train/training_table")
    assert t.where("split = 'train'").select(F.max("idx")).first()[0] == 31


def test_input_without_keys_and_file_order(spark, tmp):
    """Two columns are enough, and rows are numbered and split in file order, not by their ids."""
    lines = [f"t {i};p {i}" for i in range(12)]
    p = _write(f"{tmp}/two.csv", "text;ocr_prediction\n" + "\n".join(lines) + "\n")
    assert jobs.evaluation_job(spark, p, f"{tmp}/eval2").first()["total_samples"] == 12
    rows = spark.read.option("header", True).csv(f"{tmp}/eval2/detailed_error_analysis").collect()
    assert {int(r["sample_id"]): r["ground_truth"] for r in rows} == {i: f"t {i}" for i in range(12)}
    assert K.read_metric_log(spark, f"{tmp}/eval2/metrics_log").first()["eval_samples"] == "12"
    p = _write(f"{tmp}/ids.csv", "line_id;text;ocr_prediction;page_id;line_number\n" + "".join(f"p_line_{i};t{i};o{i};p;{i}\n" for i in range(20)))
    jobs.training_table_job(spark, p, f"{tmp}/train2")
    from scriptorium.functions.tokens import decode_tokens
    t = spark.read.parquet(f"{tmp}/train2/training_table").select("idx", "split", decode_tokens("labels").alias("t")).collect()
    assert {r["idx"]: r["t"] for r in t} == {i: f"t{i}" for i in range(20)}
    assert {r["idx"] for r in t if r["split"] == "test"} == {18, 19}


def test_surplus_cells_raise(spark, tmp):
    p = _write(f"{tmp}/s.csv", "text;ocr_prediction\na;b\nc;d;EXTRA\n")
    with pytest.raises(Exception, match="EXTRA"):
        R.read_pair_csv(spark, p).collect()
    p = _write(f"{tmp}/few.csv", "text;ocr_prediction;x\na;b\n")
    assert R.read_pair_csv(spark, p, multi_line=False).select("text", "ocr_prediction", "x").first() == ("a", "b", None)


def test_corrector_in_jobs(spark, tmp):
    from scriptorium.operators.correct import BatchCorrector
    p = _write(f"{tmp}/c.csv", "text;ocr_prediction\nthe cat;tbe cat\nthe dog;tbe dog\n")
    fix = BatchCorrector(lambda: lambda texts: [t.replace("tbe", "the") + " " for t in texts])
    m = jobs.evaluation_job(spark, p, f"{tmp}/ce", fix, run="first").first()
    assert m["exact_matches"] == 2 and m["samples_per_second"] == pytest.approx(2 / m["evaluation_time_seconds"])
    jobs.evaluation_job(spark, p, f"{tmp}/ce", fix, run="first")
    assert K.read_metric_log(spark, f"{tmp}/ce/metrics_log").count() == 1


def test_metric_log_append(spark, tmp):
    row = spark.createDataFrame([("2024-01-01 00:00:00", 0.1, 0.5, 1.0, 10)],
                                "timestamp string, cer double, bleu double, edit_distance double, eval_samples long")
    K.append_metric_log(row, f"{tmp}/log")
    K.append_metric_log(row, f"{tmp}/log")
    assert K.read_metric_log(spark, f"{tmp}/log").count() == 2
    # A batch that is appended again replaces its row; the others and the header stay.
    for cer in (0.2, 0.3):
        K.append_metric_log(row.withColumn("cer", F.lit(cer)), f"{tmp}/log", "step/250 %")
    log = K.read_metric_log(spark, f"{tmp}/log").orderBy("cer").collect()
    assert [r["cer"] for r in log] == ["0.1", "0.1", "0.3"] and log[2]["batch"] == "step/250 %"
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{tmp}/log") for f in names if f.startswith("part-")]
    assert "".join(open(f).read() for f in files).count("edit_distance") == 1
    with pytest.raises(ValueError):
        K.append_metric_log(row.drop("bleu"), f"{tmp}/log")


def test_list_pages_base_names(spark, tmp):
    os.makedirs(f"{tmp}/imgs/sub.dir")
    for name in ("p1.png", "p2.x.png", "sub.dir/p3.tif"):
        _write(f"{tmp}/imgs/{name}", "x")
    pages = R.list_pages(spark, f"{tmp}/imgs", "*.png")
    assert sorted(r["base_name"] for r in pages.collect()) == ["p1", "p2.x"]
