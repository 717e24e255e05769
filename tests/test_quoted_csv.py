"""A CSV file read by several tasks equals the whole-file read, wherever its byte ranges end."""

import csv
import random

import pytest

from scriptorium.sources import quoted as Q
from scriptorium.sources import readers as R


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _file(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, delimiter=";", lineterminator=end, quoting=quoting)
        w.writerow(["text", "ocr_prediction", "n"])
        w.writerows(rows)
    return str(path)


def _rows(seed, n=300):
    rnd = random.Random(seed)
    pieces = ["a", "ü", " ", "\n", '"', '""', ";", "word ", "\n\n", "x" * 40, "'"]
    return [("t" + "".join(rnd.choices(pieces, k=rnd.randrange(12))), "".join(rnd.choices(pieces, k=rnd.randrange(30))) + "o", str(i))
            for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_ranges_equal_the_whole_file(small_ranges, tmp_path, seed):
    rows = _rows(seed)
    path = _file(tmp_path / "p.csv", rows)
    df = R.read_pair_csv(small_ranges, path, by_ranges=True)
    assert Q.range_states(small_ranges, path).count() > 10
    got = [(r["text"], r["ocr_prediction"], r["n"]) for r in df.orderBy(R.POSITION).collect()]
    assert got == rows                                                     # values and file order
    whole = R.read_pair_csv(small_ranges, path)
    assert [(r["text"], r["ocr_prediction"], r["n"]) for r in whole.orderBy(R.POSITION).collect()] == got


def test_a_cell_longer_than_many_ranges(small_ranges, tmp_path):
    rows = [("a", "b", "0"), ("".join(f"line {i}\n" for i in range(800)) + "end", 'say "x"\n', "1"), ("c", "d\n\n\ne", "2")]
    got = R.read_pair_csv(small_ranges, _file(tmp_path / "l.csv", rows), by_ranges=True)
    assert sorted((r["n"], r["text"], r["ocr_prediction"]) for r in got.collect()) == sorted((n, t, o) for t, o, n in rows)


def test_several_files_with_windows_line_ends(small_ranges, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(3):
        _file(tmp_path / "d" / f"{i}.csv", [(f"t{i}\r\nu", f"o{k}", str(k)) for k in range(60)], end="\r\n", quoting=csv.QUOTE_ALL)
    got = R.read_pair_csv(small_ranges, str(tmp_path / "d"), by_ranges=True)
    assert sorted((r["text"], r["n"]) for r in got.collect()) == sorted((f"t{i}\nu", str(k)) for i in range(3) for k in range(60))


def test_missing_cells_empty_lines_and_no_rows(small_ranges, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('text;ocr_prediction\n\na;NA\n\n\nb\n""; c \n', encoding="utf-8")
    got = R.read_pair_csv(small_ranges, str(path), by_ranges=True).orderBy(R.POSITION).collect()
    assert [(r["text"], r["ocr_prediction"]) for r in got] == [("a", None), ("b", None), (None, " c ")]
    path.write_text("text;ocr_prediction\n", encoding="utf-8")
    assert R.read_pair_csv(small_ranges, str(path), by_ranges=True).collect() == []


def test_bad_files_raise(small_ranges, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('text;ocr_prediction\na;"open\nb;c\n', encoding="utf-8")
    with pytest.raises(Exception, match="odd number of quotes"):
        R.read_pair_csv(small_ranges, str(path), by_ranges=True).collect()
    path.write_text("text;ocr_prediction\na;b;EXTRA\n", encoding="utf-8")
    with pytest.raises(Exception, match="EXTRA"):
        R.read_pair_csv(small_ranges, str(path), by_ranges=True).collect()
