"""Bit-parallel distances (SCA-1 on long texts) and page alignment that survives drift (JOI-2)."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.bitdistance import distances, long_distance, page_edit_distance
from scriptorium.operators.align import _Stretch, align_pages, align_texts, anchor_candidates, increasing_chain


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def noisy(text, rng, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 or at == len(out):
            out.insert(at, rng.choice("abñ😀 "))
        elif kind == 1:
            del out[at]
        else:
            out[at] = rng.choice("xyab")
    return "".join(out)


def test_distances_equal_the_plain_programme():
    rng = random.Random(2)
    left, right = [], []
    for _ in range(1200):
        left.append("".join(rng.choice("abñ😀") for _ in range(rng.choice([0, 1, 2, 30, 63, 64, 65, 128, 200]))))
        right.append(noisy(left[-1], rng, rng.choice([0, 1, 3, 20, 60])))
    assert distances(left, right).tolist() == [plain(a, b) for a, b in zip(left, right, strict=True)]


def test_long_texts_equal_levenshtein_and_are_several_times_as_fast(spark):
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh ñ") for _ in range(33_047))
    b = noisy(a, rng, 4000)
    df = spark.createDataFrame([(a, b)], "a string, b string").cache()
    df.count()

    def timed(column):
        began = time.time()
        value = df.select(column.alias("d")).first()["d"]
        return value, time.time() - began

    timed(page_edit_distance(F.substring("a", 1, 100), F.substring("b", 1, 100)))  # starts the worker
    want, slow = timed(F.levenshtein("a", "b"))
    got, fast = timed(page_edit_distance("a", "b"))
    assert got == want == long_distance(a, b) and fast * 3 < slow  # it was five times or more when measured


def test_distance_column_bears_nulls_and_empty_texts(spark):
    rows = [(None, "a"), ("a", None), (None, None), ("", ""), ("", "abc"), ("abc", ""), ("kitten", "sitting"), ("x" * 3000, "y")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", page_edit_distance("a", "b").alias("d")).collect()
    assert [r["d"] for r in got] == [None, None, None, 0, 3, 3, 3, 3000]


def full(a, b):
    """All cells of the alignment of two lists of lines, with the module's ties."""
    cost = {(0, 0): (0, 0)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                options = []
                if i and j and 2 * (apart := plain(a[i - 1], b[j - 1])) <= max(len(a[i - 1]), len(b[j - 1])):
                    options.append((cost[i - 1, j - 1][0] + apart, 1))
                if i:
                    options.append((cost[i - 1, j][0] + len(a[i - 1]) + 1, 2))
                if j:
                    options.append((cost[i, j - 1][0] + len(b[j - 1]) + 1, 3))
                cost[i, j] = min(options)
    out, i, j = [], len(a), len(b)
    while i or j:
        how = cost[i, j][1]
        i, j = i - (how in (1, 2)), j - (how in (1, 3))
        out.append((i if how != 3 else None, j if how != 2 else None, plain(a[i], b[j]) if how == 1 else len(a[i]) if how == 2 else len(b[j])))
    return out[::-1], cost[len(a), len(b)][0]


def price(triples):
    return sum(d + (i is None or j is None) for i, j, d in triples)


def page(rng, n):
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_alignment_equals_the_full_programme_with_twenty_dropped_lines(seed):
    rng = random.Random(seed)
    ref = page(rng, 70)
    ref[10:14] = [ref[9]] * 4  # repeated and blank lines have no grams of their own
    ref[30] = ref[31] = ""
    dropped = set(rng.sample(range(70), 20)) if seed else set(range(20, 40))
    ocr = [noisy(line, rng, len(line) // 10) for k, line in enumerate(ref) if k not in dropped]
    ocr.insert(25, "invented by the machine")
    [got] = align_texts([(ocr, ref)])
    want, cost = full(ocr, ref)
    assert got == want and price(got) == cost
    assert [i for i, _, _ in got if i is not None] == list(range(len(ocr))) and [j for _, j, _ in got if j is not None] == list(range(70))


def test_band_doubles_until_no_path_outside_can_be_cheaper():
    rng = random.Random(9)
    lines = ["".join(rng.choice("ab") for _ in range(3)) for _ in range(60)]  # too short for anchors
    ocr = lines[25:] + lines[:5]
    [got] = align_texts([(ocr, lines)])
    assert price(got) == full(ocr, lines)[1]
    stretch = _Stretch(ocr, lines, 0, 0)
    assert stretch.outside() < float("inf") and not anchor_candidates(ocr, lines)


def test_chain_is_the_longest_increasing():
    assert increasing_chain([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3), (5, 4)]) == [(1, 1), (2, 2), (4, 3), (5, 4)]
    assert increasing_chain([]) == []


def test_pages_in_spark(spark):
    rng = random.Random(3)
    pages = {p: page(rng, 30) for p in range(6)}
    ref = [(p, k, line, "x") for p, lines in pages.items() for k, line in enumerate(lines)]
    ocr = [(p, k, line, 1) for p, lines in pages.items() if p != 5 for k, line in enumerate(lines[:7] + lines[15:])]
    ocr += [(9, 0, None, 1), (9, 1, "alone", 1), (None, 0, "no page", 1)]
    o = spark.createDataFrame(ocr, "page_id bigint, line_number bigint, ocr_prediction string, o int").repartition(3)
    r = spark.createDataFrame([*ref, (None, 0, "no page", "x")], "page_id bigint, line_number bigint, text string, page string").repartition(3)
    got = Counter(tuple(x) for x in align_pages(o, r).collect())
    want = Counter((p, k if k < 7 else k - 8 if k >= 15 else None, k, 0 if k < 7 or k >= 15 else len(line))
                   for p, lines in pages.items() if p != 5 for k, line in enumerate(lines))
    want += Counter((5, None, k, len(line)) for k, line in enumerate(pages[5]))
    want += Counter([(9, 0, None, 0), (9, 1, None, 5)])
    assert got == want
    assert align_pages(o.limit(0), r.limit(0)).collect() == []


def test_bands_of_every_width_and_beyond(monkeypatch):
    from scriptorium.functions import bitdistance as B
    rng = random.Random(17)
    a, b = [], []
    for k in range(400):
        x = "".join(rng.choice("abñ😀") for _ in range(rng.choice([64, 65, 66, 127, 128, 129, 200, 300])))
        y = list(x)
        for _ in range(rng.randrange(0, 1 + k // 4)):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.randrange(2)] = rng.choice(["", "x", "ab", "　"])
        a.append(x)
        b.append("".join(y) if k % 9 else "".join(rng.choice("acd") for _ in range(rng.randrange(1, 400))))
    want = [B.long_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert want[:60] == [plain(x, y) for x, y in zip(a[:60], b[:60], strict=True)]
    monkeypatch.setattr(B, "FEW", 0)  # bands alone, but for distances beyond the reach of the widest
    assert B.distances(a, b).tolist() == want and max(want) > B.reach(4)
