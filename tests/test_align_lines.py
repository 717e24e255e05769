"""JOI-2 line alignment: candidates beyond the best so far are given up early, results stay those of the definition."""

import random
import string

import pytest

from models import lev
from scriptorium.operators.pairs import align_lines

OCR = "page_id long, line_number long, ocr_prediction string"
REF = "page_id long, line_number long, text string"


def _model(ocr, ref, band=2, threshold=16):
    out = []
    for page, n, o in ocr:
        near = [(abs(r - n), r, t) for p, r, t in ref if p == page and r is not None and n is not None and abs(r - n) <= band]
        if not near:
            continue
        known = [(lev(o, t), gap, r) for gap, r, t in near if o is not None and t is not None]
        unknown = [(gap, r) for gap, r, t in near if o is None or t is None]
        if unknown and (not known or min(known)[0] > threshold):
            out.append((page, n, min(unknown)[1], None))
        else:
            d, _, r = min(known)
            out.append((page, n, r, d))
    return sorted(out, key=repr)


def _lines():
    rnd = random.Random(7)
    text = lambda size: "".join(rnd.choices("abcdefgh ", k=size))
    ocr, ref = [], []
    for page in range(6):
        lines = [text(rnd.choice([1, 20, 48, 48, 48, 90])) for _ in range(150)]
        ref += [(page, i, t) for i, t in enumerate(lines) if page < 3 or i % 5]  # numbers with gaps from page 3 on
        for i in range(156):
            t = lines[min(max(i + rnd.choice([-3, -2, -1, 0, 0, 0, 1, 2]), 0), 149)]
            for _ in range(rnd.choice([0, 0, 3, 8, 9, 14, 17, 30])):
                at = rnd.randrange(len(t) + 1)
                t = t[:at] + rnd.choice(["", "x", "ñ", "yz"]) + t[at + 1:]
            ocr.append((page, i, t))
    ref += [(2, 10, "abc"), (2, 10, "abc"), (2, 12, lines_of(ref, 2, 11)), (4, 20, ""), (4, 21, None)]  # repeated numbers, gaps made up for
    ocr += [(2, 11, "abd"), (4, 20, None), (4, 22, ""), (4, 23, "q" * 30), (5, None, "abc"), (9, 0, "no such page")]
    return ocr, [*ref, (0, None, "abc")]


def lines_of(ref, page, n):
    return next(t for p, r, t in ref if p == page and r == n)


@pytest.mark.parametrize("band,threshold", [(2, 16), (0, 16), (3, 4)])
def test_alignment_is_that_of_the_definition(spark, band, threshold):
    ocr, ref = _lines()
    got = align_lines(spark.createDataFrame(ocr, OCR), spark.createDataFrame(ref, REF), band, threshold).collect()
    assert sorted(map(tuple, got), key=repr) == _model(ocr, ref, band, threshold)


def test_candidates_are_collected_once_and_compared_as_far_as_needed(spark):
    ocr, ref = spark.createDataFrame([(1, 0, string.ascii_lowercase)], OCR), spark.createDataFrame([(1, 0, string.ascii_lowercase)], REF)
    plan = align_lines(ocr, ref)._jdf.queryExecution().optimizedPlan().toString()
    # the band of each comparison comes from the best candidate so far, not from a constant
    assert "Some(cast(shiftright(" in plan and "Some(16)" not in plan
    filters = [line for line in plan.splitlines() if line.lstrip("+-: ").startswith("Filter ")]
    assert filters and not any("filter(" in line for line in filters)
