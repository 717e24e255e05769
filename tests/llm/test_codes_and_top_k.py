"""Vector codes (11), exact top-k (12) and ranked lexical search (13) against plain computations."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import CAPITALS, HARD_TEXTS, prose
from pyspark.sql import functions as F

from scriptorium.llm import exact_search, lexical_search, vector_codes

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<float>, label int{more}")


def clustered(n, width, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return (centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(ids, codes, errors, codebooks) by direct distances."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in rows]
    width = len(ints[0]) // parts
    cut = [[v[p * width: (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for v in cut:
                own[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for e, g in zip(books[p], own, strict=True)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [r[0] for r in rows], ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], books


def test_codes_equal_plain_k_means(spark):
    data = clustered(330, 8, 1, 0.4)
    rows = [(i, [float(x) for x in v], i % 3 if i % 5 else None) for i, v in enumerate(data)]
    rows += [(7, rows[7][1], 2), (7, rows[8][1], 2), (None, rows[9][1], None)]  # repeated row, repeated id, null id
    bad = [(900, None, 1), (901, [0.5] * 7 + [None], 1), (902, [NAN] * 8, 1), (903, [INF] * 8, 1), (904, [0.5] * 4, 1), (905, [], 1)]
    df = vectors(spark, rows + bad).repartition(5).select("*", F.lit("x").alias("code"), F.lit(1).alias("id"), F.lit(2).alias("of"), F.lit(0).alias("vec"))
    got = sorted(vector_codes.compress(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.code))
    ids, codes, errors, books = plain_codes(rows)
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter(zip(ids, codes, errors, strict=True))
    labels = Counter()
    for (_, _, label), error in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), errors, strict=True):
        labels[label] += error
    assert {r.label_error for r in got} == set(labels.values())
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_codes_of_few_rows_are_exact_and_decode(spark):
    rows = [(3, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.1, 0.2, 0.3, 0.4], None), (2, [-0.1, 0.0, 9.0, -7.5], None)]
    kept, length = vector_codes.kept_vectors(vectors(spark, rows), "vec_id", "embedding", label_col="label")
    books = vector_codes.fit_codebooks(kept, length)
    out = {r.id: r for r in vector_codes.encode(kept, books).collect()}
    assert length == 4 and books.shape == (4, 3, 1) and all(r.error == 0 for r in out.values())
    assert out[1].code == out[3].code == "00000000"  # equal rows: the tie goes to the lower entry
    assert vector_codes.decode(out[2].code, books).tolist() == [math.floor(1024 * float(np.float32(x))) for x in rows[2][1]]


def test_codes_of_an_empty_table_and_of_large_components(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(Exception, match="must stay below"):
        vector_codes.compress(vectors(spark, [(1, [1e9] * 4, 1)])).collect()


def test_dictionary_distances_are_the_distances():
    rng = np.random.default_rng(3)
    for reach in (50, 60_000_000):
        rows, book = rng.integers(-reach, reach, (70, 5)), rng.integers(-reach, reach, (9, 5))
        assert (vector_codes.part_distances(rows, book) == ((rows[:, None] - book[None]) ** 2).sum(2)).all()


def plain_top_k(rows, k=5, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(kept):
        if q is not None and q % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for n, (i, w) in enumerate(kept) if n != at)
            out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(hits[:k], 1)]
    return Counter(out)


def searched(df):
    return Counter(tuple(r) for r in exact_search.top_k(df, F.col("id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "GROUP", (60, 100))
    monkeypatch.setattr(exact_search, "QUERY_SLICE", 7)
    monkeypatch.setattr(exact_search, "BLOCK", 16)
    data = clustered(500, 8, 5, 0.2)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[50][1], 0) for i in range(300)]  # copies of a query's vector, six of them queries
    rows += [(100, rows[100][1], 0), (100, rows[7][1], 0), (150, rows[150][1], 0)]  # repeated rows, an id with two vectors
    rows += [(None, rows[0][1], 0), (2000, None, 0), (2050, [NAN] * 8, 0), (2001, [None] * 8, 0), (2100, [INF] * 8, 0), (2150, [], 0), (2200, [3.0], 0)]
    df = vectors(spark, rows).repartition(7).select("*", F.lit(0).alias("id"), F.lit(1).alias("score"), F.lit(2).alias("rank"), F.lit(3).alias("query"))
    assert searched(df) == plain_top_k(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_top_k_of_few_rows(spark, n):
    rows = [(50 * i, [0.5, -0.25], 0) for i in range(n)]
    assert searched(vectors(spark, rows)) == plain_top_k(rows)


def test_blocks_below_the_bound_are_not_scored():
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (16, 12))
    data = np.repeat(centres, 64, 0) + rng.integers(-5, 6, (1024, 12))
    index = exact_search.BlockIndex(data, np.arange(1024) // 64, np.arange(1024), np.arange(1025))
    queries = data[::100]
    number, score, ids = index.search(queries, np.full(len(queries), -(1 << 63)), 4)
    for q, v in enumerate(queries):
        hits = sorted(zip((-(data @ v)).tolist(), range(1024), strict=True))[:4]
        assert [(-s, i) for s, i in hits] == list(zip(score[number == q].tolist(), ids[number == q].tolist(), strict=True))
    assert index.scored < len(queries) * 16 / 2


@pytest.mark.parametrize("reach", [100, 1 << 20, 1 << 29])
def test_scores_are_exact_at_every_magnitude(reach):
    rng = np.random.default_rng(reach)
    data = rng.integers(-reach, reach, (60, 4))
    index = exact_search.BlockIndex(data, np.arange(60) // 8, np.arange(60), np.arange(61))
    number, score, ids = index.search(data[:5], np.full(5, -(1 << 63)), 6)
    for q in range(5):
        hits = sorted((-sum(int(a) * int(b) for a, b in zip(data[q], w, strict=True)), i) for i, w in enumerate(data))[:6]
        assert [(-s, i) for s, i in hits] == list(zip(score[number == q].tolist(), ids[number == q].tolist(), strict=True))
    with pytest.raises(OverflowError):
        exact_search.exact_kind(1 << 63)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(CAPITALS))


def plain_search(docs, items, k=10):
    counts = [(d, Counter(terms_of(t))) for d, t, *_ in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    texts, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked = set(terms_of(text))
        hits = []
        for d, c, n in counts:
            m = 10 + 90 * n * texts // total
            score = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                hits.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(hits)[:k], 1)]
    return Counter(out)


def corpus():
    texts = [prose(i, 5 + 7 * (i % 40)) for i in range(240)]
    texts[60:120] = [texts[60]] * 60  # copies: ties
    texts += [*HARD_TEXTS, "Ba TON\x00ba-ton 5x5 Ñandú ÑANDÚ ünï", "ba" * 3 + "\n" + "TON mi."]
    docs = [(i, t, "t", 1) for i, t in enumerate(texts)] + [(None, texts[3], "t", 1), (5, texts[5], "t", 1), (5, texts[9], "t", 1)]
    items = [(i, prose(i, 30)) for i in range(12)] + [(20, texts[60]), (21, None), (22, ""), (23, "?!"), (24, "nowhere"), (25, "Ñandú x x 日本語"), (26, "lorem"), (26, "ipsum"), (26, "ipsum"), (None, "ba ton")]
    return docs, items


@pytest.mark.parametrize("part_terms, shard", [(1 << 20, 1 << 16), (40, 50)])
def test_search_equals_brute_force(spark, monkeypatch, part_terms, shard):
    monkeypatch.setattr(lexical_search, "SHARD_TEXTS", shard)
    monkeypatch.setattr(lexical_search, "CHUNK_BYTES", 1 << 10)
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, terms string, n int").repartition(3)
    out = lexical_search.search(df, spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit(0)), part_terms=part_terms)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in out.collect()) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "ba")], "item_id bigint, text string")
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_accumulators_stop_and_survivors_stay_exact():
    rng = random.Random(4)
    n = 4000
    postings = [(d, 0, 1 + d % 9) for d in range(20)] + [(d, t, 1) for d in range(n) for t in (1, 2, 3) if rng.random() < 0.9 or d < 20]
    row, term, tf = (np.array(x, np.int64) for x in zip(*postings, strict=True))
    weights = np.array([9000, 300, 200, 100])
    norms = np.full(n, 100, np.int64)
    shard = lexical_search.Shard(np.arange(n), norms, row, term, tf, weights)
    score, ids = shard.search([0, 1, 2, 3], 10, 0)
    plain = np.zeros(n, np.int64)
    np.add.at(plain, row, weights[term] * (10**9 * tf // (1000 * tf + 800)))
    best = sorted((-s, i) for i, s in enumerate(plain.tolist()))[:10]
    assert [(-s, i) for s, i in best] == list(zip(score.tolist(), ids.tolist(), strict=True))
    assert shard.created == 20 and shard.skipped > 9000
    assert not shard.total.any() and not shard.held.any()
