"""Operators 1, 5 and 9: Jaccard join, decontamination, line dedup."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import decontaminate as dc
from scriptorium.llm import jaccard_join as jj
from scriptorium.llm import line_dedup as ld
from scriptorium.llm.batches import utf8
from scriptorium.llm.components import components
from scriptorium.llm.rtree import CountTree, enough, vector_lengths

from helpers import CAPITALS, COMPLEMENT, HARD_TEXTS, WORD, documents, prose, table, thue_morse


def shingles(text, k):
    words = WORD.findall((text or "").translate(CAPITALS))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute_links(texts, k, percent):
    """(n_shingles, component, links) per document, by comparing all that share a shingle."""
    sets, holders = [shingles(t, k) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root, links = list(range(len(sets))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i), links[i]) for i, s in enumerate(sets)]


def variants(seed, n):
    """Documents of many sizes with exact copies, near copies and a passage that many share."""
    rng, out = random.Random(seed), []
    passage = prose(999, 60)
    while len(out) < n:
        base = prose(rng.randrange(10**6), rng.choice([1, 2, 3, 4, 7, 20, 60, 150, 700])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = base[:]
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["swap", "other", prose(rng.randrange(99), 1)])
            text = " ".join(words)
            out.append(rng.choice([text, text, text.upper(), passage + "\n" + text]))
    rng.shuffle(out)
    return out[:n]


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (2, 50)])
def test_links_equal_brute_force(spark, words, percent):
    texts = variants(words, 400) + HARD_TEXTS
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jj.link_documents(documents(spark, texts).repartition(6), words, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts, words, percent)


def test_large_blocks_and_tiles_are_cut_without_loss(spark, monkeypatch):
    """Cut sizes are for memory only: with tiny ones the rows are the same."""
    monkeypatch.setattr(jj, "BLOCK", 8)
    monkeypatch.setattr(jj, "TILE", 5)
    base = prose(5, 120).split()
    texts = []
    for i in range(60):
        words = base[:]
        words[i] = f"own{i}"
        words[(i * 7) % 120] = f"more{i}"
        texts.append(" ".join(words))
    texts += [texts[0]] * 20
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jj.link_documents(table(spark, texts), 4, 85).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts, 4, 85)


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "x y z u v"), (3, "x y z u v"), (None, None), (9, "only one")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jj.link_documents(df, 4, 85).collect())
    assert got == [("3", 2, "3", 1), ("7", 2, "3", 1), ("7", 2, "7", 1), ("9", 1, "9", 0), ("None", 0, "None", 0), ("None", 2, "7", 1)]
    assert jj.link_documents(df.limit(0), 4, 85).count() == 0


def test_rows_without_ids_link_like_any_other(spark):
    words = [f"w{i}" for i in range(100)]
    one = words[:20] + ["x"] + words[21:]
    two = one[:70] + ["y"] + one[71:]
    texts = [" ".join(t) for t in (words, one, two)]
    assert brute_links([texts[0], texts[2]], 4, 85)[0][2] == 0   # only the middle one connects the two
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(5, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (None, other), (None, other + " z")]
    got = sorted((str(r.doc_id), str(r.component_id), r.n_links) for r in
                 jj.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 4, 85).collect())
    assert got == sorted([("5", "3", 2), ("None", "3", 3), ("None", "3", 3), ("3", "3", 2), ("None", "None", 1), ("None", "None", 1)])


def test_tree_finds_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(20, 1500)))
        for _ in range(int(rng.integers(1, 8))):
            keep = base[rng.random(len(base)) > 0.03]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 2**63, len(base) - len(keep))))))
    sizes = np.array([len(s) for s in sets])
    vectors = [np.bincount(s % n, minlength=n) for s, n in zip(sets, vector_lengths(sizes))]
    root = CountTree(vectors, sizes).connect(85)
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if enough(common, sizes[i] + sizes[j], 85):
                assert root[i] == root[j]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def semi_global(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force():
    rng = random.Random(3)
    letters = "abcdef gh"
    words = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, words(rng.choice([24, 30, 50, 64, 70, 90]))) for i in range(6)]
    texts = []
    for _ in range(80):
        changed = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(changed))
            what = rng.random()
            if what < 0.4:
                changed[k] = rng.choice(letters)
            elif what < 0.7:
                changed.insert(k, rng.choice(letters))
            elif len(changed) > 1:
                changed.pop(k)
        texts.append(words(rng.randrange(40)) + "".join(changed) + words(rng.randrange(40)))
    got = {(r, i) for r, i, *_ in dc.ItemIndex.build(items).matches(*utf8(pa.array(texts)))}
    want = set()
    for r, text in enumerate(texts):
        for i, item in items:
            size = min(len(item), dc.WINDOW)
            if any(semi_global(item[a:a + size], text) <= dc.edit_budget(size) for a in range(len(item) - size + 1)):
                want.add((r, i))
    assert got == want and len(want) > 20


def test_fragments_from_the_inside_of_long_items():
    rng = random.Random(11)
    letters = "abcdefghij klm"
    words = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, words(130)) for i in range(2)]
    texts = []
    for _ in range(30):
        item = rng.choice(items)[1]
        a = rng.randrange(0, 65)
        part = list(item[a: a + rng.randrange(60, 75)])
        for _ in range(rng.randrange(0, 8)):  # near the ends above all, where no q-gram is left to begin a window
            k = rng.choice([rng.randrange(12), len(part) - 1 - rng.randrange(12)])
            part[k: k + 1] = rng.choice([["z"], [], [part[k], "z"]])
        texts.append(words(rng.randrange(30)) + "".join(part) + words(rng.randrange(30)))
    item = items[0][1]
    by_hand = list(item[34:98])
    by_hand[7], by_hand[56] = "z", "z"
    texts.append("start " + "".join(by_hand) + " end")
    got = {(r, i) for r, i, *_ in dc.ItemIndex.build(items).matches(*utf8(pa.array(texts)))}
    want = {(r, i) for r, text in enumerate(texts) for i, item in items
            if any(semi_global(item[a:a + dc.WINDOW], text) <= dc.EDITS for a in range(len(item) - dc.WINDOW + 1))}
    assert got == want and (len(texts) - 1, 0) in got and 5 < len(want) < len(texts)


def test_short_items_are_found_as_whole_words():
    items = [(1, "Tiny Item"), (2, "x"), (3, "tiny\titem"), (4, "   "), (5, "c++"), (6, prose(3, 20))]
    texts = ["a tiny item.", "tiny items", "TINY\nITEM", "", "x", "axe x-ray", "in c++ only", "ñx xñ", "c++x"]
    got = {(r, dc.ItemIndex.build(items).ids[i]): span for r, i, *span in dc.ItemIndex.build(items).matches(*utf8(pa.array(texts)))}
    assert set(got) == {(0, 1), (0, 3), (2, 1), (2, 3), (4, 2), (5, 2), (6, 5), (8, 2), (8, 5)} and got[0, 1] == [2, 11, 0]
    assert {r for r, *_ in dc.ItemIndex.build(items[:2]).matches(*utf8(pa.array(texts)))} == {0, 2, 4, 5, 8}
    assert dc.ItemIndex.build([(1, ""), (2, "  ")]) is None


def test_decontamination_of_tables(spark, monkeypatch):
    items = [prose(i, 30) for i in range(5)]
    benchmark = spark.createDataFrame([*enumerate(items), (5, None), (6, ""), (7, "tiny"), (8, items[0])], "item_id bigint, text string")
    texts = [prose(50, 100) + " " + items[2] + " " + prose(51, 100), items[0].upper().replace(" ", "\n"), prose(52, 300), *HARD_TEXTS, items[2]]
    docs = documents(spark, texts)
    found = {(r.doc_id, r.item_id): (r.start, r.end, r.edits) for r in dc.find_matches(docs, benchmark).collect()}
    assert set(found) == {(0, 2), (1, 0), (1, 8), (len(texts) - 1, 2)}  # "tiny" stands nowhere
    start, end, edits = found[0, 2]
    at = len(prose(50, 100)) + 1
    assert abs(start - at) < 8 and abs(end - at - len(items[2])) < 8 and edits == 0
    clean = dc.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {0, 1, len(texts) - 1}
    assert dc.keep_clean(docs, benchmark.limit(0)).count() == len(texts)
    assert dc.find_matches(docs, benchmark.limit(0)).count() == 0 and dc.find_matches(docs.limit(0), benchmark).count() == 0
    monkeypatch.setattr(dc, "PART_BYTES", 200)
    parts = dc.item_parts(benchmark, part_bytes=200)
    assert len(parts) > 1 and sum(len(p.ids) for p in parts) == 7


def test_sets_that_defeat_polynomial_hashes_are_told_apart(spark):
    word = thue_morse(2048)
    texts = [f"{word} b c d", f"{word.translate(COMPLEMENT)} b c d", f"{word} b c d"]
    got = {r.doc_id: r.component_id for r in jj.link_documents(table(spark, texts), 4, 85).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_one_row_of_each_component_stays(spark):
    text = prose(1, 60)
    rows = [(1, text), (2, text), (2, prose(2, 60)), (3, prose(3, 60)), (3, prose(3, 60)), (None, prose(4, 60)), (None, prose(4, 60)), (None, prose(5, 60)), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, _row string").coalesce(1)
    out = jj.keep_one_of_each(df)
    got = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    assert out.columns == df.columns
    assert got == sorted([("1", text), ("2", prose(2, 60)), ("3", prose(3, 60)), ("None", prose(4, 60)), ("None", prose(5, 60)), ("4", ""), ("4", ""), ("5", "")])
    assert jj.keep_one_of_each(df.limit(0)).count() == 0


def plain_line_dedup(rows, ratio, least):
    pages, holders = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        if text is not None:
            pages[host].add(text)
            for line in text.split("\n"):
                if line.strip(" "):
                    holders[host, line.strip(" ")].add(text)
    gone = {k for k, v in holders.items() if len(v) >= least and len(v) > ratio * len(pages[k[0]])}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in gone) for i, t, h in rows}


def test_line_dedup_equals_plain(spark):
    rng = random.Random(4)
    lines = [prose(i, 6) for i in range(40)] + ["", "  ", "MENU", " MENU "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 8))) + ("\nCookies?" if i % 3 else ""), rng.choice(["a", "b", None])) for i in range(150)]
    rows += [(200 + i, "same page\nover and over", "a") for i in range(60)] + [(300 + i, t, "c") for i, t in enumerate(HARD_TEXTS)]
    names = ("line", "_id", "_own", "_gone", "_line", "_host", "hash")
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = ld.drop_boilerplate(df, ratio=0.2, least_pages=5)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == plain_line_dedup(rows, 0.2, 5)
    assert got[200] == "same page\nover and over" and "Cookies?" not in (got[1] or "")
    assert ld.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_drops_lines_shared_by_unrelated_documents(spark):
    shared = {"Read our newsletter every week.": 60, "All prices include tax.": 14, "Back to the top of the page.": 6, "A rare coincidence of words.": 4}
    rows = [(i, "\n".join([prose(i, 12), *(line for line, n in shared.items() if i % (500 // n) == 0 and i // (500 // n) < n), prose(1000 + i, 12)]), "big") for i in range(500)]
    rows += [(2000 + i, f"{prose(2000 + i, 12)}" + ("\nMENU" if i < 4 else "") + ("\nHOME" if i < 5 else ""), "small") for i in range(20)]
    rows += [(5000 + i, f"own {i}" + ("\nrare" if i < 10 else "") + ("\ncommon" if i < 11 else ""), "huge") for i in range(2000)]
    out = {r.doc_id: r.text for r in ld.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    left = "\n".join(out.values()).split("\n")
    assert {line: left.count(line) for line in shared} == {**dict.fromkeys(shared, 0), "A rare coincidence of words.": 4}
    assert (left.count("MENU"), left.count("HOME")) == (4, 0)  # fewer than LEAST_PAGES pages of a small host are no boilerplate
    assert (left.count("rare"), left.count("common")) == (10, 0)  # the ratio of a large host
    assert all(prose(i, 12) in out[i] for i in range(500))


def test_line_dedup_of_repeated_and_null_ids(spark):
    rows = [(None, f"top\nown {i}", "h") for i in range(10)] + [(1, "top\nx", "h"), (1, "top\nx", "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(r.text for r in ld.drop_boilerplate(df, ratio=0.5).collect())
    assert got == sorted([f"own {i}" for i in range(10)] + ["x", "top\nx"])
