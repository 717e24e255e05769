"""Operators 3 and 10: byte-level BPE and token records."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import bpe, records
from scriptorium.llm.batches import utf8
from scriptorium.llm.pieces import PieceTokens, piece_starts

from helpers import COMPLEMENT, HARD_TEXTS, prose, table, thue_morse

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HF_PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks(PATH)


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "ab s'tremvld  \n\t é漢12½²#$!'’\U0001f600́ñ"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(library, ranks):
    import pyarrow as pa

    texts = random_texts(3000, 1) + [t or "" for t in HARD_TEXTS] + ["don't you've I'm he'd'll", "x'", "''s", " 's", "  \n x ", "<|endoftext|>", "a" * 300]
    data, off = utf8(pa.array(texts))
    ids, bounds = PieceTokens(ranks.encode)(data, off)
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode_ordinary(t), t[:50]


def test_one_tree_and_forest_agree(ranks):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdeth inong") for _ in range(rng.randrange(2, 64))) for _ in range(500)]
    by_one = [ranks.merge_one(p) for p in pieces]
    assert [x.tolist() for x in ranks.merge_forest(pieces, 64)] == by_one


def test_a_full_memory_changes_nothing(ranks):
    import pyarrow as pa

    texts = random_texts(400, 3)
    data, off = utf8(pa.array(texts))
    small, large = PieceTokens(ranks.encode, pieces=50), PieceTokens(ranks.encode)
    for _ in range(2):
        a, b = small(data, off), large(data, off)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_no_pieces_without_text():
    assert len(piece_starts(np.zeros(0, np.uint8), np.array([0, 0]))) == 0


def test_round_trip_of_hard_texts(spark, library):
    texts = HARD_TEXTS + ["same", "same"]
    got = {r.doc_id: r for r in bpe.round_trip(table(spark, texts, token_ids=["clash"] * len(texts)), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_decode_of_given_ids(spark, library):
    ids = spark.createDataFrame([(1, library.encode_ordinary("Hé there")), (2, []), (3, None)], "doc_id bigint, token_ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, PATH).collect()}
    assert got == {1: "Hé there".encode(), 2: b"", 3: b""}


def test_empty_tables(spark, tmp_path):
    empty = table(spark, [])
    assert bpe.round_trip(empty, PATH).count() == 0
    folder = f"file://{tmp_path}/records"
    assert records.write_records(empty, HF_PATH, folder).count() == 0
    assert records.scan_records(spark, folder).count() == 0


def expected_records(texts):
    tokenizer = Tokenizer.from_file(HF_PATH)
    tokenizer.encode_special_tokens = True
    start, out = 0, {}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    return out


def test_records_read_back(spark, tmp_path):
    texts = [prose(i, 200 + i) for i in range(60)] + HARD_TEXTS + random_texts(100, 4)
    want = expected_records(texts)
    folder = f"file://{tmp_path}/records"
    index = records.write_records(table(spark, texts).repartition(5), HF_PATH, folder, shard_bytes=20_000)
    assert index.select("shard").distinct().count() > 3
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.scan_records(spark, folder).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    shuffled = index.where("doc_id % 7 = 0").orderBy(F.xxhash64("doc_id"))
    assert {r.doc_id: r.token_ids for r in records.fetch_records(shuffled, folder).collect()} == {i: w[3] for i, w in want.items() if i % 7 == 0}


def test_a_damaged_shard_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    index = records.write_records(table(spark, [prose(i, 50) for i in range(5)]), HF_PATH, folder)
    shard = tmp_path / "records" / index.first().shard
    body = bytearray(shard.read_bytes())
    body[60] ^= 1
    shard.write_bytes(body)
    with pytest.raises(Exception, match="checksum"):
        records.scan_records(spark, folder).collect()


def test_repeated_and_null_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id bigint, text string")
    records.write_records(df, HF_PATH, folder)
    got = sorted(((r.doc_id is not None, r.start) for r in records.scan_records(spark, folder).collect()))
    assert got == [(False, 0), (True, 2), (True, 4), (True, 6)]


def test_letters_are_the_libraries_letters(library, ranks):
    import pyarrow as pa

    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0x20000, 0x110000, 997))
    texts = ["".join(f"a{chr(c)}1{chr(c)} " for c in points[k: k + 500]) for k in range(0, len(points), 500)]
    data, off = utf8(pa.array(texts))
    ids, bounds = PieceTokens(ranks.encode)(data, off)
    starts = piece_starts(data, off)
    tokenizer = Tokenizer.from_file(HF_PATH)
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode_ordinary(t), hex(points[500 * i])
    tokens, _ = records.worker_tokens(HF_PATH)
    ids, bounds = tokens(data, off)
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, hex(points[500 * i])
    assert len(starts) > len(points)


def test_words_that_defeat_polynomial_hashes(spark, library, tmp_path):
    words = [thue_morse(n) for n in (1024, 2048, 4096)]
    texts = [w.translate(COMPLEMENT) if k else w for w in words for k in (0, 1)]
    got = {r.doc_id: r for r in bpe.round_trip(table(spark, texts).coalesce(1), PATH).collect()}
    want = expected_records(texts)
    folder = f"file://{tmp_path}/records"
    index = records.write_records(table(spark, texts), HF_PATH, folder)
    read = {r.doc_id: r.token_ids for r in records.fetch_records(index, folder).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert read[i] == want[i][3]


def test_pieces_whose_hashes_agree_are_told_apart(ranks, library, monkeypatch):
    import pyarrow as pa
    from scriptorium.llm import pieces

    sound = pieces.span_hashes
    calls = []

    def weak(data, starts, ends, seed=0):
        calls.append(seed)
        return sound(data, starts, ends, seed) % np.uint64(7 if seed in (0, 1) else 1 << 63)

    monkeypatch.setattr(pieces, "span_hashes", weak)
    tokens = PieceTokens(ranks.encode)
    for seed in (5, 6):
        texts = random_texts(50, seed)
        data, off = utf8(pa.array(texts))
        ids, bounds = tokens(data, off)
        for i, t in enumerate(texts):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode_ordinary(t)
    assert 2 in calls
