"""Token-id records in length-delimited binary files with an offset index (operator 10).

File format (all integers little-endian).  A shard begins with the 8 bytes
``MAGIC`` and one byte giving the width of an id in bytes (2 if the vocabulary
has at most 65,536 ids, else 4), then holds records one after the other:

    u64 length | u32 masked crc32 of the length | payload | u32 masked crc32 of the payload

The payload is the document id (i64; i64 minimum for null) and the ids.  The
mask rotates a checksum and adds a constant, so that checksums of data that
hold checksums stay useful.  Shards are numbered in ascending document order.
The index is a Parquet table (doc_id, shard, offset, length, n_tokens) that
Spark's own committer publishes; shards of failed attempts have other names
and are in no index.

Semantics: null and empty texts give a record of the end id alone; rows with
the same id are kept, ordered by text; null ids come first; an empty table
gives an empty index and no records.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import text_slices
from .pieces import PieceTokens

MAGIC = b"TOKREC1\n"
SHARD_BYTES = 64 << 20
NULL_ID = -(1 << 63)
INDEX_SCHEMA = "doc_id bigint, shard string, offset bigint, length bigint, n_tokens bigint"


class CorruptRecord(ValueError):
    """A length or checksum that does not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end of the shard."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise CorruptRecord("length does not match its checksum")
    size = struct.unpack("<Q", head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise CorruptRecord("payload does not match its checksum")
    return body[:size]


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by URI or by plain path."""
    return pafs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (pafs.LocalFileSystem(), folder)


@lru_cache(maxsize=2)
def worker_tokens(path: str) -> tuple[PieceTokens, int]:
    """The tokenizers library behind a memory of the pieces met so far; and the vocabulary's size.

    The pre-tokenizer's pieces do not depend on what stands around them, so
    each distinct piece goes through the library once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # a special token's text is ordinary text

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    return PieceTokens(encode), tokenizer.get_vocab_size()


def _writer(path: str, folder: str, end_id: int, shard_bytes: int):
    def run(batches):
        tokens, vocabulary = worker_tokens(path)
        width = 2 if vocabulary <= 1 << 16 else 4
        fs, root = file_system(folder)
        task, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        stream, at, shard = None, 0, ""
        try:
            for rows, data, off in text_slices(batches):
                ids, bounds = tokens(data, off)
                small = ids.astype("<u2" if width == 2 else "<u4")
                index = []
                for doc, lo, hi in zip(rows.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    if stream is None or at >= shard_bytes:
                        if stream is not None:
                            stream.close()
                        shard = f"{task:08d}-{number:06d}-{attempt}.rec"
                        number += 1
                        stream = fs.open_output_stream(f"{root}/{shard}", buffer_size=1 << 20)
                        stream.write(MAGIC + bytes([width]))
                        at = len(MAGIC) + 1
                    payload = struct.pack("<q", NULL_ID if doc is None else doc) + small[lo:hi].tobytes() + int(end_id).to_bytes(width, "little")
                    stream.write(record := frame(payload))
                    index.append((doc, shard, at, len(record), int(hi - lo) + 1))
                    at += len(record)
                columns = list(zip(*index, strict=True))
                yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1]), *(pa.array(c, pa.int64()) for c in columns[2:])],
                                      names=["doc_id", "shard", "offset", "length", "n_tokens"])
        finally:
            if stream is not None:
                stream.close()
    return run


def write_records(df: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every row's ids to ``folder`` in ascending id order; returns the index, read from ``folder/index``."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    ordered = (df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(_writer(path, folder, end_id, shard_bytes), INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return df.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _ids(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    doc = struct.unpack_from("<q", payload)[0]
    return (None if doc == NULL_ID else doc), np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=8).astype("<u4")


def _open(fs: pafs.FileSystem, name: str):
    """A reader placed after the shard's header, and the width of its ids."""
    stream = fs.open_input_stream(name, buffer_size=1 << 20)
    head = stream.read(len(MAGIC) + 1)
    if head[:-1] != MAGIC:
        raise CorruptRecord(f"{name} is not a record shard")
    return stream, head[-1]


def _scan(folder: str):
    def run(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for shard, start, count in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                stream, width = _open(fs, f"{root}/{shard}")
                rows, seen = [], 0
                with stream:
                    while (payload := read_frame(stream)) is not None:
                        doc, ids = _ids(payload, width)
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start, seen = start + len(ids), seen + 1
                        if len(rows) >= 10_000:
                            yield _digest_batch(rows)
                            rows = []
                if seen != count:
                    raise CorruptRecord(f"{shard} holds {seen} records, its index {count}")
                if rows:
                    yield _digest_batch(rows)
    return run


def _digest_batch(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the shards in file order.

    ``start`` counts the ids of all documents before it.  The running total
    over shards is a window over one row per shard; a shard is read by one
    task, record by record.
    """
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("records"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), "records")
    n = index.select("shard").distinct().count()
    return starts.repartition(max(1, n)).mapInArrow(_scan(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _fetch(folder: str):
    def run(batches):
        fs, root = file_system(folder)
        opened: dict = {}
        try:
            for batch in batches:
                rows = []
                for shard, offset in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                    if shard not in opened:
                        if len(opened) >= 32:
                            opened.pop(next(iter(opened)))[0].close()
                        opened[shard] = (fs.open_input_file(f"{root}/{shard}"), _open(fs, f"{root}/{shard}")[1])
                    file, width = opened[shard]
                    file.seek(offset)
                    doc, ids = _ids(read_frame(file), width)
                    rows.append((doc, ids))
                if rows:
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int32()))],
                                          names=["doc_id", "token_ids"])
        finally:
            for file, _ in opened.values():
                file.close()
    return run


def fetch_records(index: DataFrame, folder: str) -> DataFrame:
    """Shuffled reads: (doc_id, token_ids) of the index rows given, in whatever order and selection they come."""
    return index.select("shard", "offset").mapInArrow(_fetch(folder), "doc_id bigint, token_ids array<int>")
