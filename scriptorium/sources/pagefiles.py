"""Pages packed into files with an offset index (SNK-1, SNK-2 without a folder per page).

``write_pages`` is a Spark data-source writer.  Each task appends the pages of
its partition to one file and keeps (page, part, offset, bytes, checksum) in an
index file beside it; what it hands the driver is a file name.  The commit
publishes a list of the names of the tasks that succeeded, and nothing that is
not listed exists for a reader, so attempts that fail, are repeated or run twice
leave nothing visible.  A second write replaces the list, and the pages with it.

Rows are range-partitioned by (page, order), so a page's rows lie in order, and
a page that is too large for one task is a sequence of parts.  ``read_pages``
joins the wanted ids with the index and reads only their byte ranges.

Files are reached through ``pyarrow.fs`` by the URI of the output folder: a
shared mount or an object store, never a machine's own disk on a cluster.
Pages with a NULL id are stored and are found by a NULL id; a NULL line is an
empty line; without rows there are no pages.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "scriptorium_pages"
MANIFEST = "_pages.json"
INDEX = pa.schema([("page", pa.string()), ("part", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                   ("bytes", pa.int64()), ("crc32", pa.int64())])
INDEX_ROWS = 50_000


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, path.rstrip("/")


@dataclass
class TaskFiles(WriterCommitMessage):
    """What one task leaves: the name its text and index files share; None without rows."""

    name: str | None


class PageWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskFiles:
        """Append the rows (page, line) of one partition; a page's rows must be neighbours."""
        from pyspark import TaskContext

        fs, root = _open(self.folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        text = index = None
        done: list[tuple] = []
        page, start, size, crc, open_page = None, 0, 0, 0, False

        def close_page():
            nonlocal done
            if open_page:
                done.append((page, TaskContext.get().partitionId(), f"{name}.txt", start, size, crc))

        def flush():
            nonlocal done
            if done:
                index.write_table(pa.table([pa.array(c, t.type) for c, t in zip(zip(*done), INDEX)], schema=INDEX))
                done = []

        for batch in iterator:
            if not batch.num_rows:
                continue
            if text is None:
                fs.create_dir(f"{root}/data", recursive=True)
                text = fs.open_output_stream(f"{root}/data/{name}.txt")
                index = pq.ParquetWriter(fs.open_output_stream(f"{root}/data/{name}.parquet"), INDEX)
            for row_page, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not open_page or row_page != page:
                    close_page()
                    page, start, size, crc, open_page = row_page, start + size, 0, 0, True
                    if len(done) >= INDEX_ROWS:
                        flush()
                data = ((line or "") + "\n").encode()
                text.write(data)
                size, crc = size + len(data), zlib.crc32(data, crc)
        if text is None:
            return TaskFiles(None)
        close_page()
        flush()
        index.close()
        text.close()
        return TaskFiles(name)

    def commit(self, messages: list) -> None:
        """Publish the names of the files of this write, in the order of their partitions."""
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)
        names = sorted(m.name for m in messages if m is not None and m.name)
        draft = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(names).encode())
        fs.move(draft, f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        """Remove the files of the tasks that did succeed."""
        fs, root = _open(self.folder)
        for m in messages:
            if m is not None and m.name:
                for suffix in ("txt", "parquet"):
                    fs.delete_file(f"{root}/data/{m.name}.{suffix}")


class PageSource(DataSource):
    """Write-only source ``scriptorium_pages`` over rows (page string, line string)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


def write_pages(rows: DataFrame, out: str, page: str, order: list[str], text: str) -> None:
    """Pack the lines ``text`` of ``rows``, in ``order`` within their ``page``, into files under ``out``."""
    rows.sparkSession.dataSource.register(PageSource)
    (rows.repartitionByRange(page, *order).sortWithinPartitions(page, *order)
     .select(F.col(page).cast("string").alias("page"), F.col(text).cast("string").alias("line"))
     .write.format(FORMAT).mode("overwrite").option("path", out).save())


def page_index(spark: SparkSession, out: str) -> DataFrame:
    """(page, part, file, offset, bytes, crc32) of every stored part; a page's parts are in order of ``part``."""
    fs, root = _open(out)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        names = json.loads(f.read())
    if not names:
        return spark.createDataFrame([], "page string, part bigint, file string, offset bigint, bytes bigint, crc32 bigint")
    return spark.read.parquet(*[f"{out.rstrip('/')}/data/{n}.parquet" for n in names])


def _ranges(folder: str):
    def run(batches):
        fs, root = _open(folder)
        name, stream = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    if stream is not None:
                        stream.close()
                    name, stream = row["file"], fs.open_input_file(f"{root}/data/{row['file']}")
                stream.seek(row["offset"])
                data = stream.read(row["bytes"])
                if zlib.crc32(data) != row["crc32"]:
                    raise ValueError(f"page {row['page']} in {name} is damaged")
                yield pa.RecordBatch.from_pylist([{"page": row["page"], "part": row["part"], "text": data.decode()}],
                                                 schema=pa.schema([("page", pa.string()), ("part", pa.int64()), ("text", pa.string())]))
        if stream is not None:
            stream.close()
    return run


def read_pages(spark: SparkSession, out: str, pages: DataFrame | None = None) -> DataFrame:
    """(page, part, text) of all stored pages, or of those whose ids are in the one column of ``pages``.

    Parts are read where they lie, by files and offsets; a page of several
    parts is their texts in order of ``part``.
    """
    wanted = page_index(spark, out)
    if pages is not None:
        ids = pages.select(F.col(pages.columns[0]).cast("string").alias("_id")).distinct()
        wanted = wanted.join(ids, wanted["page"].eqNullSafe(ids["_id"]), "left_semi")
    placed = wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_ranges(out), "page string, part bigint, text string")
