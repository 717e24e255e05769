"""Vector code compression with per-dimension value dictionaries (operator 11).

Every component becomes the integer floor(scale * x).  A vector is cut into
equal consecutive parts, and each part is replaced by the number of the
nearest entry of that part's codebook.  Codebooks are fitted by rounds of
integer k-means.

Distances are never computed vector by vector.  For a slice of rows each
dimension has a dictionary of the distinct integers that occur in it; the
squared differences of every dictionary value to all codebook entries are
tabulated once, and the distance of a row's part to all entries is a gather
from these tables by the row's dictionary codes, added over the dimensions of
the part.  A slice has ``SLICE_ROWS`` rows, so a dictionary has at most as many
values and the tables stay in memory whatever the range of the data is.

Each round is one Spark job: tasks return sums and counts per (part, entry),
Spark adds them up, and ``parts * entries`` rows reach the driver.  What tasks
receive are the codebooks; both sizes are parameters, not data.

Semantics: rows whose vector is null, holds a null or non-finite component, or
has another length than the vector of the smallest kept id (or a length that is
no multiple of ``parts``) are dropped.  Rows with the same id are rows of their
own; for the first entries they are ordered by their components.  Null ids come
last there.  With fewer kept rows than entries the codebooks are that small.
Ties go to the lower entry; an entry without rows stays as it is.  An empty table
gives an empty result.  Components have to stay below 2**26 after scaling (an
error says so otherwise), which keeps all sums exact in 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SLICE_ROWS = 8192
LARGEST = 1 << 26
#: Totals of at most this many labels are sent to every task; more are joined by a merge join.
FEW_LABELS = 100_000


def usable(vec):
    """Whether a vector column is there and has only finite components."""
    x = F.transform(vec, lambda v: v.cast("double"))
    inf = F.lit(float("inf"))
    return vec.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))


def matrix(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """Scaled integers of a list column whose lists all have ``width`` finite values."""
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(values * scale)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"components must stay below {LARGEST} after scaling by {scale}")
    return scaled.astype(np.int64).reshape(-1, width)


def part_distances(rows: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared distance of every row's part (rows x width) to every entry (entries x width), by dictionary tables."""
    reach = (int(np.abs(rows).max(initial=0)) + int(np.abs(codebook).max(initial=0))) ** 2 * rows.shape[1]
    kind = np.int32 if reach < 1 << 31 else np.int64
    total = np.zeros((len(rows), len(codebook)), kind)
    for j in range(rows.shape[1]):
        values, codes = np.unique(rows[:, j], return_inverse=True)
        table = ((values[:, None] - codebook[None, :, j]) ** 2).astype(kind)
        total += table[codes]
    return total


def assign(rows: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every part (rows x parts, lowest index on ties) and the distances summed over the parts."""
    parts, _, width = codebooks.shape
    codes, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
    for p in range(parts):
        far = part_distances(rows[:, p * width: (p + 1) * width], codebooks[p])
        codes[:, p] = far.argmin(1)
        error += far[np.arange(len(rows)), codes[:, p]]
    return codes, error


def _slices(batches, place: int, width: int):
    """(rows, integers) of at most SLICE_ROWS rows each."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            rows = batch.slice(at, SLICE_ROWS)
            yield rows, matrix(rows.column(place), width)


def _partial_sums(shared):
    def run(batches):
        books = shared.value
        parts, entries, width = books.shape
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, rows in _slices(batches, 0, parts * width):
            codes, _ = assign(rows, books)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                for j in range(width):
                    # Sums of one slice stay below 2**39, so doubles hold them exactly.
                    sums[p, :, j] += np.bincount(codes[:, p], weights=rows[:, p * width + j], minlength=entries).astype(np.int64)
        p, e = np.nonzero(n)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()),
                               pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, parts: int = PARTS, label_col: str | None = None) -> tuple[DataFrame, int]:
    """(id, vec, label) of the rows that take part, and the vectors' length (0 if there are none)."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), label.alias("label")).where(usable(F.col("vec")))
    first = rows.where(F.size("vec") > 0).orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("n")).head()
    length = first.n if first and first.n % parts == 0 else 0
    return rows.where((F.size("vec") == length) & F.lit(length > 0)), length


def fit_codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x length / parts) of the vectors of :func:`kept_vectors`."""
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow()
    if not length or not seeds.num_rows:
        return np.zeros((parts, 0, max(1, length // parts)), np.int64)
    width = length // parts
    books = matrix(seeds.column(0).combine_chunks(), length).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        sums = (rows.select("vec").mapInArrow(_partial_sums(shared), "part int, entry int, n bigint, sums array<bigint>")
                .groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums")))
        for row in sums.collect():  # at most parts * entries rows
            books[row.part, row.entry] = np.array(row.sums, np.int64) // row.n
        shared.unpersist()
    return books


def _encoder(shared):
    def run(batches):
        books = shared.value
        for rows, values in _slices(batches, 1, books.shape[0] * books.shape[2]):
            codes, error = assign(values, books)
            digits = max(2, (books.shape[1] - 1).bit_length() + 3 >> 2)
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            yield pa.record_batch([rows.column(0), rows.column(2), pa.array(text, pa.string()), pa.array(error, pa.int64())],
                                  names=["id", "label", "code", "error"])
    return run


def encode(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every kept row: the parts' entries in hexadecimal digits and the summed squared distance."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"id {types['id']}, label {types['label']}, code string, error bigint"
    if not codebooks.shape[1]:
        return rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    return rows.mapInArrow(_encoder(rows.sparkSession.sparkContext.broadcast(codebooks)), schema)


def decode(code: str, codebooks: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    digits = len(code) // codebooks.shape[0]
    return np.concatenate([codebooks[p, int(code[p * digits: (p + 1) * digits], 16)] for p in range(codebooks.shape[0])])


def fingerprint(codebooks: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept row; null labels are one label."""
    rows, length = kept_vectors(df, id_col, vec_col, label_col=label_col)
    books = fit_codebooks(rows, length)
    coded = written(encode(rows, books), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    totals = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals.hint("merge")
    return (coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256")))


def _oracle_sql() -> str:
    """The same in DuckDB SQL, one step a round."""
    steps = ["""kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             """ints AS MATERIALIZED (SELECT r, (d - 1) // 16 AS p, (d - 1) % 16 AS j, CAST(floor(1024 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, generate_series(1, 64) AS g(d))""",
             "book0 AS MATERIALIZED (SELECT p, r AS e, j, x AS y FROM ints WHERE r < 256)"]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, p, min(far) AS far, arg_min(e, far * 256 + e) AS e FROM
  (SELECT r, i.p, e, sum((x - y) * (x - y)) AS far FROM ints i JOIN book{k} b ON i.p = b.p AND i.j = b.j GROUP BY r, i.p, e) GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(z, y) AS y FROM book{k} b LEFT JOIN
  (SELECT i.p, e, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS z FROM ints i JOIN near{k} n ON i.r = n.r AND i.p = n.p GROUP BY i.p, e, j) s
  ON b.p = s.p AND b.e = s.e AND b.j = s.j)""")
    last = ROUNDS
    steps.append(f"""coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM kept JOIN near{last} USING (r) GROUP BY r, vec_id, label)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{last}) AS codebooks_sha256
FROM coded"""


ORACLE_SQL = _oracle_sql()
