"""N-gram Jaccard self-join by R-trees over count vectors (operator 1).

A document's set is its distinct word shingles; two documents link when their
sets' Jaccard similarity is at least ``percent`` / 100.  Steps:

1. Shingles on more than ``COMMON`` of the documents are listed (each chunk of
   documents names those that are that common in it, three times at least; one
   that is as common in the whole corpus is so in some chunk).  The list only
   orders shingles, rare ones first; results do not depend on it.
2. Each document becomes a set key, a size, a count vector over hashed
   groups, and its first ``size - ceil(percent * size / 100) + 1``
   shingles: linked sets share one of these at least.  Equal sets are one
   class from here on.
3. Classes that share such a shingle form a block.  In a block an R-tree over
   the count vectors finds the pairs whose overlap, bounded by summed
   coordinate minima, allows a link.  Only a spanning forest of them leaves
   the task.  A block of more than ``BLOCK`` classes is cut by hash, and every
   two of its parts meet in a task.  Block sizes come from a pre-aggregated
   count, so no key's rows meet in one task.
4. The forests' components are clusters: every link lies in one.  Exact
   overlaps are computed inside clusters, from the shingles themselves; large
   clusters are cut into tiles like large blocks.
5. Components of the links, with the smallest document id of each.

No pair leaves a task: blocks and tiles give forests and counts, so a group of
k copies or near copies costs k rows.

Semantics: words are separated by space and 0x09-0x0D, A-Z is lower-cased;
texts with fewer words than a shingle have their whole sequence as the one
shingle; null texts and texts without words have no set and link with nothing.
Rows with the same id count as documents of their own; rows with a null id are
kept, count as copies and link like any other, and lend no id: a component of
such rows alone has a null id.  Other columns are ignored.  Sets and shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import LOWER, mix, row_sums, rows_of, span_hashes, text_slices, word_spans
from .components import components
from .rtree import CountTree, Forest, enough, vector_lengths
from .storage import unused, written
from .wordstats import windows

#: Share of documents from which a shingle is common, and shingles per chunk when counting them.
COMMON, CHUNK = 1e-3, 2_000_000
#: Classes of a block that stay together in one task, and of a tile.
BLOCK, TILE = 2048, 1024

_FEATURES = "doc_id bigint, unnamed bigint, n bigint, cls bigint, counts binary, prefix array<bigint>"


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in ascending order, and the rows' bounds."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, off)
    hashes = span_hashes(data, starts, ends)
    count = np.diff(bounds)
    joined, first = windows(hashes, bounds, words)
    row = rows_of(bounds)[first]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            more = count[short] > k
            whole[more] = mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[bounds[short[more]] + k])
        joined, row = np.concatenate((joined, whole)), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        joined, row = joined[order], row[order]
    limits = np.searchsorted(row, np.arange(len(off)))
    for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        joined[lo:hi].sort()
    new = np.ones(len(joined), bool)
    new[1:] = (joined[1:] != joined[:-1]) | (row[1:] != row[:-1])
    return joined[new], np.concatenate(([0], np.cumsum(new)))[limits]


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each row's set, as signed integers."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)))))
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _common(words: int, text_col: str):
    def run(batches):
        held: list[np.ndarray] = []
        documents = size = 0

        def emit():
            shingles, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= max(3, COMMON * documents)
            return pa.record_batch([pa.array(shingles[often].view(np.int64)), pa.array(count[often].astype(np.int64)), pa.array(np.zeros(int(often.sum()), np.int64))],
                                   names=["shingle", "n", "documents"])

        total = 0
        for rows, data, off in text_slices(batches, text_col):
            sets, _ = shingle_sets(data, off, words)
            held.append(sets)
            documents, size, total = documents + len(rows), size + len(sets), total + len(rows)
            if size >= CHUNK:
                yield emit()
                held, documents, size = [], 0, 0
        if held:
            yield emit()
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["shingle", "n", "documents"])
    return run


def common_shingles(df: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in ascending order and a level for each, higher for commoner ones.

    At most (shingles per document) / COMMON of them can exist, whatever the
    number of documents.
    """
    counted = (df.select(text_col).mapInArrow(_common(words, text_col), "shingle bigint, n bigint, documents bigint")
               .groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
    counted = written(counted, "common-shingles")
    documents = counted.where("shingle IS NULL").agg(F.sum("documents")).first()[0] or 0
    rows = [(r.shingle, r.n) for r in counted.where((F.col("shingle").isNotNull()) & (F.col("n") >= COMMON * documents)).toLocalIterator()]
    shingles = np.array([s for s, _ in rows], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], 1 + np.log2(np.array([n for _, n in rows], float)[order]).astype(np.int64) if rows else np.zeros(0, np.int64)


def _prefixes(sets: np.ndarray, bounds: np.ndarray, size: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first ``size`` shingles of each row: rare ones first, then by hash."""
    if len(common) and len(sets):
        place = np.minimum(np.searchsorted(common, sets), len(common) - 1)
        rank = np.where(common[place] == sets, level[place], 0)
        rows = np.flatnonzero(row_sums(rank > 0, bounds))
        if len(rows):
            sets = sets.copy()
            for r in rows.tolist():
                lo, hi = bounds[r], bounds[r + 1]
                sets[lo:hi] = sets[lo:hi][np.argsort(rank[lo:hi], kind="stable")]
    before = np.cumsum(size) - size
    return sets[np.arange(int(size.sum())) + np.repeat(bounds[:-1] - before, size)]


def _features(words: int, percent: int, shared, id_col: str, text_col: str):
    def run(batches):
        common, level = shared.value
        for rows, data, off in text_slices(batches, text_col):
            sets, bounds = shingle_sets(data, off, words)
            n = np.diff(bounds)
            length = vector_lengths(n)
            at = np.concatenate(([0], np.cumsum(length)))
            row = rows_of(bounds)
            counts = np.bincount(at[row] + (sets & (length - 1).astype(np.uint64)[row]).astype(np.int64), minlength=at[-1]).astype("<u2")
            # A set can only link with another one if it and one token more are similar enough.
            size = np.where(100 * n >= percent * (n + 1), n - (percent * n + 99) // 100 + 1, 0)
            prefix = _prefixes(sets, bounds, size, common, level).view(np.int64)
            yield pa.record_batch([
                rows.column(rows.schema.get_field_index(id_col)).cast(pa.int64()), rows.column(rows.schema.get_field_index("unnamed")), pa.array(n), pa.array(set_keys(sets, bounds)),
                pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * at).astype(np.int32).tobytes()), pa.py_buffer(counts.tobytes())]),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(prefix)),
            ], names=["doc_id", "unnamed", "n", "cls", "counts", "prefix"])
    return run


def groups(batches, key: str):
    """Complete groups of rows with equal ``key`` from batches sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not len(table):
            continue
        keys = table.column(key).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        table = table.combine_chunks()
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield table.slice(lo, hi - lo)
        rest = table.slice(int(cuts[-1]))
    if rest is not None:
        yield rest


def _forests(percent: int):
    """Sorted rows (task, cls, n, counts) -> forest edges (a, b) of the pairs that the count vectors allow."""
    def run(batches):
        a, b = [], []
        for group in groups(batches, "task"):
            cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)
            if len(cls) > 1:
                sizes = group.column("n").to_numpy()[first]
                counts = group.column("counts")
                root = CountTree([np.frombuffer(counts[i].as_py(), "<u2").astype(np.int64) for i in first.tolist()], sizes).connect(percent)
                linked = np.flatnonzero(root != np.arange(len(cls)))
                a.extend(cls[linked].tolist())
                b.extend(cls[root[linked]].tolist())
            if len(a) >= 10_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)
    return run


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning forests, block by block, of the pairs of classes that may link."""
    postings = classes.select("cls", F.explode("prefix").alias("key"))
    # Size and members' checksum of each block, pre-aggregated; blocks with the same members are one block.
    blocks = (postings.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
              .where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key", "c"))
    members = postings.join(blocks, "key").select("key", "cls", _parts("c", BLOCK // 2, BLOCK).alias("parts"))
    points = classes.select("cls", "n", "counts")
    return (members.withColumn("part", _part("cls", "parts")).withColumn("other", _others("parts"))
            .select(_task("key", "part", "other"), "cls").join(points, "cls").repartition("task").sortWithinPartitions("task")
            .mapInArrow(_forests(percent), "a bigint, b bigint"))


def _parts(count: str, size: int, whole: int) -> Column:
    """Number of parts of about ``size`` rows; up to ``whole`` rows stay together."""
    return F.when(F.col(count) <= whole, 1).otherwise(F.ceil(F.col(count) / size)).cast("int")


def _part(member: str, parts: str) -> Column:
    """A member's part, by its hash: needs neither an order nor the other members."""
    return F.pmod(F.xxhash64(member, F.lit(2)), F.col(parts)).cast("int")


def _others(parts: str) -> Column:
    """One row per part that the row's part meets, itself included."""
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _task(group: str, part: str, other: str) -> Column:
    return F.xxhash64(group, F.least(part, other), F.greatest(part, other)).alias("task")


def _shingled(words: int):
    """Rows with a text -> the same rows with their shingles instead; rows whose set is not that of their class go."""
    def run(batches):
        for rows, data, off in text_slices(batches, "text"):
            sets, bounds = shingle_sets(data, off, words)
            right = set_keys(sets, bounds) == rows.column("cls").to_numpy()
            packed = [sets[lo:hi].astype("<u8").tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            kept = pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("cluster", "cls", "copies", "tile", "tiles")), pa.array(packed, pa.binary())],
                                              names=["cluster", "cls", "copies", "tile", "tiles", "shingles"])
            yield kept.filter(pa.array(right))
    return run


def overlaps(sets: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets with all (other) sets."""
    both = sets if other is None else sets + other
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, token, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(both) if other is None else len(other)), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    n, width = int(token[-1]) + 1 if len(token) else 0, max(64, (1 << 22) // len(both))
    for lo in range(0, n, width):
        a, b = np.searchsorted(token, (lo, lo + width))
        table = np.zeros((len(both), min(width, n - lo)), np.float32)
        table[owner[a:b], token[a:b] - lo] = 1
        out += table[:len(sets)] @ (table if other is None else table[len(sets):]).T
    return out.astype(np.int64)


def _verified(percent: int):
    """Sorted rows of tiles -> (cls, root, links): each class's smallest linked class by steps, and its linked documents."""
    def run(batches):
        for group in groups(batches, "task"):
            names, first = np.unique(group.column("cls").to_numpy(), return_index=True)
            rows = group.take(pa.array(first))
            tile, copies = rows.column("tile").to_numpy(), rows.column("copies").to_numpy()
            sets = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("shingles")]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            sides = np.unique(tile)
            forest, links = Forest(len(names)), np.zeros(len(names), np.int64)
            if len(names) > 1:
                # One tile: all its pairs.  Two tiles: the pairs between them; those inside belong to other tasks.
                left = np.flatnonzero(tile == sides[0])
                right = left if len(sides) == 1 else np.flatnonzero(tile == sides[1])
                if len(sides) == 1 and not rows.column("same").to_pylist()[0]:
                    right = right[:0]
                common = overlaps([sets[i] for i in left], None if right is left else [sets[i] for i in right]) if len(right) else np.zeros((len(left), 0), np.int64)
                linked = enough(common, size[left][:, None] + size[right][None, :], percent)
                if right is left:
                    np.fill_diagonal(linked, False)
                links[left] += linked @ copies[right]
                if right is not left:
                    links[right] += copies[left] @ linked
                # A forest of the links, row by row.
                for i, row in enumerate(linked):
                    for j in np.flatnonzero(row).tolist():
                        if right is not left or j > i:
                            forest.join(int(left[i]), int(right[j]))
            root = forest.roots()
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(names[root], pa.int64()), pa.array(links, pa.int64())], names=["cls", "root", "links"])
    return run


def link_documents(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row."""
    documents = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # A row without an id is found again by a hash of its text.
    documents = documents.withColumn("unnamed", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    shared = df.sparkSession.sparkContext.broadcast(common_shingles(documents, words, "text"))  # see its bound
    features = written(documents.mapInArrow(_features(words, percent, shared, "doc_id", "text"), _FEATURES), "shingle-features")
    sets = features.where("n > 0")
    classes = sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("prefix").alias("prefix"))
    known = sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("unnamed").alias("unnamed"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    clusters = components(candidate_edges(classes, percent)).withColumnsRenamed({"node": "cls", "root": "cluster"})
    # Tiles of the clusters.
    clusters = clusters.join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")), "cluster")
    sized = (clusters.join(known, "cls").withColumn("tiles", _parts("m", TILE, TILE))
             .select("cluster", "cls", "rep", "unnamed", "copies", _part("cls", "tiles").alias("tile"), "tiles"))
    member = ["cluster", "cls", "copies", "tile", "tiles", "text"]
    texts = documents.select("doc_id", "text").join(sized.drop("unnamed"), F.col("doc_id") == F.col("rep")).select(member)
    nameless = documents.where("doc_id IS NULL").select("unnamed", "text").dropDuplicates(["unnamed"])
    texts = texts.unionByName(nameless.join(sized.where("rep IS NULL"), "unnamed").select(member))
    shingled = texts.mapInArrow(_shingled(words), "cluster bigint, cls bigint, copies bigint, tile int, tiles int, shingles binary")
    tasks = (shingled.withColumn("other", _others("tiles"))
             .select(_task("cluster", "tile", "other"), "cls", "copies", "tile",
                     (F.col("tile") == F.col("other")).alias("same"), "shingles"))
    verified = written(tasks.repartition("task").sortWithinPartitions("task")
                       .mapInArrow(_verified(percent), "cls bigint, root bigint, links bigint"), "verified-links")
    links = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(verified.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    least = (roots.join(known, "cls").groupBy("root").agg(F.min("rep").alias("least")))
    # Only classes with copies or links have a component beyond their one row.
    special = (known.where("copies > 1").select("cls").union(roots.select("cls")).distinct()
               .join(known, "cls").join(roots, "cls", "left").join(least, "root", "left").join(links, "cls", "left")
               .select(F.col("cls").alias("_cls"), F.coalesce("least", "rep").alias("least"),
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return (features.join(special, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"),
                    F.coalesce("links", F.lit(0)).alias("n_links")))


def keep_one_of_each(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without near copies: of each component of linked rows one with the smallest id stays.

    Decided row by row: a row is known by a hash of its id and text, so a row
    never goes because another one with its id does, rows with a null id (the
    last to be chosen) count like any other, and of repeated rows one stays.
    Rows without a set all stay.
    """
    row, first, stays, copies = (unused(df, c) for c in ("_row", "_first", "_stays", "_copies"))
    keyed = df.withColumn(row, F.xxhash64(id_col, text_col))
    linked = link_documents(keyed, words, percent, id_col=row, text_col=text_col).where("n_links > 0")
    members = written(linked.groupBy(F.col("doc_id").alias(row), F.col("component_id").alias("component")).agg(F.count(F.lit(1)).alias(copies)), "linked-rows")
    best = F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(row).alias("row")))
    chosen = keyed.select(id_col, row).join(members, row).groupBy("component").agg(best.getField("row").alias(first))
    marked = members.join(chosen, "component").select(row, copies, (F.col(row) == F.col(first)).alias(stays))
    single = keyed.join(marked.where(~F.col(stays) | (F.col(copies) > 1)).select(row).distinct(), row, "left_anti")
    repeated = keyed.join(marked.where(F.col(stays) & (F.col(copies) > 1)).select(row).distinct(), row, "left_semi")
    return single.unionByName(repeated.dropDuplicates([row, id_col, text_col])).select(*df.columns)
