"""Corpus pipeline: documents to token ids in five stages.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its result
as Parquet into the shared folder and reads it again as the next one's
``docs``.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_classifier
from scriptorium.llm.storage import written
from scriptorium.sources.fixture import read_table

#: Near duplicates: five words to a shingle, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: fitted on the labelled documents outside the held-out fold; what it predicts to be bad goes.

    Each row is judged by its text alone, repeated rows alike; a null text is judged as an empty one.
    """
    labels = read_table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: boilerplate lines leave the texts, and n_chars follows; every row stays, null texts stay null."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one row of each component stays, whatever the rows' ids; rows without words all stay."""
    return jaccard_join.keep_one_of_each(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: (doc_id, n_tokens, token_ids, decoded_sha256), the last from the bytes that the ids decode to; a row each, null texts as empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_and_decode(docs, path)
    return encoded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", keep_uncontaminated),
    ("byte_level_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Trained scores, alignments and merges have no SQL; tests hold the result against a plain computation.
ORACLE_SQL = None
