"""Training-table preparation (MOD-4, SCA-7b, TOP-3).

PRJ-2 (drop incomplete pairs) -> PRJ-3 (task prefix) -> SCA-7 (byte tokens)
-> WIN-3a (positional split) in one DataFrame plan; written as Parquet
partitioned by ``split``.  The test split, which the reference computes and
then drops, is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bleu import with_sentence_bleu
from ..functions.distance import edit_distance, normalized_edit_distance
from ..functions.text import add_prefix, ws_normalize
from ..functions.tokens import attention_mask, byte_tokens, decode_tokens, greedy_text, pad_to
from ..schema import LABEL_PAD_ID, MAX_TOKENS, PAD_ID, PREFIX_TRAIN
from .metrics import cer
from .positions import global_index, positional_split


def training_table(pairs: DataFrame, key=("page_id", "line_number"), prefix: str = PREFIX_TRAIN,
                   max_len: int = MAX_TOKENS, three_way: bool = True,
                   ocr: str = "ocr_prediction", truth: str = "text") -> DataFrame:
    """MOD-4: key, input_ids, attention_mask, labels, split."""
    clean = pairs.na.drop(subset=[ocr, truth])
    return tokenized(positional_split(clean, key, three_way=three_way), key, prefix, max_len, ocr, truth)


def tokenized(split: DataFrame, key=("page_id", "line_number"), prefix: str = PREFIX_TRAIN, max_len: int = MAX_TOKENS,
              ocr: str = "ocr_prediction", truth: str = "text") -> DataFrame:
    """The training table of complete pairs that have their ``idx`` and ``split``."""
    ids = byte_tokens(add_prefix(ocr, prefix), max_len)
    staged = split.select(*key, "idx", "split", ids.alias("input_ids"), byte_tokens(truth, max_len).alias("labels"))
    return staged.select(*key, "idx", "split", "input_ids", attention_mask("input_ids").alias("attention_mask"), "labels")


def padded_batches(table: DataFrame, batch_size: int = 8, idx: str = "idx") -> DataFrame:
    """SCA-7b: batch = idx div batch_size; pad inputs with 0, labels with -100, mask with 0.

    The window is partitioned by batch id (groups of ``batch_size`` rows).
    """
    batched = table.withColumn("batch", F.floor(F.col(idx) / batch_size).cast("bigint"))
    w = Window.partitionBy("batch")
    m_in = F.max(F.size("input_ids")).over(w)
    m_lab = F.max(F.size("labels")).over(w)
    return batched.select(
        "*",
        pad_to("input_ids", m_in, PAD_ID).alias("input_ids_padded"),
        pad_to("attention_mask", m_in, 0).alias("attention_mask_padded"),
        pad_to("labels", m_lab, LABEL_PAD_ID).alias("labels_padded"))


def first_examples(table: DataFrame, n: int = 3, order=("idx",)) -> DataFrame:
    """TOP-3: the first ``n`` rows in key order (a top-k, planned as TakeOrderedAndProject)."""
    return table.orderBy(*order).limit(n)


def indexed(pairs: DataFrame, key=("page_id", "line_number")) -> DataFrame:
    """WIN-1 on a pair table."""
    return global_index(pairs, key, "idx")


def evaluate_logits(df: DataFrame, logits: str, labels: str, vocabulary: int | None = None, by=()) -> DataFrame:
    """SCA-7c, AGG-1, AGG-3, AGG-4 on model output: (by, cer, bleu, edit_distance, eval_samples).

    Scores become ids and text, label ids (with -100 for padding) become the
    reference text; a null side counts as empty.
    """
    texts = df.select(*by, F.coalesce(greedy_text(logits, vocabulary), F.lit("")).alias("prediction"), F.coalesce(decode_tokens(labels), F.lit("")).alias("text"))
    parts = texts.select("*", edit_distance("prediction", "text").alias("ed"), normalized_edit_distance("prediction", "text").alias("ed_norm"),
                         F.length(ws_normalize("text")).alias("ref_norm_len"))
    parts = with_sentence_bleu(parts, "prediction", "text", "bleu_score")
    return parts.groupBy(*by).agg(cer().alias("cer"), F.avg("bleu_score").alias("bleu"), F.avg("ed").alias("edit_distance"), F.count(F.lit(1)).alias("eval_samples"))
