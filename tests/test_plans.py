"""Plan shape: pruning at the scan, native expressions only, partial group limit, bounded broadcasts."""

import pytest

import __spark_entry__ as E

from tables import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cer_by_lang", "evaluation_report", "lexicon_evaluation", "align_lines",
                                  "training_table", "assemble_pages", "worst_per_lang"])
def test_native_and_pruned(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = _plan(df)
    # no Python evaluation in the hot path
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan
    # the documents scan never reads the unused n_chars column
    if "documents.parquet" in plan:
        assert "n_chars" not in plan


def test_top_k_per_group_uses_partial_group_limit(spark):
    plan = _plan(E.queries()["worst_per_lang"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_global_index_broadcast_is_bounded(spark):
    from pyspark.sql import functions as F
    from scriptorium.operators.positions import global_index
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    plan = _plan(global_index(df, ["a", "b"], "idx"))
    # the only broadcast is the per-range offsets table (one row per range partition)
    assert plan.count("BroadcastExchange") <= 1


@pytest.mark.parametrize("name", ["dataset_profile", "normalise_ws", "strip_ws", "expand_literals", "strip_marks", "prefix_add_remove",
                                  "byte_tokens", "byte_decode", "line_pairs", "null_drop", "char_accuracy_padded", "word_accuracy"])
def test_narrow_queries_shuffle_no_lines(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "REPARTITION" not in plan and "REBALANCE" not in plan and plan.count("Exchange") <= 2


def test_alignment_scans_each_side_once(spark):
    plan = _plan(E.queries()["align_lines"](spark, SF_SMALL))
    assert plan.count("FileScan") == 2 and "Join" not in plan


def test_unpaired_is_one_full_outer_join(spark):
    plan = _plan(E.queries()["unpaired_lines"](spark, SF_SMALL))
    assert plan.count("Join ") == 1 and plan.count("FileScan") == 2


def test_word_codes_beyond_the_surrogates(spark):
    from pyspark.sql import functions as F
    from scriptorium.functions.distance import with_word_edit_distance
    n = 36_000
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    few = spark.range(1).select(F.lit("a b c").alias("p"), F.lit("a x c d").alias("r"))
    assert with_word_edit_distance(few, "p", "r").first()["word_ed"] == 2
    many = spark.range(1).select(F.lit("w1 w2").alias("p"), words.alias("r"))
    assert with_word_edit_distance(many, "p", "r").first()["word_ed"] == n - 2
    from scriptorium.functions.distance import _word_codes
    place = F.concat(F.array_repeat(F.lit(""), 0xD800 - 0x100 - 1), F.array(F.lit("last"), F.lit("next")))
    codes = spark.range(1).select(place.alias("v")).select(_word_codes(F.array(F.lit("last"), F.lit("next")), F.col("v")).alias("c")).first()["c"]
    assert [ord(c) for c in codes] == [0xD7FF, 0xE000]
