"""Correction of words the lexicon has not seen (MOD-2 beyond exact matches, ranked by MOD-3).

The lexicon of ``correct.learn_lexicon`` replaces words it met in training.  Here
a word that is neither in the lexicon nor a verified word is compared with the
vocabulary of verified words:

1. *Candidates* within ``allowed_edits`` of the word, found by an equi-join on
   keys: two words are within k edits exactly if deleting at most k characters
   from each can give the same string.  Words over ``LONG`` characters, which have
   too many deletions, use three segments instead: two edits leave one of them
   intact, at most two places away.  Keys are hashes; a collision only adds
   a pair for the exact distance to reject.
2. *Ranking* by a noisy channel in whole hundredths of a natural logarithm: the
   candidate's frequency against the cost of the difference.  What differs is
   explained as one replaced part (``rn`` for ``m``) or, at equal length, as
   single confused characters; each costs log(all confusions) minus log(how often
   the aligned training words show it).
3. *Acceptance* if the best candidate's frequency outweighs its cost.

Everything is a join or an aggregate over distinct words, never over occurrences.
Keys of short words are the crowded ones; a word under ``LETTERS_PER_EDIT``
characters is left alone, and the classes of one and of two edits do not share keys.

Semantics: nulls and blank lines have no words; ties go to the smaller distance,
the more frequent, then the smaller word; empty tables give no candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import ensure_checkpoint_dir
from .correct import confusions_of, lexicon_of, pair_counts

MAX_EDITS, LETTERS_PER_EDIT = 2, 3
#: Longer words are found by segments; deletions of a word of this length number about two hundred.
LONG = 20
#: A verified word is a candidate when seen so often.
MIN_SEEN = 2
#: Longest replaced part whose frequency is learned.
LONGEST_PART = 3


def word_counts(lines: DataFrame, col: str) -> DataFrame:
    """(word, n) over all lines."""
    return lines.select(F.explode(words(col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def allowed_edits(word, per_edit: int = LETTERS_PER_EDIT) -> Column:
    return F.least(F.lit(MAX_EDITS), F.floor(F.length(word) / per_edit)).cast("int")


def _without_one(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))


def deletions(word: Column, edits: int) -> Column:
    """The distinct strings left after deleting at most ``edits`` characters of a word with at least that many."""
    found = F.array(word)
    for _ in range(edits):
        found = F.concat(found, F.flatten(F.transform(found, lambda w: F.when(F.length(w) > 0, _without_one(w)).otherwise(F.array().cast("array<string>")))))
        found = F.array_distinct(found)
    return found


def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """First character (from 1) and size of segment i of three in a word of that length."""
    at = lambda k: F.floor(length * k / (MAX_EDITS + 1)).cast("int")
    return at(i) + 1, at(i + 1) - at(i)


def _keys(word: str, edits: Column, vocabulary: bool) -> Column:
    """Join keys of a word; ``edits`` is the class it asks for (ignored on the side of the vocabulary, which serves all)."""
    w, length = F.col(word), F.length(word)
    hashed = lambda kind, parts: F.transform(parts, lambda x: F.xxhash64(F.lit(kind), x))
    none = F.array().cast("array<bigint>")
    one, two = (hashed(k, deletions(w, k)) for k in (1, 2))
    parts = []
    for i in range(MAX_EDITS + 1):
        for grow in range(-MAX_EDITS, MAX_EDITS + 1) if not vocabulary else (0,):
            start, size = _segment(length + grow, i)
            for shift in range(-MAX_EDITS, MAX_EDITS + 1) if not vocabulary else (0,):
                parts.append(F.xxhash64(F.lit(3 + i), length + grow, F.substring(w, F.greatest(start + shift, F.lit(1)), size)))
    segments = F.array_distinct(F.array(*parts))
    if vocabulary:
        short = F.when(length <= LONG + MAX_EDITS, F.concat(one, two)).otherwise(none)
        return F.concat(short, F.when(length >= LONG + 1 - MAX_EDITS, segments).otherwise(none))
    return F.when(length > LONG, F.when(edits > 0, segments).otherwise(none)).when(edits == 2, two).when(edits == 1, one).otherwise(none)


def _dealt(df: DataFrame) -> DataFrame:
    """Words dealt to all cores: they are few bytes, which AQE would give to few tasks, and their keys are many."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism), "word")


def candidates(unknown: DataFrame, vocabulary: DataFrame, per_edit: int = LETTERS_PER_EDIT) -> DataFrame:
    """(word, candidate, n, distance): every vocabulary word (word, n) within the edits allowed for the unknown word."""
    asks = _dealt(unknown).select("word", allowed_edits("word", per_edit).alias("_edits")).where(F.col("_edits") > 0)
    asks = asks.select("word", "_edits", F.explode(F.array_distinct(_keys("word", F.col("_edits"), False))).alias("_key"))
    has = _dealt(vocabulary.select("word", "n")).select(F.col("word").alias("candidate"), "n", F.explode(F.array_distinct(_keys("word", F.lit(0), True))).alias("_key"))
    met = asks.join(has, "_key").where("word <> candidate").groupBy("word", "candidate").agg(F.first("n").alias("n"), F.first("_edits").alias("_edits"))
    distance = F.levenshtein(F.col("word"), F.col("candidate"), MAX_EDITS)
    return met.withColumn("distance", distance.cast("bigint")).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("_edits"))).drop("_edits")


def _chars(x) -> Column:
    return F.split(x, "")


def _common_start(a: Column, b: Column) -> Column:
    same = F.zip_with(_chars(a), _chars(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when((a == "") | (b == ""), 0).when(first == 0, F.length(a)).otherwise(first - 1).cast("int")


def differing_parts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``a_part`` and ``b_part``: what is left of two words without their common start and common end."""
    df = df.withColumn("_start", _common_start(F.col(a), F.col(b)))
    rest = [F.substring(F.col(c), F.col("_start") + 1, F.length(c)) for c in (a, b)]
    df = df.select("*", rest[0].alias("_ra"), rest[1].alias("_rb"))
    df = df.withColumn("_end", _common_start(F.reverse("_ra"), F.reverse("_rb")))
    part = lambda r: F.substring(F.col(r), F.lit(1), F.length(r) - F.col("_end"))
    return df.select("*", part("_ra").alias("a_part"), part("_rb").alias("b_part")).drop("_start", "_ra", "_rb", "_end")


def confusion_weights(pairs: DataFrame, ocr: str = "ocr_prediction", truth: str = "text") -> DataFrame:
    """(a_part, b_part, n): MOD-3's confused characters, and how often a longer or shorter part stood for another one."""
    return weights_of(pair_counts(pairs, ocr, truth))


def weights_of(counts: DataFrame) -> DataFrame:
    """``confusion_weights`` from ``correct.pair_counts``."""
    single = confusions_of(counts).select(F.col("ocr_char").alias("a_part"), F.col("text_char").alias("b_part"), "n")
    differ = differing_parts(counts.where("ocr_word <> text_word"), "ocr_word", "text_word")
    parts = (differ.where((F.length("a_part") <= LONGEST_PART) & (F.length("b_part") <= LONGEST_PART) & ~((F.length("a_part") == 1) & (F.length("b_part") == 1)))
             .groupBy("a_part", "b_part").agg(F.sum("n").alias("n")))
    return single.unionByName(parts)


def _hundredths(n: Column) -> Column:
    return F.floor(100 * F.log(1.0 + n)).cast("bigint")


def ranked(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(word, candidate, n, distance, score) with the noisy-channel score of every candidate."""
    total = weights.agg(_hundredths(F.coalesce(F.sum("n"), F.lit(0))).alias("_all"))
    parts = differing_parts(found, "word", "candidate")
    chars = F.filter(F.arrays_zip(_chars("word").alias("a"), _chars("candidate").alias("b")), lambda z: z["a"] != z["b"])
    as_one = F.array(F.struct(F.lit(1).alias("how"), F.col("a_part").alias("a"), F.col("b_part").alias("b"), F.col("distance").alias("edits")))
    singly = F.transform(chars, lambda z: F.struct(F.lit(2).alias("how"), z["a"].alias("a"), z["b"].alias("b"), F.lit(1).cast("bigint").alias("edits")))
    same_length = F.length("word") == F.length("candidate")
    # At equal length the characters may also differ by shifting; only differences in place explain the distance singly.
    how = F.when(same_length & (F.size(chars) == F.col("distance")), F.concat(as_one, singly)).otherwise(as_one)
    pieces = parts.select("word", "candidate", "n", "distance", F.explode(how).alias("p"))
    pieces = pieces.select("word", "candidate", "n", "distance", "p.*").join(
        weights.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"), _hundredths(F.col("n")).alias("_known")), ["a", "b"], "left")
    pieces = pieces.join(F.broadcast(total))  # one row
    cost = F.when(F.col("_known").isNotNull(), F.col("_all") - F.col("_known")).otherwise(F.col("edits") * F.col("_all"))
    explained = pieces.groupBy("word", "candidate", "n", "distance", "how").agg(F.sum(cost).alias("_cost"))
    return (explained.groupBy("word", "candidate", "n", "distance").agg(F.min("_cost").alias("_cost"))
            .select("word", "candidate", "n", "distance", (_hundredths(F.col("n")) - F.col("_cost")).alias("score")))


def corrections(found: DataFrame, weights: DataFrame, least: int = 0) -> DataFrame:
    """(ocr_word, text_word, score): the best candidate of each word, where its score is above ``least``."""
    order = Window.partitionBy("word").orderBy(F.col("score").desc(), "distance", F.col("n").desc(), "candidate")
    return (ranked(found, weights).withColumn("_r", F.row_number().over(order)).where((F.col("_r") == 1) & (F.col("score") > least))
            .select(F.col("word").alias("ocr_word"), F.col("candidate").alias("text_word"), "score"))


def unknown_words(lines: DataFrame, lexicon: DataFrame, vocabulary: DataFrame, src: str = "ocr_prediction") -> DataFrame:
    """(word): the lines' distinct words that are neither in the lexicon nor verified."""
    known = lexicon.select(F.col("ocr_word").alias("word")).unionByName(vocabulary.select("word"))
    return lines.select(F.explode(F.array_distinct(words(src))).alias("word")).distinct().join(known, "word", "left_anti")


@dataclass(frozen=True)
class Learned:
    """What one pass over aligned lines teaches: ``vocabulary`` (word, n), ``lexicon`` of MOD-2, ``weights`` of MOD-3."""

    vocabulary: DataFrame
    lexicon: DataFrame
    weights: DataFrame


def learn(pairs: DataFrame, ocr: str = "ocr_prediction", truth: str = "text") -> Learned:
    """``word_counts``, ``learn_lexicon`` and ``confusion_weights`` of the same lines, which are read once.

    Everything is made from the counts of distinct word pairs; a verified word whose line does not align has
    no recognised word.  The counts are checkpointed: they are used several times, and are far fewer than the words.
    """
    alone = F.transform("_wt", lambda w: F.struct(F.lit(None).cast("string").alias("ocr_word"), w.alias("text_word")))
    aligned = F.arrays_zip(F.col("_wo").alias("ocr_word"), F.col("_wt").alias("text_word"))
    both = pairs.select(words(ocr).alias("_wo"), words(truth).alias("_wt")).select(
        F.explode(F.when(F.size("_wo") == F.size("_wt"), aligned).otherwise(alone)).alias("p"))
    ensure_checkpoint_dir(pairs.sparkSession)
    counts = both.groupBy("p.ocr_word", "p.text_word").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    known = counts.where(F.col("ocr_word").isNotNull())
    vocabulary = counts.groupBy(F.col("text_word").alias("word")).agg(F.sum("n").alias("n"))
    return Learned(vocabulary, lexicon_of(known), weights_of(known))


def extend_lexicon(lexicon: DataFrame, pairs: DataFrame, lines: DataFrame, ocr: str = "ocr_prediction", truth: str = "text",
                   min_seen: int = MIN_SEEN) -> DataFrame:
    """(ocr_word, text_word): the lexicon and the corrections of the lines' unknown words, ready for ``correct.apply_lexicon``."""
    return extended(lexicon, learn(pairs, ocr, truth), lines, ocr, min_seen)


def extended(lexicon: DataFrame, learned: Learned, lines: DataFrame, ocr: str = "ocr_prediction", min_seen: int = MIN_SEEN) -> DataFrame:
    """``extend_lexicon`` by what has been learned already."""
    found = candidates(unknown_words(lines, lexicon, learned.vocabulary, ocr), learned.vocabulary.where(F.col("n") >= min_seen))
    more = corrections(found, learned.weights)
    return lexicon.select("ocr_word", "text_word").unionByName(more.select("ocr_word", "text_word"))
