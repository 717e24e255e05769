"""Edit distances and positional accuracy measures (SCA-1, SCA-9..14, AGG-15).

Everything here is a built-in column expression.  ``levenshtein`` is Spark's
code-point implementation (O(n*m) per row), so callers segment texts into
lines before scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, chars, words, ws_normalize, ws_strip


#: Distances up to here come from a band of the matrix; only pairs farther apart visit every cell.
NEAR = 8


def _near_first(a: Column, b: Column) -> Column:
    # the band's -1 for a farther pair has no place in the array, so the band is run once
    near = F.get(F.array(*[F.lit(d) for d in range(NEAR + 1)]), F.levenshtein(a, b, NEAR))
    return F.when(a == b, 0).otherwise(F.coalesce(near, F.levenshtein(a, b))).cast("bigint")


def edit_distance(a, b) -> Column:
    """SCA-1: Levenshtein over code points, unit costs; a band along the diagonal first, the whole matrix if that is not enough.

    Texts that are expressions are computed once: the distance reads them as fields of a one-row array.
    """
    if isinstance(a, str) and isinstance(b, str):
        return _near_first(F.col(a), F.col(b))
    pair = F.array(F.struct(_c(a).alias("a"), _c(b).alias("b")))
    return F.get(F.transform(pair, lambda p: _near_first(p["a"], p["b"])), F.lit(0))


def normalized_edit_distance(pred, ref) -> Column:
    """Edit distance after whitespace normalisation (numerator of AGG-1/AGG-2)."""
    return edit_distance(ws_normalize(pred), ws_normalize(ref))


def row_cer(distance, ref) -> Column:
    """SCA-12: distance / len(reference), 0 when the reference is empty."""
    return F.coalesce(F.try_divide(_c(distance).cast("double"), F.length(_c(ref)).cast("double")),
                      F.lit(0.0))


def exact_match(pred, ref) -> Column:
    """SCA-14: equality after strip."""
    return ws_strip(pred) == ws_strip(ref)


def _count_true(arr: Column) -> Column:
    return F.size(F.filter(arr, lambda t: t)).cast("bigint")


def padded_char_matches(pred, ref) -> Column:
    """SCA-9 numerator: equal positions after strip, shorter side padded with spaces."""
    p, r = chars(ws_strip(pred)), chars(ws_strip(ref))
    return _count_true(F.zip_with(p, r, lambda a, b: F.coalesce(a, F.lit(" ")) == F.coalesce(b, F.lit(" "))))


def truncated_char_matches(pred, ref) -> Column:
    """SCA-10 numerator: equal positions over the common length; padding never matches."""
    p, r = chars(ws_strip(pred)), chars(ws_strip(ref))
    return _count_true(F.zip_with(p, r, lambda a, b: F.coalesce(a == b, F.lit(False))))


def char_positions(pred, ref) -> Column:
    """SCA-9/10 denominator: the longer stripped length."""
    return F.greatest(F.length(ws_strip(pred)), F.length(ws_strip(ref))).cast("bigint")


def word_matches(pred, ref) -> Column:
    """SCA-11 numerator: equal words at equal positions."""
    return _count_true(F.zip_with(words(pred), words(ref), lambda a, b: F.coalesce(a == b, F.lit(False))))


def word_positions(pred, ref) -> Column:
    """SCA-11 denominator: the larger word count."""
    return F.greatest(F.size(words(pred)), F.size(words(ref))).cast("bigint")


#: Distinct words of one pair that have a code point of their own (all but the surrogates and the first 256).
MAX_PAIR_VOCABULARY = 0x110000 - 0x800 - 0x100


def _word_codes(ws: Column, vocab: Column) -> Column:
    # One character per distinct word: U+0100 and up by the word's place in the pair's vocabulary, past the surrogates.
    def code(w: Column) -> Column:
        at = F.array_position(vocab, w) + 0xFF
        point = F.when(at < 0xD800, at).otherwise(at + 0x800)
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    return F.when(F.size(vocab) > MAX_PAIR_VOCABULARY, F.raise_error(F.lit(f"more than {MAX_PAIR_VOCABULARY} distinct words in one pair"))) \
        .otherwise(F.array_join(F.transform(ws, code), ""))


def with_word_edit_distance(df: DataFrame, pred: str, ref: str, out: str = "word_ed") -> DataFrame:
    """AGG-15: standard word-level edit distance (substitute/insert/delete whole words).

    Each distinct word of the pair is coded as one character, then the
    character Levenshtein of the coded strings is the word distance.  Word
    arrays and the pair vocabulary are projected first so the coding lambda
    reads columns.
    """
    cols = df.columns
    st = df.select("*", words(pred).alias("_wed_p"), words(ref).alias("_wed_r"))
    st = st.select("*", F.array_distinct(F.concat("_wed_p", "_wed_r")).alias("_wed_v"))
    v = F.col("_wed_v")
    return st.select(*[F.col(c) for c in cols],
                     F.levenshtein(_word_codes(F.col("_wed_p"), v), _word_codes(F.col("_wed_r"), v))
                     .cast("bigint").alias(out))
