"""SCA-8 sentence BLEU / 100 with one reference.

Definition (public BLEU defaults): 13a tokenisation, case kept, n-grams up to
4, "exp" smoothing, effective order.  Per row:

* ``t_n`` = number of hypothesis n-grams, ``c_n`` = clipped matches
  (sum over distinct n-grams of min(count in hyp, count in ref));
* all ``c_n`` = 0 gives 0;
* orders with ``t_n`` = 0 are left out (effective order = min(4, |hyp|));
* a zero ``c_n`` contributes ``1 / (2^z * t_n)``, ``z`` counting zero orders
  so far including this one;
* brevity penalty ``exp(1 - |ref| / |hyp|)`` when the hypothesis is shorter.

Tokens and clipped counts come from whole Arrow batches (``ngramcounts.py``) or,
without Python, from column expressions: where one side repeats no n-gram the
clipped count is the size of ``array_intersect``, else the common n-grams are
counted on both sides.  No explode, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ODD_WS, WS_CLASS
from .ngramcounts import LITERALS, MAX_ORDER, ngram_counts
from .text import _c, words

# 13a tokenisation rules, applied in this order (literals first).  The first class of the definition also has the
# space, which would only become three spaces.
_13A_REGEXES = [
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
#: ASCII punctuation but the apostrophe: without it, no literal and no rule does anything but change whitespace.
_13A_TOUCHED = r"[!-&(-/:-@\[-`{-~]"


# A token where no literal stands, no points or commas follow each other and white space is plain: a run of what no rule cuts
# off, with a dash behind no digit and a point or comma between digits, or one mark.  Java tries a class of several
# ranges slowly on every character, so letters and digits have a short one of their own.
_13A_TOKEN = r"(?:\p{Alnum}++|[^\x00-\x7f]++|(?<![0-9])-|(?<=[0-9])[.,](?=[0-9])|'|[\x00-\x08\x0e-\x1b\x7f])++|\p{Punct}"
#: Longer texts go by the rules: a token's parts are matched one inside the other.
_13A_LONGEST = 1000


def tokens_13a(x) -> Column:
    """SCA-8b: 13a tokens of a string (array<string>); a text without punctuation has its words, most others are cut by one expression."""
    c = _c(x)
    by_rules = c.rlike(ODD_WS) | c.rlike("[.,][.,]") | c.rlike("&(?:quot|amp|lt|gt);") | c.contains("<skipped>") | c.contains("-\n") | (F.length(c) > _13A_LONGEST)
    cut = F.when(by_rules, _tokens_13a(c)).otherwise(F.regexp_extract_all(c, F.lit(_13A_TOKEN), 0))
    return F.when(c.rlike(_13A_TOUCHED), cut).otherwise(words(c))


def _tokens_13a(x) -> Column:
    s = F.regexp_replace(_c(x), f"{WS_CLASS}+$", "")          # rstrip
    for a, b in LITERALS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in _13A_REGEXES:
        s = F.regexp_replace(s, pat, rep)
    return words(s)


def tokens_plain(x) -> Column:
    """Whitespace tokens (no punctuation splitting)."""
    return words(x)


def _ngrams(joined: Column, n: int) -> Column:
    # ``joined``: tokens with a space between them; a token holds none.
    return F.regexp_extract_all(joined, F.lit("(?:^| )(?=([^ ]++" + " [^ ]++" * (n - 1) + "))"), 1)


def _clipped(hyp: Column, ref: Column) -> Column:
    """Sum over distinct n-grams of min(count in hyp, count in ref); both are column references.

    If one side repeats no n-gram, that is the number of common ones.
    """
    def times(grams, g):
        return F.size(grams) - F.size(F.array_remove(grams, g))

    common = F.array_intersect(hyp, ref)
    once = (F.size(F.array_distinct(hyp)) == F.size(hyp)) | (F.size(F.array_distinct(ref)) == F.size(ref))
    return F.when(once, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda total, g: total + F.least(times(hyp, g), times(ref, g))))


def ngram_stats(df: DataFrame, hyp_tokens: str, ref_tokens: str, prefix: str = "_bl") -> DataFrame:
    """Add ``{prefix}_c{n}``, ``{prefix}_t{n}``, ``{prefix}_lh``, ``{prefix}_lr`` columns.

    N-gram arrays are projected first, so the counts read materialised columns.
    Identical token arrays skip the n-grams: every n-gram matches (c_n = t_n).
    """
    ht, rt = F.col(hyp_tokens), F.col(ref_tokens)
    same = F.col(f"{prefix}_same")
    # tokens hold no space: joined, they are equal if the arrays are
    staged = df.select("*", F.array_join(ht, " ").alias(f"{prefix}_jh"), F.array_join(rt, " ").alias(f"{prefix}_jr"))
    jh, jr = F.col(f"{prefix}_jh"), F.col(f"{prefix}_jr")
    staged = staged.select("*", (jh == jr).alias(f"{prefix}_same"))
    grams = []
    for n in range(1, MAX_ORDER + 1):
        grams.append(F.when(~same, ht if n == 1 else _ngrams(jh, n)).alias(f"{prefix}_gh{n}"))
        grams.append(F.when(~same, rt if n == 1 else _ngrams(jr, n)).alias(f"{prefix}_gr{n}"))
    staged = staged.select(*[F.col(c) for c in df.columns], same, *grams)
    cols = [F.size(ht).alias(f"{prefix}_lh"), F.size(rt).alias(f"{prefix}_lr")]
    for n in range(1, MAX_ORDER + 1):
        tn = F.greatest(F.size(ht) - (n - 1), F.lit(0))
        cols.append(tn.alias(f"{prefix}_t{n}"))
        cols.append(F.when(same, tn).otherwise(_clipped(F.col(f"{prefix}_gh{n}"), F.col(f"{prefix}_gr{n}"))).alias(f"{prefix}_c{n}"))
    return staged.select(*[F.col(c) for c in df.columns], *cols)


def bleu_from_stats(prefix: str = "_bl") -> Column:
    """Score from the columns added by :func:`ngram_stats`."""
    c = [F.col(f"{prefix}_c{n}") for n in range(1, MAX_ORDER + 1)]
    t = [F.col(f"{prefix}_t{n}") for n in range(1, MAX_ORDER + 1)]
    lh, lr = F.col(f"{prefix}_lh"), F.col(f"{prefix}_lr")
    eff = F.least(F.lit(MAX_ORDER), lh)
    total = F.lit(0.0)
    zeros = F.lit(0)
    for n in range(MAX_ORDER):
        zeros = zeros + F.when(c[n] == 0, 1).otherwise(0)
        logp = F.when(c[n] > 0, F.log(c[n].cast("double")) - F.log(t[n].cast("double"))) \
                .otherwise(-(zeros.cast("double") * math.log(2.0) + F.log(t[n].cast("double"))))
        total = total + F.when(t[n] > 0, logp).otherwise(F.lit(0.0))
    bp = F.when(lh >= lr, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - lr.cast("double") / lh.cast("double")))
    any_match = c[0] + c[1] + c[2] + c[3] > 0
    return F.when(any_match, bp * F.exp(total / eff.cast("double"))).otherwise(F.lit(0.0))


def with_sentence_bleu(df: DataFrame, hyp: str, ref: str, out: str = "bleu_score",
                       tokenizer: str = "13a", in_batches: bool = True) -> DataFrame:
    """Add a sentence-BLEU column ``out`` for (hyp, ref); NULL inputs give 0.0.

    The counts of 13a tokens come from Arrow batches or, if not ``in_batches``,
    like others from column expressions alone.  Tokens, counts and the score
    are separate projections, so each text is tokenised once per row; of
    identical texts only one is.
    """
    cols = [F.col(c) for c in df.columns]
    if tokenizer == "13a" and in_batches:
        staged = df.select(*cols, ngram_counts(F.col(hyp), F.col(ref)).alias("_bl"))
        lh = F.col("_bl.lh")
        staged = staged.select(*cols, lh.alias("_bl_lh"), F.col("_bl.lr").alias("_bl_lr"),
                               *[F.greatest(lh - (n - 1), F.lit(0)).alias(f"_bl_t{n}") for n in range(1, MAX_ORDER + 1)],
                               *[F.col(f"_bl.c{n}").alias(f"_bl_c{n}") for n in range(1, MAX_ORDER + 1)])
    else:
        tok = tokens_13a if tokenizer == "13a" else tokens_plain
        h, r = F.coalesce(F.col(hyp), F.lit("")), F.coalesce(F.col(ref), F.lit(""))
        staged = df.select("*", tok(r).alias("_bl_rt"))
        staged = staged.select("*", F.when(h == r, F.col("_bl_rt")).otherwise(tok(h)).alias("_bl_ht"))
        staged = ngram_stats(staged, "_bl_ht", "_bl_rt")
    return staged.select(*cols, bleu_from_stats().alias(out))
