"""Whitespace, characters and words as native column expressions.

SCA-2 normalise, SCA-3 strip, SCA-4 length, plus character / word arrays used
by the accuracy measures.  All are JVM-side expressions (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ODD_WS, WS_CLASS, WS_RUN

#: Maximal runs without and with whitespace.
WORD_RUN = f"[^{WS_CLASS[1:-1]}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x) -> Column:
    """Python ``str.split()``: maximal non-whitespace runs (array<string>)."""
    return _runs(x, r"\S+", WORD_RUN)


def word_and_space_runs(x) -> Column:
    """Word and whitespace runs, alternating, in order (joining them gives the input back)."""
    return _runs(x, r"\S+|\s+", f"{WORD_RUN}|{WS_RUN}")


def _runs(x, plain: str, general: str) -> Column:
    # Java tries every range of a class on every character; the short class does where its whitespace is all there is.
    c = _c(x)
    found = lambda pattern: F.regexp_extract_all(c, F.lit(pattern), 0)
    return F.when(c.rlike(ODD_WS), found(general)).otherwise(found(plain))


def ws_normalize(x) -> Column:
    """SCA-2: ``' '.join(s.split())``."""
    return F.array_join(words(x), " ")


def ws_strip(x) -> Column:
    """SCA-3: ``s.strip()`` with the Python whitespace class (``trim`` strips U+0020 only)."""
    return F.regexp_replace(_c(x), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_blank(x) -> Column:
    """Nothing is left after SCA-3: no character outside the whitespace class, which mostly the first one decides."""
    return ~_c(x).rlike(f"[^{WS_CLASS[1:-1]}]")


def char_length(x) -> Column:
    """SCA-4: length in code points."""
    return F.length(_c(x)).cast("bigint")


def chars(x) -> Column:
    """Code points of a string as array<string>; the empty string gives ``[]``.

    ``split(s, '')`` returns ``['']`` for the empty string, which would count as
    one character, hence the guard.
    """
    c = _c(x)
    return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(c, ""))


def add_prefix(x, prefix: str) -> Column:
    """PRJ-3: prepend the task prefix."""
    return F.concat(F.lit(prefix), _c(x))


def remove_prefix(x, prefix: str) -> Column:
    """PRJ-4: remove *every* occurrence of the prefix, case-sensitive."""
    return F.replace(_c(x), F.lit(prefix), F.lit(""))


def base_name(path) -> Column:
    """SRC-6: file name without its last extension; ``image`` when no path."""
    p = _c(path)
    name = F.regexp_extract(p, r"([^/]+?)(\.[^./]+)?$", 1)
    return F.coalesce(F.when(name != "", name), F.lit("image"))
