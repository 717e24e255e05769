"""Historical abbreviation expansion (SCA-5, SCA-6, SCA-6b, SCA-6c).

The expansion is one null-propagating column expression built once on the
driver: an ordered fold of literal ``replace`` calls, then an ordered fold of
case-insensitive ``regexp_replace`` calls, then removal of combining marks.
Order is part of the semantics: an earlier key can rewrite part of a later
one (``ē`` fires before ``iē``), so the list is applied exactly as given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# ---------------------------------------------------------------------------
# Literal map, applied top to bottom with substring replace.
# Keys written with combining marks are decomposed (letter + U+0304/U+0303/...).
# The key "ꝯ" is listed twice; the first position counts.
# ---------------------------------------------------------------------------
ABBREVIATIONS = [
    ("ā", "an"),
    ("ē", "en"),
    ("ī", "in"),
    ("ō", "on"),
    ("ū", "un"),
    ("ã", "an"),
    ("ẽ", "en"),
    ("ĩ", "in"),
    ("õ", "on"),
    ("ũ", "un"),
    ("ꝑ", "per"),
    ("ꝓ", "pro"),
    ("ꝗ", "que"),
    ("ꝙ", "que"),
    ("ꝯ", "con"),
    ("ꝰ", "us"),
    ("q̄", "que"),
    ("q̃", "que"),
    ("ꝗ̄", "que"),
    ("ꝗ̃", "que"),
    ("m̄", "men"),
    ("ñ", "nn"),
    ("xp̄o", "cristo"),
    ("xpo", "cristo"),
    ("chr̄o", "cristo"),
    ("chr̃o", "cristo"),
    ("iē", "iesu"),
    ("iēs", "iesus"),
    ("iē̄", "iesu"),
    ("dñs", "dominus"),
    ("dē", "deus"),
    ("sp̄s", "spiritus"),
    ("sč", "sanctus"),
    ("scō", "sancto"),
    ("scā", "sancta"),
    ("scī", "sancti"),
    ("scē", "sancte"),
    ("cō", "con"),
    ("cõ", "con"),
    ("nō", "non"),
    ("nõ", "non"),
    ("pē", "per"),
    ("prō", "pro"),
    ("ꝺ", "d"),
    ("ſ", "s"),
    ("ꝭ", "is"),
    ("ꝼ", "f"),
    ("ł", "l"),
    ("et̄", "etc"),
    ("&c", "etc"),
    ("&c.", "etc."),
    ("ꝫ", "et"),
    ("z̄", "et"),
    ("ꝯ", "con"),
    ("xiī", "xii"),
    ("xiii̊", "xiii"),
    ("xiiij", "xiiii"),
    ("p̄", "per"),
    ("ꝑ̃", "pren"),
    ("p̃", "pre"),
]

# ---------------------------------------------------------------------------
# Word patterns, applied top to bottom, case-insensitive.
# Java regex form.  Word boundaries are written as look-arounds over word
# characters W = [\p{L}\p{N}_] (combining marks are not word characters),
# so a boundary right after a mark means "a word character follows".
# ---------------------------------------------------------------------------
_W = r"[\p{L}\p{N}_]"
_B = f"(?<!{_W})"          # start of word
_E = f"(?!{_W})"           # end of word
WORD_PATTERNS = [
    (f"{_B}chriſ?to{_E}", "cristo"),
    (f"{_B}ieſ?us?{_E}", "iesus"),
    (f"{_B}ſ([aeiou])", "s$1"),
    (f"([aeiou])ſ{_E}", "$1s"),
    ("ſ", "s"),
    (f"{_B}q(?:ue{_E}|[́̃̄](?={_W}))", "que"),
    (f"{_B}q([uo])(?:ue|[́̃̄])", "qu$1que"),
    ("([aeiou])(m|n)̃", "$1$2$2"),
    ("([aeiou])̃", "$1n"),
    (f"{_B}xp̄?o{_E}", "cristo"),
    (f"{_B}iē(?:̄?s{_E}|̄(?={_W})|{_E})", "iesus"),
    (f"{_B}dom̄?i?n[eu]s?{_E}", "dominus"),
    (f"{_B}dē̄?[iou]s?{_E}", "deus"),
    (f"{_B}sp̄?irit[ūu]s?{_E}", "spiritus"),
]

# Combining marks removed at the end; a set, each written once in code-point order (order has no effect).
COMBINING_MARKS = "̀́̂̃̄̆̇̈̊̋̌"


def _ordered_unique(pairs):
    seen, out = set(), []
    for k, v in pairs:
        if k not in seen:
            seen.add(k)
            out.append((k, v))
    return out


def _any_key() -> str:
    # every key with a character beyond ASCII is announced by its first such character, the others by themselves
    beyond = {next(ch for ch in k if ch > "\x7f") for k, _ in ABBREVIATIONS if not k.isascii()}
    plain = [k for k, _ in ABBREVIATIONS if k.isascii()]
    # ASCII characters are refused before the list of the others is tried
    return "|".join(["[[^\\x00-\\x7f]&&[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in sorted(beyond)) + "]]", *sorted(set(plain))])


#: Found in every text that holds a key of the literal map (and in some that hold none).
ANY_KEY = _any_key()


def expand_literals(x) -> Column:
    """SCA-5: ordered literal replacements; a text without any key is passed by the replacements."""
    c = _c(x)
    for k, v in _ordered_unique(ABBREVIATIONS):
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.when(~_c(x).rlike(ANY_KEY), _c(x)).otherwise(c)


def expand_patterns(x) -> Column:
    """SCA-6: ordered case-insensitive word-pattern replacements."""
    c = _c(x)
    for pat, rep in WORD_PATTERNS:
        c = F.regexp_replace(c, F.lit("(?iu)" + pat), F.lit(rep))
    return c


def strip_marks(x) -> Column:
    """SCA-6b: remove the combining marks."""
    return F.translate(_c(x), COMBINING_MARKS, "")


def expand_abbreviations(x) -> Column:
    """SCA-6c: literals, then word patterns, then marks; NULL stays NULL."""
    return strip_marks(expand_patterns(expand_literals(x)))


def changed_flag(original, converted) -> Column:
    """PRJ-9: changed row; a NULL original counts as changed (NaN != NaN)."""
    o, c = _c(original), _c(converted)
    return o.isNull() | ~o.eqNullSafe(c)
