"""Byte tokens (SCA-7), their inverse, and greedy argmax decoding (SCA-7c).

Token id = UTF-8 byte + 3; id 1 ends the sequence, 0 pads; the encoded
sequence is cut to ``max_len`` ids *including* the end id.  Decoding skips
ids below 3 (pad / end / unknown) and above the byte range, maps the label
pad -100 to pad, and drops a character cut by truncation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BYTE_OFFSET, EOS_ID, LABEL_PAD_ID, MAX_TOKENS, PAD_ID
from .text import _c, chars


def byte_tokens(x, max_len: int = MAX_TOKENS, eos: bool = True) -> Column:
    """SCA-7: array<int> of byte ids (+ end id), at most ``max_len`` long.

    The UTF-8 bytes are read as Latin-1, which has one character for every
    byte; the lambda then reads the code of its own character.
    """
    keep = max_len - 1 if eos else max_len
    one_each = F.decode(F.encode(_c(x), "UTF-8"), "ISO-8859-1")
    ids = F.transform(chars(F.substring(one_each, 1, keep)), lambda ch: F.ascii(ch) + BYTE_OFFSET)
    out = F.concat(ids, F.array(F.lit(EOS_ID))) if eos else ids
    return F.when(_c(x).isNotNull(), out)


def attention_mask(ids) -> Column:
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def decode_tokens(ids) -> Column:
    """Inverse of :func:`byte_tokens`; a multi-byte character cut at the end is dropped."""
    byte_ids = F.filter(F.transform(_c(ids), lambda i: F.when(i == LABEL_PAD_ID, F.lit(PAD_ID)).otherwise(i)),
                        lambda i: (i >= BYTE_OFFSET) & (i < BYTE_OFFSET + 256))
    hexs = F.array_join(F.transform(byte_ids, lambda i: F.lpad(F.hex(i - BYTE_OFFSET), 2, "0")), "")
    text = F.make_valid_utf8(F.unhex(hexs).cast("string"))
    return F.regexp_replace(text, "�+$", "")


def pad_to(ids, length, value: int) -> Column:
    """SCA-7b: right-pad an id array to ``length`` with ``value``."""
    a = _c(ids)
    ln = _c(length) if not isinstance(length, int) else F.lit(length)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(ln - F.size(a), F.lit(0))))


def argmax(v) -> Column:
    """SCA-7c: 0-based index of the first maximum (NaN counts as the largest, like numpy)."""
    arr = _c(v)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def greedy_ids(logits, vocabulary: int | None = None) -> Column:
    """SCA-7c: the first best id of every position.

    ``logits`` holds one array per position, or, with ``vocabulary`` given, all
    positions packed one after the other.  A position without numbers gives
    null; a packed array that is no whole number of positions is an error.
    """
    arr = _c(logits)
    if vocabulary is None:
        return F.transform(arr, argmax)
    n = F.size(arr)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(vocabulary))).otherwise(F.array().cast("array<int>"))
    ids = F.transform(starts, lambda at: argmax(F.slice(arr, at + 1, vocabulary)))
    broken = F.raise_error(F.concat(F.lit("packed scores of length "), n.cast("string"), F.lit(f" are no whole number of {vocabulary}")))
    return F.when(arr.isNotNull(), F.when(n % vocabulary != 0, broken).otherwise(ids))


def greedy_text(logits, vocabulary: int | None = None) -> Column:
    """SCA-7c and the inverse of SCA-7: scores of positions to text; pad, end and unknown ids vanish, so do positions without a score."""
    return decode_tokens(F.filter(greedy_ids(logits, vocabulary), lambda i: i.isNotNull()))
