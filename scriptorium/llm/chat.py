"""Chat formatting with Spark expressions only (operator 2).

A conversation's turns are collected as structs and sorted; adjacent turns of
one role become a block; blocks are concatenated:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

``<|im_sep|>`` stands between the texts of a block, so merging loses nothing.
Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|`` (a
line feed in a role becomes backslash n), hence no control string can come
from a text, and :func:`unescape` gives back what was there.  The loss mask is
a list of character spans (start from 1, length): the assistant's texts.

Semantics: null roles and texts are empty; turns with equal numbers are
ordered by role and text, null numbers come first; repeated rows are repeated
turns; rows with a null conversation form one conversation; an empty table
gives no rows.  A formatted conversation is one string, so the turns of one
conversation (not of one role, source or text) meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template.
START, END, SEPARATOR = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
TRAINED_ROLE = "assistant"


def escape(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if line_feeds:
        out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: between doubled backslashes, a backslash begins ``\\n`` or ``\\|``."""
    parts = F.transform(F.split(text, r"\\\\", -1),
                        lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(parts, "\\")


def collect_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns as sorted structs of number, role and text."""
    struct = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (rows.select(F.col(conv).alias(conv), struct.alias("_turn")).groupBy(conv)
            .agg(F.sort_array(F.collect_list("_turn")).alias("turns")))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss_spans): the string of each conversation and the spans of the texts to train on."""
    turns = collect_turns(rows, conv, turn, role, text)
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    firsts = F.filter(places, lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    runs = turns.select(conv, "turns", firsts.alias("firsts"))

    def block(first: Column, number: Column) -> Column:
        end = F.coalesce(F.get("firsts", number + 1), F.size("turns"))
        return F.struct(F.col("turns")[first]["role"].alias("role"),
                        F.transform(F.slice("turns", first + 1, end - first), lambda t: escape(t["text"])).alias("texts"))

    blocks = runs.select(conv, F.transform("firsts", block).alias("blocks"))

    # A block as pieces (string, whether it is trained on); joined they are the formatted string.
    def pieces(b: Column) -> Column:
        trained = b["role"] == TRAINED_ROLE
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            F.struct(F.when(i == 0, F.lit("")).otherwise(F.lit(SEPARATOR)).alias("s"), F.lit(False).alias("loss")),
            F.struct(t.alias("s"), trained.alias("loss")))))
        head = F.array(F.struct(F.concat(F.lit(START), escape(b["role"], True), F.lit("\n")).alias("s"), F.lit(False).alias("loss")))
        return F.concat(head, texts, F.array(F.struct(F.lit(END + "\n").alias("s"), F.lit(False).alias("loss"))))

    joined = blocks.select(conv, F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    # Running position over the pieces; trained pieces leave their span.
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.char_length(p["s"]).cast("bigint").alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return joined.select(conv, F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, len(START) + 1, 2**31 - 1)
        head = F.substring_index(body, "\n", 1)
        texts = F.split(F.substr(body, F.char_length(head) + 2), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape(head).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def trained_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turn count, hashes and lengths read back from formatted conversations."""
    read = formatted.select(conv, "formatted", read_turns(F.col("formatted")).alias("_turns"),
                            trained_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    flat = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv, F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
