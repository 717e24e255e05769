"""Small tables and plain models for the tests of the llm operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}

#: Texts that any operator must bear: null, empty, blanks, one word, control characters, other scripts, a long word, a long text.
HARD_TEXTS = [None, "", " \n\t ", "word", "a b", "\x1c\x1d", "日本語 テキスト", "Ünïcödé ñandú", "x" * 70_000, "lorem ipsum dolor " * 4000, "\n\n\n", "😀 😀 😀"]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["ba", "ton", "mi", "rel", "sha", "ko", "en", "du", "vi", "or"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(words))


def table(spark, texts, **columns):
    """Documents with ids from 0 and the further columns given as lists."""
    rows = [(i, t, *(c[i] for c in columns.values())) for i, t in enumerate(texts)]
    types = ", ".join(f"{name} {'bigint' if name == 'n_chars' else 'string'}" for name in columns)
    return spark.createDataFrame(rows, f"doc_id bigint, text string{', ' + types if types else ''}")


def documents(spark, texts):
    """A table with the columns of documents."""
    return table(spark, texts, lang=["en"] * len(texts), source=["h"] * len(texts), n_chars=[len(t or "") for t in texts])


def thue_morse(length: int) -> str:
    """Letters a and b, on which polynomial hashes modulo a power of two agree with those of the complement."""
    text = "a"
    while len(text) < length:
        text += text.translate({97: 98, 98: 97})
    return text


COMPLEMENT = {97: 98, 98: 97}
