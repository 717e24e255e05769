"""Operator 2: chat formatting."""

import hashlib
import random

from scriptorium.llm import chat

SCHEMA = "conv_id bigint, turn int, role string, text string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(seed):
    rng = random.Random(seed)
    parts = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "\\\\", "<", "|", "<|", "<\\|", "\n", "\\n", "assistant", "é😀", " ", "ok"]
    out = {}
    for c in range(60):
        out[c] = [(rng.choice(["user", "assistant", "system", "ro\nle", "", "<|im_end|>", "a\\n\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))))
                  for _ in range(rng.randrange(1, 12))]
    return out


def rows(talks):
    return [(c, i, r, t, "clash") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]


def test_turns_and_loss_come_back(spark):
    talks = conversations(1)
    shuffled = rows(talks)
    random.Random(2).shuffle(shuffled)
    formatted = chat.format_conversations(spark.createDataFrame(shuffled, SCHEMA))
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert len(got) == len(talks)
    for c, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    assert all(got[c].formatted_chars == len(texts[c]) for c in talks)


def test_adjacent_turns_of_a_role_are_one_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", ""), (1, 3, "assistant", None, "")], SCHEMA)
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_sep|><|im_end|>\n"
    assert [row.formatted[s.start - 1:s.start - 1 + s.length] for s in row.loss_spans] == ["c", ""]


def test_nulls_ties_and_repeats(spark):
    df = spark.createDataFrame([(None, None, None, None, ""), (None, 1, "user", "x", ""), (2, 1, "user", "b", ""), (2, 1, "user", "a", ""), (2, 1, "user", "a", "")], SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[None].turns_sha256 == sha("\n\nuser\nx\n")
    assert got[2].turns_sha256 == sha("user\na\nuser\na\nuser\nb\n") and got[2].n_turns == 3


def test_long_conversation_and_empty_table(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "t" * 500, "") for i in range(1500)], SCHEMA)
    row = chat.digests(chat.format_conversations(df)).first()
    assert (row.n_turns, row.loss_chars) == (1500, 750 * 500)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "")], SCHEMA)
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
