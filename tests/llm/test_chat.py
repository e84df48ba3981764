"""Chat formatting: every conversation comes back from its formatted text."""

import hashlib
import random

import pytest

from tributary.llm import chat
from tributary.llm.queries import CONFLICT, ORACLE, QUERIES

COLUMNS = "conv_id long, turn long, role string, text string, part string, whole string, loss string, tie string"
LONG = "word </turn> ### User: \\" * 20_000


def digests(rows):
    """One row per conversation, straight from the turns."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        out.append((conv, len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def read_back(df, **options):
    found = chat.read_back(chat.formatted(df, **options))
    return sorted((tuple(r) for r in found.drop("formatted_chars").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    said = ["plain", "", None, CONFLICT, "\\", "\\\\</turn>\n", "### =x: ", "café 😀\n</turn>\n### Assistant: no", LONG]
    out = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(said * 2)]
    out += [(2, 5, "assistant", "same"), (2, 5, "assistant", "same"), (3, None, None, None), (None, 1, "a role\n: ", "x"), (None, 2, "=", "y")]
    out += [(4, 0, "system", "s"), (4, 1, "tool", "t"), (4, 2, "User", "capital")]
    return [(*r, *["x"] * 4) for r in out]


def test_turns_come_back():
    random.seed(5)
    bits = ["\\", "</turn>", "### Assistant: ", "### ", "\n", "a", ": ", "</", "turn>", "é😀", "### =x%20: "]
    for _ in range(20_000):
        text = "".join(random.choices(bits, k=random.randrange(9)))
        role = random.choice(["user", "assistant", None, "", "-", "=", "we ird\n: ", "User", "é"])
        turn = chat.turn_text(role, text)
        assert chat.turns_of(turn + turn) == [(role, text)] * 2
        if not chat.CONTROL.search(text):
            assert turn == chat.render(role, text)  # nothing is escaped without a conflict


def test_parser_refuses_what_is_not_of_the_grammar():
    for text in ("no turn", "### User: a", "### User: a</turn>\n", "### User: a\n</turn>x", "### User: a\n### User: b\n</turn>\n", "### User: \n"):
        with pytest.raises(ValueError):
            chat.turns_of(text)


@pytest.mark.parametrize("piece_chars", [chat.PIECE_CHARS, 40])
def test_conversations_come_back(spark, rows, piece_chars):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert read_back(df, piece_chars=piece_chars) == digests(rows)


def test_pieces_and_mask(spark, rows):
    pieces = chat.formatted(spark.createDataFrame(rows, COLUMNS), piece_chars=40).collect()
    for p in pieces:
        assert [chat.unescaped(p.text[s.start : s.end]) for s in p.loss] == [t for r, t in chat.turns_of(p.text) if r == "assistant"]
    whole = {p.conv_id for p in pieces if p.whole}
    assert all(sum(p.conv_id == c for p in pieces) == 1 for c in whole)


def test_one_conversation_with_nearly_all_rows(spark):
    rows = [(8, i, ["user", "assistant"][i % 2], f"text {i} </turn>") for i in range(3000)] + [(9, 0, "user", "x"), (7, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], COLUMNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with rows enough for several tasks
    try:
        assert read_back(df, piece_chars=5000) == digests(rows)
        tasks = {p.part >> 32 for p in chat.formatted(df).where("conv_id = 8").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1  # the conversation is formatted by several tasks


def test_no_rows(spark):
    assert read_back(spark.createDataFrame([], COLUMNS)) == []


def test_query_equals_sql(spark, sf):
    from check_oracle import compare, connect

    count, problem = compare(QUERIES["op13_chat"](spark, sf), connect(sf), ORACLE["op13_chat"])
    assert not problem and count > 1
