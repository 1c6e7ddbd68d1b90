"""Cleaning and chat conversion on edge rows, against plain statements of the rules."""

import pytest
from pyspark.sql import functions as F

from tokenmill.functions.text import WHITESPACE, clean_line
from tokenmill.operators import chat
from tokenmill.operators.lines import corpus_lines

TEXTS = [
    None, "", "   ", "\n", "\n\n \n", " x ", " a ", "　b c　",
    "​z​", "a\rb", "\r\nq\r\n", "👍 ok 👍", "é ", "two\nlines\n", "\x1cgs\x1f", "\x85n\x85",
]


def test_whitespace_is_what_strip_removes():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_clean_line_equals_strip(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = {r["id"]: r["line"] for r in rows.select("id", clean_line(F.col("text")).alias("line")).collect()}
    for i, text in enumerate(TEXTS):
        assert found[i] == (None if text is None else text.replace("\n", " ").strip())


def test_corpus_lines_keep_blank_but_not_empty(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = {r["id"]: r["line"] for r in corpus_lines(rows, "id").collect()}
    assert set(found) == {i for i, t in enumerate(TEXTS) if t}
    assert found[2] == "" and found[3] == ""


@pytest.mark.parametrize("cap", [0, 1, 3, 5, 14, 99])
def test_cap_counts_rows_with_text(spark, cap):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = sorted(r["id"] for r in corpus_lines(rows, "id", max_rows=cap).collect())
    assert found == [i for i, t in enumerate(TEXTS) if t][:cap]


def test_speakers(spark):
    names = ["Human", " GPT ", "bot", "model", "tool", "", "assistant\n", "SYSTEM", "user", None]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, role string")
    found = [r[0] for r in rows.orderBy("i").select(chat.speaker(F.col("role"))).collect()]
    assert found == [
        "Human", "Assistant", "Assistant", "Assistant", "Human", "Human", "Assistant", "System",
        "Human", "Human",
    ]


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", " hello ")],
    2: [("system", "be kind"), ("assistant", "ok")],
    3: [("user", "a"), ("assistant", "  ")],
    4: [("user", "a"), ("bot", "b"), ("user", "c"), ("gpt", "d")],
    5: [("user", "a"), ("assistant", "b"), ("user", "c")],
    6: [("assistant", "alone")],
    7: [("user", None), ("assistant", "x")],
    8: [("tool", "t\nt"), ("user", "u"), ("assistant", "é👍")],
    9: [(("user", "assistant")[i % 2], f"turn {i}") for i in range(200)],
    10: [("user", " "), ("user", "q"), ("", " "), ("assistant", "r"), ("user", "\n")],
    11: [(("user", "assistant")[i % 2], f"t{i}" if i % 3 else "") for i in range(66)],
}


SPEAKERS = ("Human", "Assistant")
# Written by hand: usable messages, prompt, response. The other conversations make no example.
EXAMPLES = {
    1: (2, "Human: hi\n\nAssistant:", "hello"),
    2: (2, "System: be kind\n\nAssistant:", "ok"),
    4: (4, "Human: a\n\nAssistant: b\n\nHuman: c\n\nAssistant:", "d"),
    8: (3, "Human: t\nt\n\nHuman: u\n\nAssistant:", "é👍"),
    9: (
        200,
        "".join(f"{SPEAKERS[i % 2]}: turn {i}\n\n" for i in range(199)) + "Assistant:",
        "turn 199",
    ),
    10: (2, "Human: q\n\nAssistant:", "r"),
    11: (
        44,
        "".join(f"{SPEAKERS[i % 2]}: t{i}\n\n" for i in range(65) if i % 3) + "Assistant:",
        "t65",
    ),
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (conv, turn, role, text)
        for conv, messages in CONVERSATIONS.items()
        for turn, (role, text) in enumerate(messages)
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("min_turns", [1, 2, 4])
def test_chat_examples(spark, turns, min_turns):
    wanted = {c: (p, r) for c, (n, p, r) in EXAMPLES.items() if n >= min_turns}
    cleaned = chat.clean_turns(turns)
    long = {r[0]: (r[1], r[2]) for r in chat.chat_examples(cleaned, min_turns).collect()}
    assert long == wanted
    arrays = chat.message_arrays(turns)
    listed = chat.chat_array_examples(arrays, "conv_id", min_turns=min_turns).collect()
    assert {r[0]: (r[1], r[2]) for r in listed} == wanted
    again = chat.chat_examples(cleaned.repartition(5, "content"), min_turns)
    assert {r[0]: (r[1], r[2]) for r in again.collect()} == wanted


@pytest.mark.parametrize("max_len", [2, 16, 64, 300, 100_000])
def test_chat_rows_from_turns_equal_whole_prompts(spark, turns, max_len):
    from tokenmill.operators.sft import sft_rows
    from tokenmill.plans.sft import chat_rows, chat_vocabulary

    vocabulary = chat_vocabulary(turns)
    rows = chat_rows(turns, vocabulary, max_len).orderBy("conv_id").collect()
    whole = sft_rows(chat.chat_examples(chat.clean_turns(turns)), vocabulary, max_len, "conv_id")
    assert rows == whole.orderBy("conv_id").collect()
    assert len(rows) == len(EXAMPLES)
    for r in rows:
        _, prompt, response = EXAMPLES[r["conv_id"]]
        ids = vocabulary.ids_of(prompt + response) + [vocabulary.eos_id]
        assert r["input_ids"] == ids[-max_len:]


def test_an_unknown_character_in_a_cut_turn_fails(spark):
    from tokenmill.operators.tokens import CharTokenizer
    from tokenmill.plans.sft import chat_rows

    known = CharTokenizer(tuple(sorted(set("Human: Assistant:\nabc"))))
    schema = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "user", "aéa")] + [(1, t, ("user", "bot")[t % 2], "abc") for t in range(1, 40)]
    good = chat_rows(spark.createDataFrame(turns[2:], schema), known, 8).collect()
    assert [len(r["input_ids"]) for r in good] == [8]
    with pytest.raises(Exception, match="1 characters are not in the vocabulary"):
        chat_rows(spark.createDataFrame(turns, schema), known, 8).collect()


def test_null_and_empty_message_arrays(spark):
    schema = "id long, messages array<struct<role string, content string>>"
    rows = spark.createDataFrame([(1, None), (2, []), (3, [("user", "a"), ("bot", "b")])], schema)
    found = chat.chat_array_examples(rows, "id").collect()
    assert [(r["id"], r["prompt"], r["response"]) for r in found] == [
        (3, "Human: a\n\nAssistant:", "b")
    ]


def test_adjacent_turns_cross_blocks(spark, turns):
    found = {(r[0], r[1]): (r[2], r[3]) for r in chat.adjacent_turns(turns).collect()}
    wanted = {}
    for conv, messages in CONVERSATIONS.items():
        for i, ((role, text), (next_role, reply)) in enumerate(zip(messages, messages[1:])):
            human = (role or "") in ("user", "tool", "")
            if human and next_role in ("assistant", "bot", "gpt") and text and reply:
                if text.strip() and reply.strip():
                    wanted[(conv, i)] = (text.strip(), reply.strip())
    assert found == wanted
    assert (9, 62) in found and (9, 64) in found


def test_prompt_response_rows(spark):
    rows = spark.createDataFrame(
        [(1, " a ", 5.0), (2, None, 1.0), (3, "  ", 2.0), (4, "ü", None)],
        "id long, q string, a double",
    )
    found = chat.prompt_response_rows(rows, "id", "q", "a").collect()
    assert [tuple(r) for r in found] == [(1, "a", "5.0")]
