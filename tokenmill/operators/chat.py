"""Chat messages to prompt/response examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.text import as_text, strip

# Role names, the speakers they stand for and the layout of a prompt.
ASSISTANT_ROLES = ("assistant", "bot", "model", "gpt")
SYSTEM_ROLES = ("system",)
TURN_SEPARATOR = "\n\n"
SPEAKER_SEPARATOR = ": "
PROMPT_OPENING = "Assistant:"  # of the response, at the end of a prompt
PROMPT_END = TURN_SEPARATOR + PROMPT_OPENING

BLOCK = 64  # turns of one conversation that are joined in one step


def speaker(role: Column) -> Column:
    """Canonical speaker of a role; unknown roles count as Human."""
    name = F.lower(strip(role))
    return (
        F.when(name.isin(*ASSISTANT_ROLES), "Assistant")
        .when(name.isin(*SYSTEM_ROLES), "System")
        .otherwise("Human")
    )


def clean_turns(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, turn, speaker, content) without blank messages."""
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        speaker(F.col(role)).alias("speaker"),
        as_text(F.col(text)).alias("content"),
    ).where("content <> ''")


def _spoken(who: Column, content: Column) -> Column:
    return F.concat(who, F.lit(SPEAKER_SEPARATOR), content)


def chat_examples(turns: DataFrame, min_turns: int = 2) -> DataFrame:
    """(conv_id, prompt, response) from cleaned long rows.

    Kept are conversations with ``min_turns`` messages or more whose last speaker is the
    assistant; the last message is the response and all earlier ones are the prompt. Turns are
    joined in blocks before a conversation is put together, so a long one is spread over many
    tasks and its last step sees one string per block.
    """
    spoken = _spoken(F.col("speaker"), F.col("content"))
    line = F.struct("turn", spoken.alias("spoken"))
    last = F.struct("turn", "speaker", "content")
    blocks = (
        turns.groupBy("conv_id", F.expr(f"turn div {BLOCK}").alias("block"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_list(line)).alias("lines"),
            F.max(last).alias("last"),
        )
        .select(
            "conv_id",
            "block",
            "n",
            "last",
            # The block's own last turn stays apart: it may turn out to be the response.
            F.array_join(
                F.transform(F.expr("slice(lines, 1, size(lines) - 1)"), lambda x: x["spoken"]),
                TURN_SEPARATOR,
            ).alias("head"),
        )
    )
    whole = blocks.groupBy("conv_id").agg(
        F.sum("n").alias("n"),
        F.max("last").alias("last"),
        F.array_sort(F.collect_list(F.struct("block", "n", "head", "last"))).alias("parts"),
    )
    texts = F.flatten(
        F.transform(
            F.col("parts"),
            lambda p, i: F.concat(
                F.when(p["n"] > 1, F.array(p["head"])).otherwise(
                    F.array().cast("array<string>")
                ),
                F.when(
                    i < F.size("parts") - 1,
                    F.array(_spoken(p["last"]["speaker"], p["last"]["content"])),
                ).otherwise(F.array().cast("array<string>")),
            ),
        )
    )
    return whole.where(
        (F.col("n") >= F.lit(max(min_turns, 2))) & (F.col("last.speaker") == "Assistant")
    ).select(
        "conv_id",
        F.concat(F.array_join(texts, TURN_SEPARATOR), F.lit(PROMPT_END)).alias("prompt"),
        F.col("last.content").alias("response"),
    )


def example_parts(turns: DataFrame, min_turns: int = 2) -> DataFrame:
    """(conv_id, turn, text, last): what prompts and responses are made of, a row per turn.

    A prompt is the texts of all turns but the last, each with its separator, and the opening of
    the response; the last turn's text is the response. Only conversations that make an example
    are kept; no conversation is put together.
    """
    ends = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("turn", "speaker")).alias("_end")
    )
    usable = ends.where(
        (F.col("_n") >= F.lit(max(min_turns, 2))) & (F.col("_end.speaker") == "Assistant")
    ).select("conv_id", F.col("_end.turn").alias("_end"))
    joined = turns.join(usable, "conv_id")
    last = F.col("turn") == F.col("_end")
    spoken = F.concat(_spoken(F.col("speaker"), F.col("content")), F.lit(TURN_SEPARATOR))
    return joined.select(
        "conv_id", "turn", F.when(last, F.col("content")).otherwise(spoken).alias("text"),
        last.alias("last"),
    )


def _from_messages(df: DataFrame, key: str, min_turns: int) -> DataFrame:
    """Examples from a ``messages`` column of cleaned array<struct<..., speaker, content>>."""
    earlier = F.transform(
        F.expr("slice(messages, 1, size(messages) - 1)"),
        lambda m: _spoken(m["speaker"], m["content"]),
    )
    last = F.element_at("messages", -1)
    return df.where(
        (F.size("messages") >= max(min_turns, 2))
        & (F.get("messages", F.size("messages") - 1)["speaker"] == "Assistant")
    ).select(
        key,
        F.concat(F.array_join(earlier, TURN_SEPARATOR), F.lit(PROMPT_END)).alias("prompt"),
        last["content"].alias("response"),
    )


def parsed_messages(text: Column, role: str = "role", content: str = "content") -> Column:
    """Message list of a JSON text; null for anything that is not a list."""
    listed = F.ltrim(text).startswith("[")
    return F.when(
        listed, F.from_json(text, f"array<struct<`{role}`: string, `{content}`: string>>")
    )


def chat_array_examples(
    df: DataFrame,
    key: str,
    messages_field: str = "messages",
    role: str = "role",
    content: str = "content",
    min_turns: int = 2,
) -> DataFrame:
    """(key, prompt, response) from one message array per row: no shuffle, streams as well.

    Rows without a message list are skipped; null content counts as blank.
    """
    cleaned = F.filter(
        F.transform(
            F.col(messages_field),
            lambda m: F.struct(
                speaker(m[role]).alias("speaker"), as_text(m[content]).alias("content")
            ),
        ),
        lambda m: m["content"] != "",
    )
    listed = df.where(F.col(messages_field).isNotNull()).select(key, cleaned.alias("messages"))
    return _from_messages(listed, key, min_turns)


def message_arrays(turns: DataFrame) -> DataFrame:
    """Long rows (conv_id, turn, role, text) as one message array per conversation, by blocks."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    blocks = turns.groupBy("conv_id", F.expr(f"turn div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(message)).alias("part")
    )
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts")
    )
    joined = F.flatten(F.transform("parts", lambda p: p["part"]))
    return whole.select(
        "conv_id",
        F.transform(
            joined, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages"),
    )


def prompt_response_rows(
    df: DataFrame, key: str, prompt_field: str = "prompt", response_field: str = "response"
) -> DataFrame:
    """(key, prompt, response): cast to text, stripped, both sides non-blank."""
    return df.select(
        key,
        as_text(F.col(prompt_field)).alias("prompt"),
        as_text(F.col(response_field)).alias("response"),
    ).where("prompt <> '' and response <> ''")


def adjacent_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response): each user message with the assistant's next one.

    Conversations are cut into blocks of turns; the first turn of a block is also sent to the
    block before it. One shuffle, and no block holds more than BLOCK + 1 turns.
    """
    named = turns.select("conv_id", "turn", speaker(F.col("role")).alias("speaker"), "text")
    home = F.expr(f"turn div {BLOCK}")
    copies = named.withColumn(
        "block",
        F.explode(
            F.when(F.expr(f"turn % {BLOCK}") == 0, F.array(home, home - 1)).otherwise(
                F.array(home)
            )
        ),
    )
    order = Window.partitionBy("conv_id", "block").orderBy("turn")
    pairs = copies.select(
        "conv_id",
        "turn",
        "speaker",
        "block",
        F.col("text").alias("prompt"),
        F.lead("text").over(order).alias("response"),
        F.lead("turn").over(order).alias("next_turn"),
        F.lead("speaker").over(order).alias("next_speaker"),
    ).where(
        (F.col("block") == home)
        & (F.col("next_turn") == F.col("turn") + 1)
        & (F.col("speaker") == "Human")
        & (F.col("next_speaker") == "Assistant")
    )
    return prompt_response_rows(
        pairs.withColumn("key", F.struct("conv_id", "turn")), "key"
    ).select("key.conv_id", "key.turn", "prompt", "response")
