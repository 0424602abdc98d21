"""Chat transcripts ``(conv_id, turn, role, text)`` folded into model requests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import SEGMENT, total_before

# Request defaults.
TEMPERATURE = 0.1
MAX_OUTPUT_TOKENS = 2048


def _is(role: str) -> Column:
    return F.col("role") == role


def fold_chat(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Messages ``(conv_id, at_turn, role, text)`` in the alternating form a model expects.

    User texts between two assistant turns join into one message. System texts, each with a
    line break, go in front of the next user message, once; without one they are dropped.
    Every assistant turn is a ``model`` message. ``at_turn`` is the message's last turn.

    Message numbers come from totals over segments of a conversation, so one that owns most of the turns is spread over tasks.
    """
    said = _numbered_in_segments(turns, segment)
    user_messages = (
        said.groupBy("conv_id", "message")
        .agg(
            F.max(F.when(_is("user"), F.col("turn"))).alias("at_turn"),
            F.expr("listagg(case when role = 'system' then text || '\n' end, '') within group (order by turn)").alias("_head"),
            F.expr("listagg(case when role = 'user' then text end, '\n') within group (order by turn)").alias("_body"),
        )
        .filter(F.col("at_turn").isNotNull())
        .select(
            "conv_id",
            "at_turn",
            F.lit("user").alias("role"),
            F.concat(F.coalesce("_head", F.lit("")), F.coalesce("_body", F.lit(""))).alias("text"),
        )
    )
    model_messages = turns.filter(_is("assistant")).select(
        "conv_id", F.col("turn").alias("at_turn"), F.lit("model").alias("role"), "text"
    )
    return user_messages.unionByName(model_messages)


def _numbered_in_segments(turns: DataFrame, segment: int) -> DataFrame:
    """System and user turns with the number of the user message they belong to; texts move only for the last join."""
    narrow = turns.select("conv_id", "turn", "role")
    numbered = total_before(narrow, ["conv_id"], "turn", _is("assistant").cast("int"), "block", segment).filter(~_is("assistant"))
    blocks = numbered.groupBy("conv_id", "block").agg(F.max(_is("user").cast("int")).alias("asked"))
    messages = total_before(blocks, ["conv_id"], "block", F.col("asked"), "message", segment)
    placed = numbered.join(messages.drop("asked"), ["conv_id", "block"]).select("conv_id", "turn", "message")
    return turns.filter(F.col("role").isin("system", "user")).join(placed, ["conv_id", "turn"])


def chat_payload(
    turns: DataFrame,
    temperature: float = TEMPERATURE,
    max_output_tokens: int = MAX_OUTPUT_TOKENS,
    segment: int = SEGMENT,
) -> DataFrame:
    """``(conv_id, part, payload)``: the JSON request of each conversation.

    A conversation is one part unless it runs over ``segment`` turns; the parts of a longer
    one, joined in order, are its request. So no task ever gathers an endless conversation.
    """
    message = F.to_json(F.struct("role", F.array(F.struct("text")).alias("parts")))
    parts = (
        fold_chat(turns, segment)
        .select("conv_id", F.floor(F.col("at_turn") / segment).cast("bigint").alias("part"), "at_turn", message.alias("_json"))
        .groupBy("conv_id", "part")
        .agg(F.expr("listagg(_json, ',') within group (order by at_turn)").alias("_body"))
    )
    along = Window.partitionBy("conv_id").orderBy("part")  # one row a part: few even for a long conversation
    parts = parts.withColumns({"_first": F.lag("part").over(along).isNull(), "_last": F.lead("part").over(along).isNull()})
    config = json.dumps({"temperature": temperature, "maxOutputTokens": max_output_tokens}, separators=(",", ":"))
    return parts.select(
        "conv_id",
        "part",
        F.concat(
            F.when(F.col("_first"), '{"contents":[').otherwise(","),
            F.col("_body"),
            F.when(F.col("_last"), f'],"generationConfig":{config}' + "}").otherwise(""),
        ).alias("payload"),
    )


def parse_response(responses: DataFrame, column: str, path: str = "$.candidates[0].content.parts[0].text") -> DataFrame:
    """Add ``answer`` and ``error`` read from a JSON response column."""
    answer = F.get_json_object(F.col(column), path)
    return responses.withColumns(
        {"answer": answer, "error": F.when(answer.isNull(), F.lit(f"Failed to parse response: no {path}"))}
    )


def read_path(df: DataFrame, column: str, path: str, name: str, dtype: T.DataType | str = "string") -> DataFrame:
    return df.withColumn(name, F.get_json_object(F.col(column), path).try_cast(dtype))
