"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that
speaker as the assistant: its turns are trained on (mask 1), the others are named users
(mask 0) and system turns stay system turns (mask 0). A turn becomes

    <|role|>[ name=speaker]\\n text \\n<|end|>\\n

and only the text and the end mark of the assistant's turns are under the mask.

Participants are joined to the turns of their conversation, so a conversation with a
third of all turns is split by AQE like any skewed join. Dialogues come in segments of
``SEGMENT_TURNS`` turns: positions come from a distributed numbering, and a group is one segment
of one perspective, never a whole conversation.

Defined cases: a null role speaks as ``unknown``; null texts are empty; a conversation with
system turns only has no perspective; turns are ordered by turn, role and text (nulls
first); repeated rows are turns of their own; a text of any length is one turn of its segment; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import positions_within

SEGMENT_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"


def rotations(conversations: DataFrame) -> DataFrame:
    """A row per turn and perspective: conv_id, perspective, turn, speaker, chat_role, head, body, mask."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = turns.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    both = turns.join(people, turns["conv_id"].eqNullSafe(people["__conv"])).drop("__conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    return both.select(
        "conv_id", "perspective", "turn", "speaker", role.alias("chat_role"), head(role, F.col("speaker")).alias("head"),
        F.concat("text", F.lit("\n<|end|>\n")).alias("body"), own.cast("int").alias("mask"))


def head(role: Column, speaker: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>"), F.when(role == "user", F.concat(F.lit(" name="), speaker)).otherwise(F.lit("")), F.lit("\n"))


def dialogues(conversations: DataFrame) -> DataFrame:
    """Rendered segments: conv_id, perspective, segment, n_turns, text, spans (start and end in code points of trained text)."""
    # the position of a turn is the same for every perspective, so turns are numbered before they are rotated
    turns = conversations.select("conv_id", "turn", "role", "text")
    placed = positions_within(turns.withColumn("__no_id", F.col("conv_id").isNull()).fillna({"conv_id": 0}), ["__no_id", "conv_id"], ["turn", "role", "text"])
    placed = placed.withColumn("conv_id", F.when(~F.col("__no_id"), F.col("conv_id"))).withColumn("turn", F.col("position"))
    rotated = rotations(placed)
    segment = F.floor(F.col("turn") / SEGMENT_TURNS).alias("segment")
    item = F.struct("turn", F.concat("head", "body").alias("text"), F.length("head").alias("skip"), "mask")
    grouped = rotated.groupBy("conv_id", "perspective", segment).agg(F.sort_array(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + F.length(x["text"])).alias("at"),
        F.when(x["mask"] == 1, F.concat(a["spans"], F.array(F.struct((a["at"] + x["skip"]).alias("start"), (a["at"] + F.length(x["text"])).alias("end")))))
        .otherwise(a["spans"]).alias("spans"))
    return grouped.select(
        "conv_id", "perspective", "segment", F.size("items").cast("long").alias("n_turns"),
        F.array_join(F.transform("items", lambda x: x["text"]), "").alias("text"),
        F.aggregate("items", zero, step, lambda a: a["spans"]).alias("spans"))


def digest(conversations: DataFrame) -> DataFrame:
    """Per segment: turns, rendered characters, trained characters and spans, SHA-256 of the text."""
    rendered = dialogues(conversations)
    trained = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return rendered.select(
        "conv_id", "perspective", "segment", "n_turns", F.length("text").cast("long").alias("n_chars"),
        trained.cast("long").alias("n_trained"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '{UNKNOWN}') AS speaker, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position FROM conversations),
people AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM turns WHERE speaker <> '{SYSTEM}'),
rotated AS (SELECT conv_id, perspective, position, CASE WHEN speaker = '{SYSTEM}' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
  ELSE '<|user|> name=' || speaker || chr(10) END AS head, text || chr(10) || '<|end|>' || chr(10) AS body, speaker = perspective AS mask
  FROM turns JOIN people ON conv_id IS NOT DISTINCT FROM conv)
SELECT conv_id, perspective, position // {SEGMENT_TURNS} AS segment, count(*) AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars,
  coalesce(sum(length(body)) FILTER (mask), 0)::BIGINT AS n_trained, count(*) FILTER (mask) AS n_spans, sha256(string_agg(head || body, '' ORDER BY position)) AS text_sha256
FROM rotated GROUP BY conv_id, perspective, position // {SEGMENT_TURNS}
"""
