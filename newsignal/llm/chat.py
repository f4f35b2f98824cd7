"""Multi-party perspective rotation of dialogues, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns of one rendered chunk at most, so that no conversation has to fit in one row or task.
CHUNK_TURNS = 64
#: Roles that frame a dialogue and never speak in it.
FRAME_ROLES = ("system",)


def rotate_perspectives(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """For every participant of every conversation, the dialogue as that speaker would have it.

    The speaker becomes ``assistant`` and its turns are trained on; every other participant
    becomes a ``user`` with its own name; ``system`` turns stay as they are.  A conversation is
    rendered in chunks of consecutive turn numbers (``turn div chunk_turns``), which is one chunk
    for any usual dialogue and keeps every group bounded for one of any length.

    Result, one row per conversation, perspective and chunk: conv_id, perspective, chunk,
    n_turns, n_target_turns, rendered (the turns between ``<|im_start|>`` and ``<|im_end|>``),
    target_spans (array of start and end, in characters of ``rendered``, of what is trained on:
    the speaker's texts with their end mark), mask (one 0 or 1 per turn, in order).

    Cases: a null role is the participant ``unknown``, in every perspective named so; a null text
    is an empty one; a null turn stands before turn 0, in a chunk of its own; rows of one turn
    are ordered by role and text, and repeated rows are all rendered; null conversations are one
    conversation.  A conversation of system turns alone has no participant and no row.  Columns
    beyond conv_id, turn, role and text are ignored.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # Chunks of bounded size first; then the few distinct participants of a conversation.
    chunked = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-1)))
    people = (
        rows.filter(~F.col("role").isin(*FRAME_ROLES)).groupBy("conv_id", "role").agg(F.count("*").alias("turns_taken"))
        .select(F.col("conv_id").alias("p_conv"), F.col("role").alias("perspective"))
    )
    chunks = chunked.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pairs = chunks.join(people, chunks["conv_id"].eqNullSafe(people["p_conv"])).drop("p_conv")
    me = F.col("perspective")
    mine = lambda t: t["role"] == me
    head = lambda t: (
        F.when(t["role"].isin(*FRAME_ROLES), F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n")))
        .when(mine(t), F.lit("<|im_start|>assistant\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), t["role"], F.lit("\n")))
    )
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(head(t), t["text"], F.lit("<|im_end|>\n")).alias("segment"), mine(t).cast("int").alias("on"),
        F.length(head(t)).alias("skip"),
    ))
    shown = pairs.withColumn("parts", parts)
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["segment"])).alias("at"),
            F.when(p["on"] == 1, F.concat(a["spans"], F.array(F.struct((a["at"] + p["skip"]).alias("start"), (a["at"] + F.length(p["segment"]) - 1).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return shown.select(
        "conv_id", "perspective", F.col("chunk").cast("long").alias("chunk"), F.size("parts").cast("long").alias("n_turns"),
        F.aggregate("parts", F.lit(0), lambda a, p: a + p["on"]).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("rendered"),
        spans.alias("target_spans"),
        F.transform("parts", lambda p: p["on"]).alias("mask"),
    )


#: The digest columns of the query, for DuckDB.
ORACLE_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn // 64 AS chunk FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
x AS (
  SELECT r.conv_id, p.perspective, r.chunk, r.turn, r.role, r.text,
         CASE WHEN r.role = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN r.role = p.perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || r.role || chr(10) END AS head
  FROM r JOIN p USING (conv_id)),
y AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment, CASE WHEN role = perspective THEN 1 ELSE 0 END AS m,
         sum(length(head || text || '<|im_end|>' || chr(10))) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM x)
SELECT conv_id, perspective, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_turns, CAST(sum(m) AS BIGINT) AS n_target_turns,
       string_agg(segment, '' ORDER BY turn, role, text) AS rendered,
       string_agg(CAST(m AS VARCHAR), '' ORDER BY turn, role, text) AS mask,
       coalesce(string_agg(CASE WHEN m = 1 THEN CAST(CAST(stop AS BIGINT) - length(segment) + length(head) AS VARCHAR) || '-' || CAST(CAST(stop AS BIGINT) - 1 AS VARCHAR) END, ' ' ORDER BY turn, role, text), '') AS target_spans
FROM y GROUP BY conv_id, perspective, chunk
"""


def op4_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    """All conversations in all perspectives; mask and spans as text, so that SQL can hold them."""
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumn("mask", F.array_join("mask", "")).withColumn(
        "target_spans", F.array_join(F.transform("target_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    )
