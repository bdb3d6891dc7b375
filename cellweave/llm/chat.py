"""Chat formatting of logged conversations, with cumulative snapshots collapsed. DataFrame functions only.

A service that logs a conversation after every turn leaves many conversations that are prefixes of a longer one. Every
turn of a conversation gets the rolling hash of all turns up to it. A conversation whose last rolling hash is the hash
of an inner prefix of another one is contained in that one; an anti-join keeps the maximal conversations, and of equal
conversations the one with the smallest id. Only these are rendered.

The rolling hash is a pair of sums over the turns, each of a 64-bit hash of (place in the conversation, role, text).
Places come from one range sort of all turns, and a conversation is cut into blocks of a fixed number of places, whatever
its turn numbers are. Sums add up over blocks: a window runs inside a block, and another over the block totals, so that a
conversation with a third of all rows is spread over many tasks. Rendered text comes in segments, one per block, for the
same reason; a usual conversation is one segment.

Defined results: rows that repeat exactly are one turn; different rows with the same turn number are turns in the order
of role and text hash; a null turn comes first; a null role is rendered as ``unknown``, a null text as empty, and both
differ from these strings when prefixes are compared; rows with a null id are one conversation, which no other one
replaces unless it holds it; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import load
from cellweave.operators.scale import global_row_number
from cellweave.session import cut_lineage

BLOCK_TURNS = 1_024
OPEN, CLOSE = "<|{role}|>\n", "\n<|end|>\n"


def _text_key() -> Column:
    return F.struct(F.xxhash64("text", F.lit(1)).alias("a"), F.xxhash64(F.lit(2), "text").alias("b"), F.col("text").isNull().alias("n"))


def rolling_hashes(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, turn, role, text_key, block, place, h1, h2): h1 and h2 identify all turns up to this one."""
    distinct = turns.select("conv_id", "turn", "role", _text_key().alias("text_key")).distinct()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text_key.a", "text_key.b", "text_key.n")]
    ranked = global_row_number(distinct, order, "rank").withColumn("conv", F.struct("conv_id"))
    first = ranked.groupBy("conv").agg(F.min("rank").alias("first"))
    placed = ranked.join(first, "conv").withColumn("place", F.col("rank") - F.col("first") + 1).drop("rank", "first")
    placed = placed.withColumn("block", F.floor((F.col("place") - 1) / F.lit(block_turns)).cast("bigint"))
    of_turn = [
        F.xxhash64(F.lit(seed), "place", F.coalesce("role", F.lit("")), F.col("role").isNull(), "text_key").cast("decimal(38,0)")
        for seed in ("first", "second")
    ]
    running = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({"t1": of_turn[0], "t2": of_turn[1]}).withColumns(
        {"s1": F.sum("t1").over(running), "s2": F.sum("t2").over(running)}
    )
    totals = summed.groupBy("conv", "block").agg(F.sum("t1").alias("t1"), F.sum("t2").alias("t2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    starts = totals.select(
        "conv", "block", F.coalesce(F.sum("t1").over(before), zero).alias("b1"), F.coalesce(F.sum("t2").over(before), zero).alias("b2")
    )
    return summed.join(starts, ["conv", "block"]).select(
        "conv_id", "turn", "role", "text_key", "block", "place",
        (F.col("b1") + F.col("s1")).cast("decimal(38,0)").alias("h1"), (F.col("b2") + F.col("s2")).cast("decimal(38,0)").alias("h2"),
    )


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """Distinct conv_id of the conversations that are no prefix of another one, one of each set of equals."""
    last = hashes.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("last"))
    ends = last.select("conv_id", F.col("last.place").alias("place"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"))
    one = ends.groupBy("place", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"))
    lengths = last.select(F.struct("conv_id").alias("conv"), F.col("last.place").alias("n"))
    inner = (
        hashes.withColumn("conv", F.struct("conv_id"))
        .join(lengths, "conv")
        .where("place < n")
        .select("place", "h1", "h2")
        .distinct()
    )
    return one.join(inner, ["place", "h1", "h2"], "left_anti").select(F.col("first.conv_id").alias("conv_id"))


def render_turn(role: Column, text: Column) -> Column:
    begin, end = OPEN.split("{role}")
    return F.concat(F.lit(begin), F.coalesce(role, F.lit("unknown")), F.lit(end), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def format_chats(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """(conv_id, segment, n_turns, chat): the maximal conversations, rendered turn by turn."""
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    hashes = cut_lineage(rolling_hashes(turns, block_turns))
    kept = maximal_conversations(hashes).select(F.struct("conv_id").alias("conv"))
    turn_key = F.struct("conv_id", "turn", "role", "text_key").alias("key")
    places = hashes.select(F.struct("conv_id").alias("conv"), turn_key, "block", "place").join(kept, "conv", "left_semi")
    texts = turns.withColumn("text_key", _text_key()).select(turn_key, render_turn(F.col("role"), F.col("text")).alias("chat"))
    # repeated rows have one place and one text: the set holds them once, in each task already
    held = texts.join(places, "key").groupBy("conv", "block")
    segments = held.agg(F.array_sort(F.collect_set(F.struct("place", "chat"))).alias("items"))
    first = Window.partitionBy("conv").orderBy("block")
    return segments.select(
        F.col("conv.conv_id").alias("conv_id"),
        F.row_number().over(first).alias("segment"),
        F.size("items").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("items", lambda i: i["chat"]), "").alias("chat"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"))


#: Prefixes as whole strings; turn numbers do not repeat within a conversation of the test tables.
SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, turn, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix,
             lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM t),
kept AS (SELECT min(conv_id) AS conv_id FROM p WHERE last AND prefix NOT IN (SELECT prefix FROM p WHERE NOT last) GROUP BY prefix)
SELECT conv_id, 1 AS segment, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn) AS chat
FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
