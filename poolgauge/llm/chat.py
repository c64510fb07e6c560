"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

A logger that stores a conversation after every turn leaves snapshots that are
prefixes of longer logs. Every turn gets the rolling hash of the turns up to
it; a conversation whose whole hash is the hash of a *proper* prefix of another
one is anti-joined away, of equal conversations the smallest conv_id stays,
and only these maximal conversations are rendered.

The rolling hash is the exclusive-or of one 128-bit hash per turn of (turn,
place among equal turn numbers, role, text), so it can be carried over blocks
of :data:`BLOCK_TURNS` turn numbers: no window and no rendered part ever holds
more than a block, however long a conversation is.

Scale: prefix hashes are made distinct on the map side before they meet the
whole hashes, so an opening that a third of all logs share is one row; texts
are shuffled by (conv_id, block). A conversation is rendered in parts of a
block each, in order of ``part``.

Defined cases: a turn stored twice (same conv_id, turn, role, text) counts
once; turns of equal number are ordered by role and text, nulls first; a null
turn number comes last, in a block of its own; a null role is rendered as
``unknown`` and a null text as empty, and both differ from those values in the
hash; a turn without a conv_id is a conversation of its own, so such rows are
never gathered, and equal ones are one. A snapshot must number
its turns as the longer log does. Control marks inside a text are broken up so
that no text can open or close a turn. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.llm.common import cut

BLOCK_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Distinct turns with ``block``, the hashes ``g1`` and ``g2`` of each and ``at``, its place in the block."""
    number = F.col("turn").cast("long")
    rows = conversations.select("conv_id", number.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(2**62)))
    # 128 bits of a turn without conversation stand for its conv_id
    own = [F.when(F.col("conv_id").isNull(), F.xxhash64(F.lit(k), *[x for c in ("turn", "role", "text") for x in (F.col(c).isNull(), F.col(c))])) for k in ("a", "b")]
    rows = rows.withColumn("conv", F.struct("conv_id", own[0].alias("own_a"), own[1].alias("own_b")))
    order = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_last("turn"), "role", "text")
    same = [F.lag(c).over(order).eqNullSafe(F.col(c)) for c in ("turn", "role", "text")]
    rows = rows.withColumn("again", (F.row_number().over(order) > 1) & same[0] & same[1] & same[2]).where(~F.col("again")).drop("again")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("tie", F.row_number().over(Window.partitionBy("conv", "block", "turn").orderBy("role", "text")))
    parts = [F.coalesce("turn", F.lit(-(2**62))), F.col("tie"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return rows.select("conv", "block", "at", "turn", "role", "text", F.xxhash64(*parts).alias("g1"), F.xxhash64(F.lit("turn"), *parts).alias("g2"))


def prefixes(hashed: DataFrame) -> DataFrame:
    """conv, block, at, n (turns up to here), last, h1 and h2 (rolling hash up to here) of every turn."""
    blocks = hashed.groupBy("conv", "block").agg(F.count("*").alias("own"), F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    carried = blocks.select("conv", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("n0"), F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("c1"), F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("c2"), F.sum("own").over(whole).alias("size"))
    inside = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv", "block", "at", F.bit_xor("g1").over(inside).alias("r1"), F.bit_xor("g2").over(inside).alias("r2"))
    met = rolled.join(carried, ["conv", "block"])
    n = F.col("n0") + F.col("at")
    return met.select("conv", "block", "at", n.alias("n"), (n == F.col("size")).alias("last"), F.col("r1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("h2"))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv and n of the conversations that no longer one begins with, the first of equal ones (one without conv_id last)."""
    key = ["n", "h1", "h2"]
    whole = rolled.where("last").groupBy(*key).agg(F.min(F.struct(F.col("conv.conv_id").isNull().alias("none"), "conv"))["conv"].alias("conv"))
    inner = rolled.where(~F.col("last")).select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv", "n")


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), _safe(text), F.lit(CLOSE + "\n"))


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per part of each maximal conversation: conv_id, part (from 0), n_turns of the whole, text of the part."""
    hashed = turns(conversations, block_turns)
    kept = cut(maximal(prefixes(cut(hashed.select("conv", "block", "at", "g1", "g2"))))).withColumnRenamed("n", "n_turns")
    piece = F.struct("at", rendered_turn(F.col("role"), F.col("text")).alias("said"))
    parts = hashed.groupBy("conv", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["said"]), "").alias("text"))
    parts = parts.join(kept, "conv")
    return parts.select(F.col("conv.conv_id").alias("conv_id"), (F.row_number().over(Window.partitionBy("conv").orderBy("block")) - 1).cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "text")
