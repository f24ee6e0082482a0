"""Chat formatting of logs that hold growing snapshots of the same conversations.

A logged conversation that equals the beginning of a longer one is a snapshot of it, and of equal ones the smallest
id stays. Every turn gets two 64-bit hashes of its place, role and text; their running exclusive-or within the
conversation names the prefix that ends there. Conversations whose own prefix is a shorter prefix of another one are
removed by an anti-join on place and hashes; the rest is rendered, a row per turn.

A conversation is worked on in runs of ``RUN`` turn numbers, whose counts and hashes are added up between runs, so one
that holds a third of all rows is no single task's work. Prefixes that many conversations share (a common first
turn) are made distinct before the join, with partial aggregation; equal conversations are grouped the same way.

Only DataFrame functions are used. Defined results: turns are ordered by number, role, text, nulls first; repeated rows
are turns of their own. Rows without ``conv_id`` belong to no conversation and are left out. A null role is rendered
as ``unknown``, a null text as empty; both differ from the same words given. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

RUN = 1024
#: The markers around a rendered turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn_hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")),
                      F.col("text").isNull(), F.coalesce("text", F.lit("")))


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place from 1, role, text) and the hashes ``a`` and ``b`` of the prefix that ends at each."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        F.floor(F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)) / RUN).alias("run"))
    own = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    local = turns.withColumn("place", F.row_number().over(own).cast("bigint"))
    sizes = turns.groupBy("conv_id", "run").agg(F.count("*").alias("n"))
    offset = sizes.withColumn("offset", F.sum("n").over(before)).where("offset IS NOT NULL").drop("n")
    whole = local.join(offset, ["conv_id", "run"], "left").withColumn("place", F.col("place") + F.coalesce("offset", F.lit(0)))
    hashed = stage(whole.select("conv_id", "run", "place", "role", "text", _turn_hash(1).alias("ha"), _turn_hash(2).alias("hb")),
                   "chat-turns")
    sums = hashed.groupBy("conv_id", "run").agg(F.bit_xor("ha").alias("ra"), F.bit_xor("hb").alias("rb"))
    earlier = sums.withColumn("ea", F.bit_xor("ra").over(before)).withColumn("eb", F.bit_xor("rb").over(before)).where(
        "ea IS NOT NULL").drop("ra", "rb")
    upto = Window.partitionBy("conv_id", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = hashed.select("conv_id", "run", "place", "ha", "hb").withColumn("a", F.bit_xor("ha").over(upto)).withColumn(
        "b", F.bit_xor("hb").over(upto)).join(earlier, ["conv_id", "run"], "left")
    prefixes = running.select("conv_id", "place", F.col("a").bitwiseXOR(F.coalesce("ea", F.lit(0))).alias("a"),
                              F.col("b").bitwiseXOR(F.coalesce("eb", F.lit(0))).alias("b"))
    return hashed.select("conv_id", "place", "role", "text"), stage(prefixes, "chat-prefixes")


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that begin no longer one, the smallest id of equal ones."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "a", "b")).alias("e"))
    heads = ends.groupBy("e.place", "e.a", "e.b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.join(ends.select("conv_id", F.col("e.place").alias("n")), "conv_id").where("place < n").select(
        "place", "a", "b").distinct()
    return heads.join(inner, ["place", "a", "b"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """Per turn of a kept conversation: conv_id, place, n_turns, n_copies, rendered."""
    turns, prefixes = placed(conversations)
    kept = stage(maximal(prefixes), "chat-kept")
    return turns.join(kept, "conv_id").select(
        "conv_id", "place", "n_turns", "n_copies",
        F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(MIDDLE), F.coalesce("text", F.lit("")),
                 F.lit(CLOSE)).alias("rendered"))
