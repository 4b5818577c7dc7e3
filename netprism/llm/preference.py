"""Chat formatting (10): preference pairs with the common prefix rendered once.

A pair has a chosen and a rejected conversation.  Turn by turn (same role and
text), their longest common prefix is found: the smallest turn at which they
differ.  Turns before it are rendered once, as the prompt; from it on each
side is rendered on its own as a completion.  The result is in long form, one
rendered segment per row with its loss mask: 1 for what the assistant says in
a completion, 0 for the prompt, other roles and turn headers.  So a
conversation of any length stays spread over rows, and pairs are never
collected; ``examples`` joins the segments of short ones.

Edge cases: null pair ids or turns belong to no conversation and are left
out; a null role or text counts as empty; a turn that is given several times
counts once (the smallest by role and text); pairs whose sides do not differ
have a prompt only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def preference_segments(turns: DataFrame) -> DataFrame:
    """Segments of ``turns(pair_id, side, turn, role, text)``, side 'chosen' or
    'rejected': pair_id, part (prompt, chosen, rejected), turn, header, text,
    and mask."""
    empty = F.lit("")
    said = F.struct(F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    sides = stored(
        turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("pair_id", "turn")
        .agg(F.min(F.when(F.col("side") == "chosen", said)).alias("chosen"),
             F.min(F.when(F.col("side") == "rejected", said)).alias("rejected")), "sides")
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    prefix = stored(sides.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("fork")), "forks")
    marked = sides.join(prefix, "pair_id")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
        F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("part"), F.col(s).alias("said")))
                                  for s in ("chosen", "rejected")])))
    rows = marked.select("pair_id", "turn", F.inline(parts))
    return rows.select(
        "pair_id", "part", "turn", F.concat(F.lit("<|"), F.col("said.role"), F.lit("|>\n")).alias("header"),
        F.concat(F.col("said.text"), F.lit("\n")).alias("text"),
        F.when((F.col("part") != "prompt") & (F.col("said.role") == "assistant"), 1).otherwise(0).alias("mask"))


def swapped_replies(conversations: DataFrame, step: int = 1) -> DataFrame:
    """Pairs from plain conversations: chosen is the whole conversation; rejected has its turns before its first
    assistant turn and then those of conversation ``conv_id + step`` from that one's first assistant turn on,
    numbered to follow.  So every turn of every conversation stands in its own pair, and the sides part wherever
    they begin to differ.  A conversation without an assistant turn is its own rejected side
    (nothing to prefer); one without a partner has an empty rejected completion.
    Of a turn that is given several times the smallest by role and text counts."""
    empty = F.lit("")
    said = F.struct(F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
                                said.alias("said")).where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    turns = stored(rows.groupBy("pair_id", "turn").agg(F.min("said").alias("said"))
                   .select("pair_id", "turn", "said.role", "said.text"), "turns")
    first = stored(turns.where(F.col("role") == "assistant").groupBy("pair_id").agg(F.min("turn").alias("_at")), "replies")
    own = turns.join(first, "pair_id", "left")
    kept = own.where(F.col("_at").isNull() | (F.col("turn") < F.col("_at")))
    after = own.where(F.col("turn") >= F.col("_at")).select(
        (F.col("pair_id") - step).alias("pair_id"), (F.col("turn") - F.col("_at")).alias("_on"), "role", "text")
    taken = after.join(first, "pair_id").withColumn("turn", F.col("_at") + F.col("_on"))
    columns = ["pair_id", "turn", "role", "text"]
    rejected = kept.select(columns).unionByName(taken.select(columns))
    return (turns.withColumn("side", F.lit("chosen")).unionByName(rejected.withColumn("side", F.lit("rejected")))
            .select("pair_id", "side", "turn", "role", "text"))


def examples(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, and for either side a list of (text, mask)
    with headers unmasked.  A pair is collected into its row."""
    piece = F.struct("turn", "header", "text", "mask")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("part") == s, piece)))
    got = segments.groupBy("pair_id").agg(side("prompt").alias("p"), side("chosen").alias("c"), side("rejected").alias("r"))
    masked = lambda c: F.flatten(F.transform(c, lambda x: F.array(
        F.struct(x["header"].alias("text"), F.lit(0).alias("mask")), F.struct(x["text"].alias("text"), x["mask"].alias("mask")))))
    return got.select("pair_id", F.array_join(F.transform("p", lambda x: F.concat(x["header"], x["text"])), "").alias("prompt"),
                      masked(F.col("c")).alias("chosen"), masked(F.col("r")).alias("rejected"))
