"""Preference formatting: the common turns of a chosen and a rejected conversation once as prompt, the rest as masked completions.

A turn is rendered as <|role|>, newline, text, newline. The longest common turn prefix becomes the prompt; what follows on each side becomes its
completion, with the character ranges that carry loss (texts of the trained role, with their final newline). Everything is an
ordered aggregate of a pair's own turns and array expressions; a pair is the smallest unit a trainer reads.

Rows: a null pair or side is left out; null roles and texts count as empty; turns that share a number are ordered by role and text, a null turn
comes first; repeated rows are turns of their own; a pair without one side has an empty completion there; equal
conversations give two empty completions; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column, role: str) -> Column:
    """Ranges (start, end) in the joined turns: after each trained turn's header to its end."""
    empty = F.array().cast("array<struct<start:long,end:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(x: Column, t: Column) -> Column:
        end = (x["at"] + F.length(rendered(t))).cast("long")
        span = F.struct((x["at"] + F.length(t["role"]) + 5).cast("long").alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(x["spans"], F.array(span))).otherwise(x["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda x: x["spans"])


def formatted(sides: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """From rows (pair_id, side 'chosen' or 'rejected', turn, role, text): pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    text = lambda c: F.coalesce(sides[c].cast("string"), F.lit(""))
    rows = sides.select("pair_id", "side", F.struct(sides["turn"].cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    side = lambda x: F.array_sort(F.collect_list(F.when(F.col("side") == x, F.col("t")))).alias(x)
    known = F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")
    pairs = rows.where(known).groupBy("pair_id").agg(side("chosen"), side("rejected"))
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(c)
    pairs = pairs.select("pair_id", plain("chosen"), plain("rejected"))
    differ = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: ~z["chosen"].eqNullSafe(z["rejected"]))
    at = F.array_position(differ, True)
    pairs = pairs.withColumn("n_prefix", F.when(at == 0, F.size("chosen").cast("long")).otherwise(at - 1))
    rest = lambda c: F.slice(c, (F.col("n_prefix") + 1).cast("int"), F.size(c))
    pairs = pairs.select("pair_id", "n_prefix", F.slice("chosen", F.lit(1), F.col("n_prefix").cast("int")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return pairs.select("pair_id", "n_prefix", _joined(F.col("p")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _joined(F.col("r")).alias("rejected"), _mask(F.col("c"), trained).alias("chosen_mask"), _mask(F.col("r"), trained).alias("rejected_mask"))


def swapped_replies(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Preference sides from plain conversations: a conversation against itself with the last reply of its neighbour (conv_id with the lowest bit flipped).

    Conversations that have no reply, or whose neighbour has none, give no pair.
    """
    turns = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), conversations["role"].cast("string").alias("role"), conversations["text"].cast("string").alias("text"))
    last = turns.where(F.col("role") == trained).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    pairs = last.select("conv_id", F.col("last.turn").alias("last"), F.col("last.text").alias("own")).join(other, "conv_id")
    both = turns.join(pairs, "conv_id")
    is_last = (F.col("role") == trained) & F.col("turn").eqNullSafe(F.col("last")) & F.col("text").eqNullSafe(F.col("own"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text")))
    rows = both.select("conv_id", "turn", "role", F.explode(sides).alias("s"))
    return rows.select(F.col("conv_id").alias("pair_id"), "s.side", "turn", "role", "s.text")
