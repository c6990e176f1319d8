"""Operators along a sequence of steps, frames or turns: windows instead of loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_marker_distance(df: DataFrame, trace: Sequence[str], order: Sequence[str], marker: Column, out: str = "hops") -> DataFrame:
    """Steps to the nearest marked row from here on; null if none follows. For stack frames, outer to inner, this is the hop distance."""
    w = Window.partitionBy(*trace).orderBy(*order)
    df = df.withColumn("__p", F.row_number().over(w))
    near = F.min(F.when(marker, F.col("__p"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.withColumn(out, (near - F.col("__p")).cast("int")).drop("__p")


def minimal_hops(df: DataFrame, instance: str, node: str, hops: str = "hops") -> DataFrame:
    return df.where(F.col(hops).isNotNull()).groupBy(instance, node).agg(F.min(hops).alias("hop_distance"))


def normalised_hops(nodes: DataFrame, instance: str, hops: str, is_test: Column) -> DataFrame:
    """hop_max and normalized_distance; test nodes lie at the far end."""
    top = F.greatest(F.lit(1), F.max(hops).over(Window.partitionBy(instance)))
    return nodes.withColumn("hop_max", top).withColumn(hops, F.when(is_test, F.col("hop_max")).otherwise(F.col(hops))).withColumn("normalized_distance", F.col(hops) / F.col("hop_max"))


def prefix_segments(df: DataFrame, trajectory: Sequence[str], order: Sequence[str], prompt: str, response: str, out: str = "segment") -> DataFrame:
    """Steps whose prompt continues the step before's prompt and response share a segment.

    After a step the open sequence is that step's prompt and response, so the test needs one row back.
    """
    w = Window.partitionBy(*trajectory).orderBy(*order)
    seq = F.concat(prompt, response)
    df = df.withColumn("__seq", seq).withColumn("__prev", F.lag("__seq").over(w))
    joined = F.col("__prev").isNotNull() & (F.slice(prompt, F.lit(1), F.size("__prev")) == F.col("__prev"))
    df = df.withColumn("__break", F.when(joined, 0).otherwise(1))
    return df.withColumn(out, (F.sum("__break").over(w) - 1).cast("int")).drop("__seq", "__prev", "__break")


def assembled(df: DataFrame, trajectory: Sequence[str], order: Sequence[str], prompt: str, response: str) -> DataFrame:
    """Steps before the first break, and whether the whole trajectory is one sequence."""
    seg = prefix_segments(df, trajectory, order, prompt, response)
    return seg.withColumn("whole", F.max("segment").over(Window.partitionBy(*trajectory)) == 0).where("segment = 0").drop("segment")


def is_cumulative(df: DataFrame, trajectory: Sequence[str], order: Sequence[str], messages: str) -> DataFrame:
    """trajectory, cumulative: every step's messages extend those of the step before."""
    prev = F.lag(messages).over(Window.partitionBy(*trajectory).orderBy(*order))
    ok = prev.isNull() | (F.slice(messages, F.lit(1), F.size(prev)) == prev)
    return df.withColumn("__ok", ok).groupBy(*trajectory).agg(F.bool_and("__ok").alias("cumulative"))


def sft_samples(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A sample for each assistant turn: the turn as target, earlier system, user and assistant turns as context.

    Turns of one conversation stay in order within their array, so each conversation is one row and no frame is
    copied for every turn until the samples are made.
    """
    known = turns.where(F.col(role).isin("system", "user", "assistant"))
    conv = known.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    samples = F.filter(
        F.transform("m", lambda x, i: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["content"].alias("target"), F.slice("m", F.lit(1), i).alias("context"))),
        lambda s: s["role"] == "assistant",
    )
    return conv.select(conversation, F.explode(samples).alias("s")).select(conversation, F.col("s.turn").alias(turn), F.col("s.target").alias("target"), F.col("s.context").alias("context"))


def recent_messages(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The last assistant turn and the user and tool turns after it."""
    last = F.max(F.when(F.col(role) == "assistant", F.col(turn))).over(Window.partitionBy(conversation))
    return turns.withColumn("__last", last).where((F.col(turn) == F.col("__last")) | ((F.col(turn) > F.coalesce("__last", F.lit(-1))) & F.col(role).isin("user", "tool"))).drop("__last")


def maximal_sequences(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Distinct sequences of a key that are no proper subsequence of a longer one of the same key."""
    d = df.select(key, sequence).dropDuplicates().withColumn("__n", F.size(sequence))
    long_ = d.select(F.col(key).alias("__k"), F.col(sequence).alias("__long"), F.col("__n").alias("__m"))
    walked = F.aggregate("__long", F.lit(0), lambda p, x: F.when((p < F.size(sequence)) & (F.get(sequence, p) == x), p + 1).otherwise(p))
    return d.join(long_, (F.col(key) == F.col("__k")) & (F.col("__n") < F.col("__m")) & (walked == F.col("__n")), "left_anti").drop("__n")
