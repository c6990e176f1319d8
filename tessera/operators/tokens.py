"""Token rows: masks, padding, shifts, merged data and alignment of two tokenisations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Widths of up to this many batches are broadcast.
MOST_SENT = 50_000


def left_padded(ids: Column, n: int, pad: int = 0) -> Column:
    """The last n ids, padding in front."""
    kept = F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)
    return F.concat(F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(0), n - F.size(ids))), kept)


def right_padded(ids: Column, n: int, pad: int = 0) -> Column:
    """The first n ids, padding behind."""
    return F.concat(F.slice(ids, 1, n), F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(0), n - F.size(ids))))


def batch_padded(df: DataFrame, batch: Sequence[str], ids: str, out: str = "padded", pad: int = 0) -> DataFrame:
    """Left padding to the longest row of the batch."""
    names = [f"__b{k}" for k in range(len(batch))]
    most = df.groupBy(*(F.col(b).alias(n) for b, n in zip(batch, names, strict=True))).agg(F.max(F.size(ids)).alias("__most"))
    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(n)) for b, n in zip(batch, names, strict=True)))
    if most.limit(MOST_SENT + 1).count() <= MOST_SENT:  # one row a batch, so a batch of any size stays where its rows are
        most = F.broadcast(most)
    padded = F.concat(F.array_repeat(F.lit(pad).cast("int"), F.col("__most") - F.size(ids)), F.col(ids))
    return df.join(most, same).withColumn(out, padded).drop("__most", *names)


def _positions(mask: pd.Series) -> pd.Series:
    return mask.map(lambda m: None if m is None else np.maximum(np.cumsum(m) - 1, 0))


def positions(mask: Column) -> Column:
    """Running count of attended tokens less one, not under 0."""
    return F.pandas_udf(_positions, T.ArrayType(T.IntegerType()))(mask)


def reward_at_end(n: Column, reward: Column, width: int) -> Column:
    """Zeros with the reward at the n-th place, if there is one."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.when((i == n) & (n > 0), reward).otherwise(F.lit(0.0)))


def place_of_end(n: Column, width: int) -> Column:
    """The place from 1 where ``reward_at_end`` puts the reward, 0 if there is none. The array itself can't tell: a reward of 0 looks like the zeros before it."""
    return F.when((n > 0) & (n <= width), n).otherwise(0).cast("int")


def shifted(seq: Column, logprobs: Column, advantages: Column, mask: Column) -> Column:
    """inputs without the last token, targets without the first, the rest along with the targets."""

    def tail(x: Column) -> Column:
        return F.slice(x, F.lit(2), F.size(x))

    return F.struct(F.slice(seq, F.lit(1), F.size(seq) - 1).alias("inputs"), tail(seq).alias("targets"), tail(logprobs).alias("logprobs"), tail(advantages).alias("advantages"), tail(mask).alias("mask"))


def distilled(teacher: Column, student: Column) -> Column:
    """Teacher less student, null where lengths differ."""
    return F.when(F.size(teacher) == F.size(student), F.zip_with(teacher, student, lambda t, s: t - s))


def message_masks(messages: Column, last_only: bool = False) -> Column:
    """1 for each white-space token of assistant messages (of the last one if asked), 0 for others; the tokenizer is the caller's to replace."""
    n = F.size(messages)
    of = F.transform(messages, lambda m, i: F.transform(F.filter(F.split(m["content"], r"\s+"), lambda t: t != ""), lambda t: F.when((m["role"] == "assistant") & ((i == n - 1) if last_only else F.lit(True)), 1).otherwise(0)))
    return F.flatten(of)


def merged_data(df: DataFrame, trajectory: Sequence[str], order: Sequence[str], prompt: str, response: str, segment: str = "segment") -> DataFrame:
    """One token row for each segment: the last step's prompt and response, with 1 on what the steps' responses gave."""
    d = df.groupBy(*trajectory, segment).agg(F.array_sort(F.collect_list(F.struct(*order, F.size(prompt).alias("n_prompt"), F.size(response).alias("n_response"), F.concat(prompt, response).alias("seq")))).alias("s"))
    seq = F.element_at("s", -1)["seq"]
    mask = F.transform(F.sequence(F.lit(1), F.size(seq)), lambda i: F.exists("s", lambda x: (i > x["n_prompt"]) & (i <= x["n_prompt"] + x["n_response"])).cast("int"))
    return d.select(*trajectory, segment, F.size("s").alias("n_steps"), seq.alias("seq"), mask.alias("mask"))


def token_spans(df: DataFrame, key: Sequence[str], tokens: str) -> DataFrame:
    """key, idx, start, end (bytes) of each token of an array."""
    w = Window.partitionBy(*key).orderBy("idx")
    t = df.select(*key, F.posexplode(tokens).alias("idx", "token")).withColumn("n", F.octet_length("token"))
    return t.withColumn("end", F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n")).select(*key, "idx", "start", "end")


def aligned_logprobs(student: DataFrame, teacher: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, idx, logprob of student tokens: teacher tokens share theirs among the student tokens that they overlap; none is 0.

    student and teacher: token_spans, the teacher's with logprob.
    """
    on = (F.col("s.start") < F.col("t.end")) & (F.col("t.start") < F.col("s.end"))
    for k in key:
        on = on & (F.col(f"s.{k}") == F.col(f"t.{k}"))
    hit = student.alias("s").join(teacher.alias("t"), on, "left").select(*(F.col(f"s.{k}").alias(k) for k in key), F.col("s.idx").alias("idx"), F.col("t.idx").alias("tidx"), F.col("t.logprob").alias("lp"))
    usage = F.count(F.lit(1)).over(Window.partitionBy(*key, "tidx"))
    return hit.withColumn("part", F.when(F.col("tidx").isNotNull(), F.col("lp") / usage)).groupBy(*key, "idx").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("logprob"))


def format_ok(text: Column) -> Column:
    """Think and function tags are balanced."""

    def n(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return (n("<think>") == n("</think>")) & (n("<function=") == n("</function>"))
