"""Rollout groups: keys, names, ranks and the filters on whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_NAME = "default_traj_name"


def task_of(episode_id: Column, first_part: bool = True) -> Column:
    """The task in ``task:rollout``: before the first colon, or before the last."""
    return F.substring_index(episode_id, ":", 1) if first_part else F.when(F.contains(episode_id, F.lit(":")), F.regexp_replace(episode_id, ":[^:]*$", "")).otherwise(episode_id)


def role_of(group_id: Column) -> Column:
    """What follows the first colon, or all_groups."""
    return F.when(F.contains(group_id, F.lit(":")), F.regexp_replace(group_id, "^[^:]*:", "")).otherwise(F.lit("all_groups"))


def group_key(task: Column, name: Column, step: Column | None = None) -> Column:
    return F.concat_ws(":", task, name, *([step.cast("string")] if step is not None else []))


def imputed_names(df: DataFrame, episode: str, order: Sequence[str], name: str, drop: bool = False) -> DataFrame:
    """Unnamed trajectories are named by their place in the episode (named ones count), or dropped."""
    if drop:
        return df.where(F.col(name).isNotNull())
    place = F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1
    return df.withColumn(name, F.coalesce(name, F.concat(F.lit(f"{DEFAULT_NAME}_"), place.cast("string"))))


def rollout_index(df: DataFrame, task: str, order: Sequence[str], out: str = "rollout_idx") -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(task).orderBy(*order)) - 1).cast("int"))


def step_positions(df: DataFrame, trajectory: Sequence[str], order: Sequence[str]) -> DataFrame:
    """step_idx, n_steps, is_last."""
    w = Window.partitionBy(*trajectory)
    df = df.withColumn("step_idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n_steps", F.count(F.lit(1)).over(w))
    return df.withColumn("is_last", F.col("step_idx") == F.col("n_steps") - 1)


def collected_groups(df: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str = "members") -> DataFrame:
    """Members of each group as an ordered array; members without an order or masked ones are the caller's to leave out."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias(out))


def large_groups(df: DataFrame, group: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with ``least`` members or more."""
    return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*group))).where(F.col("__n") >= least).drop("__n")


def without_dropped(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    return df.join(dropped.select(key).distinct(), key, "left_anti")


def varied_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], reward: str, flat: float = 1e-8) -> DataFrame:
    """Rows of groups whose rewards differ; if none does, those of the first group."""
    first = F.first(reward).over(Window.partitionBy(*group).orderBy(*order))
    marked = df.withColumn("__d", F.abs(F.col(reward) - first))
    groups = marked.groupBy(*group).agg(F.max("__d").alias("__m"), F.min(F.struct(*order)).alias("__o"))
    varied = groups.where(F.col("__m") >= flat)
    fallback = groups.orderBy("__o").limit(1).join(varied.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti")
    return df.join(varied.select(*group).union(fallback.select(*group)), list(group), "left_semi")


def solve_split(df: DataFrame, group: Sequence[str], reward: str, exact: bool = False) -> DataFrame:
    """group, n, outcome: none (all rewards <= 0), all (all >= 1), partial; exact: == 0 and == 1."""
    low, high = F.min(reward), F.max(reward)
    none = (low == 0) & (high == 0) if exact else high <= 0
    all_ = (low == 1) & (high == 1) if exact else low >= 1
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.when(none, "none").when(all_, "all").otherwise("partial").alias("outcome"))


def divisible_prefix(df: DataFrame, order: Sequence[str], width: int, bucket: str) -> DataFrame:
    """The first floor(n / width) * width rows in order; ranks come from counts by ``bucket`` (a column that follows the order), not one global sort."""
    per = df.groupBy(bucket).agg(F.count("*").alias("__c")).withColumn("__before", F.sum("__c").over(Window.orderBy(bucket)) - F.col("__c"))
    total = per.agg(F.sum("__c").alias("__t"))
    ranked = df.join(per, bucket).withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return ranked.join(total, F.col("__r") <= F.floor(F.col("__t") / width) * width, "left_semi").drop("__c", "__before", "__r")


def compact(df: DataFrame, reason: str, masked: Sequence[str], out: str = "is_valid") -> DataFrame:
    """Validity by termination reason; a missing reason counts as UNKNOWN."""
    return df.withColumn(out, ~F.coalesce(F.col(reason), F.lit("UNKNOWN")).isin(*masked))


def masked_overlong(mask: Column, reason: Column, reasons: Sequence[str] = ("TRUNCATION", "MAX_STEPS", "TIMEOUT", "ENV_TIMEOUT")) -> Column:
    return F.when(reason.isin(*reasons), F.transform(mask, lambda x: x * 0)).otherwise(mask)


def round_robin_pairs(chosen: DataFrame, rejected: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The i-th chosen row of a key with its (i mod number)-th rejected one; keys with no rejected row drop out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    c = chosen.withColumn("__i", rank).select(key, "__i", *(F.col(f).alias(f"chosen_{f}") for f in fields))
    r = rejected.withColumn("__j", rank).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    n = r.groupBy(key).agg(F.max("__n").alias("__n"))
    r = r.select(key, "__j", *(F.col(f).alias(f"rejected_{f}") for f in fields))
    return c.join(n, key).withColumn("__j", F.pmod("__i", "__n")).join(r, [key, "__j"]).drop("__i", "__j", "__n")
