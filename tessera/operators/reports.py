"""Evaluation and training reports as aggregates; every deviation is the population's unless it says sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single_sample(df: DataFrame, group: str, reward: str, least: float = 1.0) -> DataFrame:
    """Per group and in all (group null): n, solved, rate, mean, std."""
    s = F.sum((F.col(reward) >= least).cast("int"))
    return df.rollup(group).agg(F.count("*").alias("n"), s.alias("solved"), (s / F.count("*")).alias("rate"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"))


def standard_error(per_task: DataFrame, mean: str) -> DataFrame:
    return per_task.agg(F.count("*").alias("n_tasks"), F.avg(mean).alias("mean"), (F.stddev_pop(mean) / F.sqrt(F.count("*"))).alias("sem"))


def reward_by_name(df: DataFrame, name: str, reward: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.max(reward).alias("most"), F.min(reward).alias("least"))


def reduced_metrics(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of keys that hold ``batch/``, mean of others."""
    return df.groupBy(key).agg(F.when(F.col(key).contains("batch/"), F.sum(value)).otherwise(F.avg(value)).alias("value"))


def timings(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric, mean, least, most, over values that are there and not negative."""
    long_ = df.unpivot([], list(metrics), "metric", "value")
    return long_.where("value >= 0").groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def compared(parents: DataFrame, children: DataFrame, key: str, reward: str) -> DataFrame:
    """Each parent with its children's number and passing rate, zeros where it has none."""
    agg = children.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(reward) > 0).alias("passed"))
    out = parents.join(agg, key, "left").fillna(0, ["total", "passed"])
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))


def counted_shares(df: DataFrame, reason: str) -> DataFrame:
    c = df.groupBy(reason).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def fixed_histogram(df: DataFrame, key: str, categories: Sequence[str], sample: str, keep: int = 5) -> DataFrame:
    """position, category, n, samples (least ``keep`` ids) for all categories in order, zeros shown."""
    cats = df.sparkSession.createDataFrame(list(enumerate(categories)), "position int, category string")
    low = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(sample)))
    agg = low.groupBy(F.col(key).alias("category")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("__r") <= keep, F.col(sample)))).alias("samples"))
    return cats.join(agg, "category", "left").select("position", "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.array()).alias("samples"))


def prob_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest, mean and sample deviation of |exp(a) - exp(b)|."""
    d = F.abs(F.exp(a) - F.exp(b))
    return df.agg(F.max(d).alias("most"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"))


def divergences(df: DataFrame, sampled: str, current: str) -> DataFrame:
    """First and second order divergence estimates, entropy and perplexity of sampled tokens."""
    d = F.col(sampled) - F.col(current)
    return df.agg(F.avg(d).alias("kl_v1"), (F.avg(d * d) * 0.5).alias("kl_v2"), (-F.avg(sampled)).alias("entropy"), F.exp(-F.avg(sampled)).alias("perplexity"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def episode_outcomes(df: DataFrame, episode: str, name: str, reward: str) -> DataFrame:
    """episode, total, is_correct (total over 0), and mean reward by trajectory name as a map."""
    per = df.groupBy(episode, name).agg(F.sum(reward).alias("s"), F.avg(reward).alias("acc"))
    return per.groupBy(episode).agg(F.sum("s").alias("total"), (F.sum("s") > 0).alias("is_correct"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "acc")))).alias("acc"))


def stratified_allocation(counts: dict[str, int], n: int) -> dict[str, int]:
    """How many of n to take from each stratum: equal shares, and what small strata can't give goes to the others, by name."""
    take, left = dict.fromkeys(sorted(counts), 0), min(n, sum(counts.values()))
    while left:
        open_ = [k for k in take if take[k] < counts[k]]
        share = max(left // len(open_), 1)
        for k in open_:
            got = min(share, counts[k] - take[k], left)
            take[k] += got
            left -= got
    return take


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows over few strata, in each those of the least md5(seed:key)."""
    counts = {r[stratum]: r["count"] for r in df.groupBy(stratum).count().collect()}  # one row for each stratum
    take = stratified_allocation(counts, n)
    limit = F.create_map(*(F.lit(x) for kv in take.items() for x in kv))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(order)))
    return ranked.where(F.col("__r") <= F.element_at(limit, F.col(stratum))).drop("__r")


def default_seed(name: Column) -> Column:
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
