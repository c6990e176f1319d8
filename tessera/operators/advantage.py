"""Group-relative advantages, returns and reward shaping as window expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAT = 1e-8


def group_advantage(df: DataFrame, group: Sequence[str], reward: str, normalise: bool = True, out: str = "advantage") -> DataFrame:
    """(reward - mean) / population deviation in each group; a single member keeps its reward, a flat group gets differences only."""
    w = Window.partitionBy(*group)
    r = F.col(reward).cast("double")
    mean, std, n = F.avg(r).over(w), F.stddev_pop(r).over(w), F.count(F.lit(1)).over(w)
    scaled = F.when(std > FLAT, (r - mean) / std).otherwise(r - mean) if normalise else r - mean
    return df.withColumn(out, F.when(n == 1, r).otherwise(scaled))


def group_advantage_with_gaps(df: DataFrame, group: Sequence[str], reward: str, out: str = "advantage") -> DataFrame:
    """As group_advantage over the rewards that are there; missing ones get the group's lowest advantage."""
    w = Window.partitionBy(*group)
    r = F.col(reward).cast("double")
    mean, std, n = F.avg(r).over(w), F.stddev_pop(r).over(w), F.count(r).over(w)
    known = F.when(n == 1, r).when(std > FLAT, (r - mean) / std).otherwise(r - mean)
    return df.withColumn(out, known).withColumn(out, F.coalesce(F.col(out), F.min(out).over(w)))


def reinforce(df: DataFrame, group: Sequence[str], reward: str, out: str = "advantage") -> DataFrame:
    """The reward itself; missing ones get the group's lowest."""
    r = F.col(reward).cast("double")
    return df.withColumn(out, F.coalesce(r, F.min(r).over(Window.partitionBy(*group))))


#: Estimators by name; other names fall back to the group-relative one.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {"grpo": group_advantage, "reinforce": reinforce}


def advantages(df: DataFrame, estimator: str, group: Sequence[str], reward: str) -> DataFrame:
    return ESTIMATORS.get(estimator, group_advantage)(df, group, reward)


def per_step_advantage(df: DataFrame, group: Sequence[str], step: str, reward: str) -> DataFrame:
    """Advantages among the steps of one index in a group."""
    return group_advantage(df, [*group, step], reward)


def unequal_step_counts(df: DataFrame, group: Sequence[str], trajectory: str) -> DataFrame:
    """Groups whose trajectories differ in steps, which per-step advantages don't allow."""
    n = df.groupBy(*group, trajectory).agg(F.count("*").alias("n"))
    return n.groupBy(*group).agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least <> most")


def discounted_returns(df: DataFrame, trajectory: Sequence[str], order: Sequence[str], reward: str, gamma: float = 0.95, out: str = "mc_return") -> DataFrame:
    """G_t = r_t + gamma * G_(t+1), one pass from the end of each trajectory's rewards."""
    steps = df.groupBy(*trajectory).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(reward).cast("double").alias("__r")))).alias("s"))
    back = F.aggregate(
        F.reverse("s"),
        F.array().cast("array<double>"),
        lambda acc, x: F.concat(F.array(x["__r"] + F.lit(gamma) * F.coalesce(F.get(acc, F.lit(0)), F.lit(0.0))), acc),
    )
    return steps.select(*trajectory, F.posexplode(F.arrays_zip("s", back.alias("g")))).select(*trajectory, *(F.col(f"col.s.{c}").alias(c) for c in order), F.col("col.s.__r").alias(reward), F.col("col.g").alias(out))


def shaped_reward(df: DataFrame, trajectory: Sequence[str], order: Sequence[str], reward: str, coefficient: float, out: str = "shaped") -> DataFrame:
    """reward + coefficient * (reward - the step before's), the first step unchanged."""
    r = F.col(reward).cast("double")
    return df.withColumn(out, r + coefficient * F.coalesce(r - F.lag(r).over(Window.partitionBy(*trajectory).orderBy(*order)), F.lit(0.0)))


def last_step_reward(df: DataFrame, group: Sequence[str], trajectory: str, step: str, step_reward: str, trajectory_reward: str) -> DataFrame:
    """group, trajectory, reward, consistent: the last step's reward where no trajectory of the group has its own; not consistent: some have."""
    per = df.groupBy(*group, trajectory).agg(F.max(trajectory_reward).alias("own"), F.max_by(step_reward, step).alias("last"))
    w = Window.partitionBy(*group)
    n, known = F.count(F.lit(1)).over(w), F.count("own").over(w)
    return per.select(*group, trajectory, F.when(known == 0, F.col("last")).otherwise(F.col("own")).alias("reward"), ((known == 0) | (known == n)).alias("consistent"))


def reshaped(advantage: Column, distance: Column, ceiling: float = 3.0) -> Column:
    """advantage times (if positive) or over (if negative) ceiling ** (1 - distance); unchanged at zero or off the graph (distance < 0)."""
    return F.when(distance < 0, advantage).otherwise(advantage * F.pow(F.lit(ceiling), (1 - distance) * F.signum(advantage)))


def last_step_to_all(df: DataFrame, trajectory: Sequence[str], is_last: str, advantage: str, out: str = "broadcast", per_step: bool = False) -> DataFrame:
    """The last step's advantage on every step of its trajectory, over the number of steps if asked."""
    w = Window.partitionBy(*trajectory)
    v = F.max(F.when(F.col(is_last), F.col(advantage))).over(w)
    return df.withColumn(out, v / F.count(F.lit(1)).over(w) if per_step else v)
