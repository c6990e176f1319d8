"""Success rates over repeated rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unbiased_pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n - c, k) / C(n, k); 0 without a success, 1 if fewer than k failures."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - k / i))
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - product)


def observed(df: DataFrame, task: Sequence[str], success: Column) -> DataFrame:
    """pass_at_1 (successes over rollouts), pass_at_k (tasks with one), n_tasks, n_rollouts."""
    per = df.groupBy(*task).agg(F.sum(success.cast("int")).alias("c"), F.count("*").alias("n"))
    return per.agg((F.sum("c") / F.sum("n")).alias("pass_at_1"), F.avg((F.col("c") > 0).cast("int")).alias("pass_at_k"), F.count("*").alias("n_tasks"), F.sum("n").alias("n_rollouts"))


def by_task(df: DataFrame, task: Sequence[str], reward: str, least: float = 1.0, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """task, n, c, mean_reward and pass_at_<k> of each task."""
    per = df.groupBy(*task).agg(F.count("*").cast("int").alias("n"), F.sum((F.col(reward) >= least).cast("int")).cast("int").alias("c"), F.avg(reward).alias("mean_reward"))
    return per.withColumns({f"pass_at_{k}": unbiased_pass_at_k(F.col("n"), F.col("c"), F.least(F.lit(k), F.col("n"))) for k in ks})


def by_group(per_task: DataFrame, group: str, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Of each group of tasks and of all (group null): n_tasks, solved (with a success), mean and sem of the tasks' means, and the mean pass_at_<k>; per_task is ``by_task``'s."""
    n = F.count("*")
    means = (F.avg(f"pass_at_{k}").alias(f"pass_at_{k}") for k in ks)
    return per_task.rollup(group).agg(n.alias("n_tasks"), F.count_if(F.col("c") > 0).alias("solved"), F.avg("mean_reward").alias("mean"), (F.stddev_pop("mean_reward") / F.sqrt(n)).alias("sem"), *means)


def solved_tasks(per_task: DataFrame, task: str) -> DataFrame:
    """Tasks with a success and their place: most successes first, then by name."""
    solved = per_task.where("c > 0")
    counts = solved.groupBy("c").agg(F.count("*").alias("__n"))  # one row for each number of successes
    above = counts.select("c", F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("c").orderBy(task))
    return solved.join(F.broadcast(above), "c").select(task, "c", "n", (F.col("__before") + within).alias("place"))


def solve_histogram(per_task: DataFrame, n_samples: int) -> DataFrame:
    """Tasks by number of successes, 0 to n_samples, zeros shown."""
    bins = per_task.sparkSession.range(n_samples + 1).select(F.col("id").cast("int").alias("c"))
    return bins.join(per_task.groupBy("c").agg(F.count("*").alias("tasks")), "c", "left").select("c", F.coalesce("tasks", F.lit(0)).alias("tasks"))


def task_solving(df: DataFrame, task: Sequence[str], correct: Column) -> DataFrame:
    """Shares of tasks solved always, sometimes and never, with at least one as denominator."""
    per = df.groupBy(*task).agg(F.bool_and(correct).alias("every"), F.bool_or(correct).alias("some"))
    n = F.greatest(F.count("*"), F.lit(1))
    return per.agg((F.count_if("every") / n).alias("solve_all"), (F.count_if(F.col("some") & ~F.col("every")) / n).alias("solve_partial"), (F.count_if(~F.col("some")) / n).alias("solve_none"))


def clipped_source_scores(df: DataFrame, source: str, task: str, reward: str) -> DataFrame:
    """Mean of rewards clipped to [0, 1], and share of tasks whose best reaches 1, by source."""
    per = df.groupBy(source, task).agg(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(reward)))).alias("s"), F.count("*").alias("n"), F.max(reward).alias("best"))
    return per.groupBy(source).agg((F.sum("s") / F.sum("n")).alias("mean_score"), F.avg((F.col("best") >= 1).cast("int")).alias("pass_at_k"))


def first_and_any(scores: Column) -> tuple[Column, Column]:
    """Whether the first score of a list is positive, and whether any is."""
    return F.coalesce(F.get(scores, F.lit(0)) > 0, F.lit(False)), F.exists(scores, lambda x: x > 0)


def percentile_rank(value: Column, ratings: DataFrame, rating: str) -> DataFrame:
    """Share of ratings under a value, in percent with one decimal."""
    return ratings.agg(F.round(F.count_if(F.col(rating) < value) / F.count("*") * 100, 1).alias("percentile"))
