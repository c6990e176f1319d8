"""Reports over evaluations, environments and call-graph maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validation_pass(samples: DataFrame, source: str, uid: str, correct: Column, metrics: Sequence[str] = ()) -> DataFrame:
    """By source: share of right samples, share of tasks with a right one, mean of each metric."""
    by_task = samples.groupBy(source, uid).agg(
        F.count("*").alias("n"), F.sum(correct.cast("int")).alias("c"), *(F.sum(m).alias(f"s_{m}") for m in metrics), *(F.count(m).alias(f"n_{m}") for m in metrics)
    )
    return by_task.groupBy(source).agg(
        (F.sum("c") / F.sum("n")).alias("pass_at_1"), F.avg((F.col("c") > 0).cast("double")).alias("pass_at_n"), *((F.sum(f"s_{m}") / F.sum(f"n_{m}")).alias(m) for m in metrics)
    )


def environment_metrics(steps: DataFrame, episode: str, trajectory: str, prompt_tokens: str, response_tokens: str, reward: str, good: float = 0.5) -> DataFrame:
    """One row of token means and totals, turns, and the shares of episodes whose rewards are all good, all bad or mixed; reward is the trajectory's."""
    t = steps.groupBy(episode, trajectory).agg(F.count("*").alias("turns"), F.sum(prompt_tokens).alias("ob"), F.sum(response_tokens).alias("ac"), F.max(reward).alias("reward"))
    e = t.groupBy(episode).agg(
        F.count("*").alias("trajectories"), F.sum("turns").alias("turns"), F.sum("ob").alias("ob"), F.sum("ac").alias("ac"), F.sum("reward").alias("reward"), F.min("reward").alias("low"), F.max("reward").alias("high")
    )
    same = F.col("low") == F.col("high")

    def share(c: Column) -> Column:
        return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))

    def mean(x: str, per: str) -> Column:
        return F.coalesce(F.sum(x) / F.sum(per), F.lit(0.0))

    return e.agg(
        mean("reward", "trajectories").alias("reward"), mean("ob", "turns").alias("ob_tokens_per_turn"), mean("ac", "turns").alias("ac_tokens_per_turn"),
        mean("ob", "trajectories").alias("ob_tokens_per_trajectory"), mean("ac", "trajectories").alias("ac_tokens_per_trajectory"),
        F.coalesce(F.sum("trajectories"), F.lit(0)).alias("total_trajectories"), F.coalesce(F.sum("turns"), F.lit(0)).alias("total_turns"), mean("turns", "trajectories").alias("turns_per_trajectory"),
        share(same & (F.col("low") >= good)).alias("frac_all_good"), share(same & (F.col("low") < good)).alias("frac_all_bad"), share(~same).alias("frac_mixed"),
    )


def mean_of_numbers(rows: DataFrame, info: str) -> DataFrame:
    """Mean of each key of a map of strings over the rows where it is a number."""
    numbers = rows.select(F.explode(info).alias("key", "value")).select("key", F.expr("try_cast(value as double)").alias("x"))
    return numbers.where("x is not null").groupBy("key").agg(F.avg("x").alias("mean"))


def unobserved_nodes(nodes: DataFrame, instance: str, observed: str, total: int) -> DataFrame:
    """How many instances have a node that no trace observed; nulls where no node says whether it was."""
    per = nodes.groupBy(instance).agg(F.bool_or(F.col(observed).isNotNull()).alias("present"), F.coalesce(F.bool_or(~F.col(observed)), F.lit(False)).alias("hit"))
    found = per.agg(F.coalesce(F.bool_or("present"), F.lit(False)).alias("present"), F.count_if("hit").alias("n"))
    n = F.when(F.col("present"), F.col("n"))
    return found.select("present", n.alias("instances"), (n / total if total else F.when(F.col("present"), F.lit(0.0))).alias("share"))


def unobserved_callables(maps: DataFrame, unobserved: str, patched: str) -> DataFrame:
    """Callables of the patch that no trace saw; nulls where no map has the field, a null share without any patched one."""
    m = maps.select(F.col(unobserved).isNotNull().alias("present"), F.greatest(F.size(unobserved), F.lit(0)).alias("u"), F.greatest(F.size(patched), F.lit(0)).alias("p"))
    a = m.agg(F.coalesce(F.bool_or("present"), F.lit(False)).alias("present"), F.sum("u").alias("u"), F.sum("p").alias("p"), F.count("*").alias("n"), F.count_if(F.col("u") > 0).alias("some"))
    on = lambda c: F.when(F.col("present"), c)
    return a.select("present", on(F.col("u")).alias("unobserved"), on(F.col("u") / F.col("n")).alias("mean"), on(F.col("some")).alias("instances"), on(F.when(F.col("p") > 0, F.col("u") / F.col("p"))).alias("share"))


def hop_distribution(instances: DataFrame, traceable: str, hops: str) -> DataFrame:
    """Of traceable instances with a number of hops: how many, least, mean, median and most."""
    h = F.col(hops)
    return instances.where(F.col(traceable) & h.isNotNull()).agg(F.count("*").alias("n"), F.min(h).alias("min"), F.avg(h).alias("mean"), F.median(h).alias("median"), F.max(h).alias("max"))


def traceability(instances: DataFrame, case: str, traceable: str, callables: str) -> DataFrame:
    """By case: instances, traceable ones and their share, mean number of patched callables."""
    return instances.groupBy(case).agg(
        F.count("*").alias("instances"), F.count_if(traceable).alias("traceable"), F.avg(F.col(traceable).cast("double")).alias("share"), F.avg(callables).alias("mean_callables")
    )


def category_prevalence(findings: DataFrame, category: str, instance: str, total: int, examples: int = 5) -> DataFrame:
    """By category: instances, their share in per cent, and the first few of them."""
    once = findings.select(category, instance).distinct()
    first = F.slice(F.array_sort(F.collect_list(instance)), 1, examples)
    return once.groupBy(category).agg(F.count("*").alias("instances"), first.alias("examples")).withColumn("percent", F.col("instances") * 100.0 / max(total, 1))


def combined_prevalence(parts: Sequence[DataFrame], category: str, total: int, examples: int = 5) -> DataFrame:
    """Several reports as one: counts add up and shares are taken anew."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    few = F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, examples)
    return out.groupBy(category).agg(F.sum("instances").alias("instances"), few.alias("examples")).withColumn("percent", F.col("instances") * 100.0 / max(total, 1))


def answer_report(results: DataFrame, correct: Column, exact: Column, f1: str, seconds: str, error: str) -> DataFrame:
    """Samples, right ones, accuracy, exact matches, mean F1 and time, and how many failed."""
    return results.agg(
        F.count("*").alias("samples"), F.count_if(correct).alias("correct"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(exact.cast("double")).alias("exact_match_rate"),
        F.avg(f1).alias("mean_f1"), F.avg(seconds).alias("mean_seconds"), F.count(error).alias("errors"),
    )


def tool_counts(results: DataFrame, tools: str) -> DataFrame:
    """Uses of each tool, from lists of calls."""
    return results.select(F.explode(tools).alias("tool")).groupBy("tool").agg(F.count("*").alias("uses"))


def rounds_report(results: DataFrame, correct: Column, rounds: str, reason: str) -> DataFrame:
    """One row: questions, accuracy, mean rounds, and how each ended as a map; no rounds count as 0, no reason as unknown."""
    by = results.groupBy(F.coalesce(F.col(reason), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.count_if(correct).alias("c"), F.sum(F.coalesce(F.col(rounds), F.lit(0))).alias("r"))
    ends = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))
    return by.agg(F.sum("n").alias("questions"), F.sum("c").alias("correct"), (F.sum("c") / F.sum("n")).alias("accuracy"), (F.sum("r") / F.sum("n")).alias("mean_rounds"), ends.alias("ends"))


#: Rows of a task whose groups are nearly as many as its rows, so that its memory doesn't grow with the table.
TASK_ROWS = 1 << 19


def episode_lengths(steps: DataFrame, episode: str, trajectory: str, prompt: str, response: str, all_episodes: DataFrame) -> DataFrame:
    """For each of all_episodes: trajectories, steps, and mean, least and greatest lengths; zeros for an episode without steps.

    Steps are dealt by episode to as many tasks as they need at TASK_ROWS each, and everything is counted where they lie.
    """
    width = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-steps.count() // TASK_ROWS))
    dealt = steps.select(*dict.fromkeys([episode, trajectory, prompt, response])).repartition(width, episode)
    got = dealt.groupBy(episode).agg(
        F.count_distinct(trajectory).alias("num_trajectories"), F.count("*").alias("steps_used"), F.avg(response).alias("mean_response_len"), F.max(response).alias("max_response_len"),
        F.min(response).alias("min_response_len"), F.max(prompt).alias("max_prompt_len"), F.min(prompt).alias("min_prompt_len"),
    )
    out = all_episodes.select(episode).repartition(width, episode).distinct().join(got, episode, "left").fillna(0)
    return out.withColumn("empty", (F.col("steps_used") == 0).cast("int"))


def by_contest(problems: DataFrame, problem: str, passed: str) -> DataFrame:
    """Submissions by contest, whose number leads a problem's id; raises for ids of another form."""
    number = F.regexp_extract(problem, r"^(\d+)[A-Z]", 1)
    checked = F.when(number == "", F.raise_error(F.concat(F.lit("no contest in "), F.col(problem)))).otherwise(number).cast("int")
    entries = F.array_sort(F.collect_list(F.struct(F.col(problem).alias("problem"), F.col(passed).alias("passed"))))
    return problems.withColumn("contest", checked).groupBy("contest").agg(entries.alias("problems"))
