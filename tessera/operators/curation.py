"""Curation of task datasets: row maps, test cases, filters, subsets and lookups."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.search import bound
from .reshape import shuffle_key

#: The instruction of maths prompts, difficulty names and their numbers, names of failed states.
MATH_INSTRUCTION = "Let's think step by step and output the final answer within \\boxed{}."
DIFFICULTY = {"EASY": 1.9, "MEDIUM": 3.7, "MEDIUM_HARD": 5.5, "HARD": 7.3, "VERY_HARD": 9.1}
FAILED = ("ERROR", "FAIL", "FAILED")
TEST_KEYS = ("FAIL_TO_PASS", "fail_to_pass", "fail_to_pass_tests", "f2p_tests", "tests")


# subsets -----------------------------------------------------------------------------------------


def shuffled_rank(df: DataFrame, key: str, seed: int, out: str = "rank") -> DataFrame:
    """Place (from 0) in a seeded order; ranks come from counts by the first digits of the key, so no task sorts the whole table."""
    d = df.withColumn("__k", shuffle_key(F.col(key), seed)).withColumn("__b", F.substring("__k", 1, 3))
    per = d.groupBy("__b").agg(F.count("*").alias("__c"))  # at most 4096 rows
    before = per.select("__b", (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__k", key)) - 1
    return d.join(before, "__b").select(*df.columns, place.alias(out))


def sampled_copies(df: DataFrame, key: str, n: int, copies: int, seed: int = 42) -> DataFrame:
    """``copies`` times n sampled rows; uid is the row's place in the sample and the copy's number."""
    few = shuffled_rank(df, key, seed, "__r").where(F.col("__r") < n)
    many = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return many.withColumn("uid", F.concat_ws("_", "__r", "copy")).drop("__r")


def staged(df: DataFrame, key: str, size: int, stages: int = 2, seed: int = 42, out: str = "stage") -> DataFrame:
    """Disjoint shuffled subsets of ``size`` rows, or of an equal share where there are fewer; other rows get null."""
    n = df.count()
    size = min(size, n // stages)
    stage = F.floor(F.col("__r") / max(size, 1)).cast("int")
    return shuffled_rank(df, key, seed, "__r").withColumn(out, F.when(F.col("__r") < size * stages, stage)).drop("__r")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def random_groups(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """All rows of k groups, the same for the same seed."""
    some = df.select(group).distinct().withColumn("__k", shuffle_key(F.col(group), seed)).orderBy("__k", group).limit(k)
    return df.join(some.select(group), group, "left_semi")


def first_seen_order(df: DataFrame, task: str, order: str, out: str = "task_order") -> DataFrame:
    """Tasks by where each is first found."""
    return df.groupBy(task).agg(F.min(order).alias(out))


def listed_only(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The subset whose keys a list has, each once."""
    return df.join(listed.select(key).distinct(), key, "left_semi")


def last_and_earlier(last: DataFrame, earlier: DataFrame) -> DataFrame:
    """Last steps and the others, as one table again."""
    return last.unionByName(earlier, allowMissingColumns=True)


def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds finished rows to the resume log beside a collection."""
    rows.write.mode("append").json(path)


# row maps ----------------------------------------------------------------------------------------


def user_prompt(text: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))


def math_rows(df: DataFrame, question: str, answer: str, index: str, split: str, instruction: str = MATH_INSTRUCTION) -> DataFrame:
    return df.select(
        F.lit("").alias("data_source"),
        user_prompt(F.concat(F.col(question), F.lit(" " + instruction))).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col(answer).cast("string").alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).alias("index")).alias("extra_info"),
    )


def code_prompt(problem: Column, starter: Column, intro: str, with_starter: str, without_starter: str) -> Column:
    """A coding question; the answer's format depends on whether there is starter code."""
    has = F.coalesce(starter, F.lit("")) != ""
    form = F.when(has, F.concat(F.lit(f"### Format: {with_starter}\n```python\n"), starter, F.lit("\n```\n\n"))).otherwise(F.lit(f"### Format: {without_starter}\n```python\n# YOUR CODE HERE\n```\n\n"))
    return F.concat(F.lit(intro + "\n\n"), problem, form, F.lit("### Answer: (use the provided format with backticks)\n\n"))


def countdown_question(numbers: Column, target: Column) -> Column:
    listed = F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", ")
    return F.concat(F.lit("Using the numbers "), listed, F.lit(", find a way to reach the target number "), target.cast("string"), F.lit("."))


def grid_tasks(spark: SparkSession, n: int, seed: int, sizes: tuple[int, int] = (2, 10), shares: tuple[float, float] = (0.6, 0.85)) -> DataFrame:
    """n tasks with a seed, a size and a share of safe cells, uniform and the same for the same seed."""

    def uniform(what: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)

    low, high = sizes
    return spark.range(n).select(
        F.col("id").alias("index"), F.floor(uniform("seed") * 100000).cast("int").alias("seed"), (F.floor(uniform("size") * (high - low)) + low).cast("int").alias("size"),
        (uniform("p") * (shares[1] - shares[0]) + shares[0]).alias("p"),
    )


def reshaped(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(names))


def difficulty_number(label: Column) -> Column:
    """Number of a difficulty's name; -1 for any other."""
    out = F.lit(-1.0)
    for name, number in DIFFICULTY.items():
        out = F.when(label == name, F.lit(number)).otherwise(out)
    return out


def result_rows(trajectories: DataFrame, task: str = "task", info: str = "info") -> DataFrame:
    """Report rows from trajectories; task and info are maps of strings, what lacks gets its default."""

    def of(key: str, other: Column) -> Column:
        return F.coalesce(F.try_element_at(task, F.lit(key)), other)

    return trajectories.select(
        of("_uid", F.col("uid")).alias("uid"), of("data_source", F.lit("swe")).alias("data_source"), F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward"),
        of("_sample_idx", F.lit("0")).cast("int").alias("sample_idx"), of("_n_samples", F.lit("1")).cast("int").alias("n_samples"), of("instance_id", F.lit("")).alias("instance_id"),
        of("repo", of("repo_name", F.lit(""))).alias("repo"), F.coalesce(F.try_element_at(info, F.lit("termination_reason")), F.lit("UNKNOWN")).alias("termination_reason"),
    )


_MESSAGES = "array<struct<role:string,content:string>>"


def assistant_texts(trajectory: Column) -> Column:
    """Assistant texts of a trajectory in JSON: a list of messages, or an object with steps, messages or one response."""

    def said(messages: Column) -> Column:
        return F.transform(F.filter(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(m["content"], F.lit("")) != "")), lambda m: m["content"])

    none = F.array().cast("array<string>")
    listed = F.from_json(trajectory, _MESSAGES)
    whole = F.from_json(trajectory, f"steps array<struct<response:string>>, messages {_MESSAGES}, response string")
    steps = F.transform(whole["steps"], lambda s: F.coalesce(s["response"], F.lit("")))
    single = F.when(whole["response"].isNotNull(), F.array(whole["response"]))
    return F.when(F.ltrim(trajectory).startswith("["), F.coalesce(said(listed), none)).otherwise(F.coalesce(steps, said(whole["messages"]), single, none))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(F.btrim(c) != "", c) for c in columns), F.lit(""))


def question_with_choices(question: Column, choices: Column, extras: Column, most_choices: int = 10, most_extras: int = 5) -> Column:
    """A question, its lettered choices and some extra lines."""
    lettered = F.transform(F.slice(choices, 1, most_choices), lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))
    lines = F.concat(F.array(question), F.coalesce(lettered, F.array()), F.coalesce(F.slice(extras, 1, most_extras), F.array()))
    return F.array_join(lines, "\n")


def sft_messages(messages: Column) -> Column:
    """Trimmed messages with a role and content; null if fewer than two are left."""
    clean = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.btrim(m["content"], F.lit(" \n\t\r")).alias("content")))
    kept = F.filter(clean, lambda m: (F.coalesce(m["role"], F.lit("")) != "") & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.when(F.size(kept) >= 2, kept)


def sft_examples(steps: DataFrame, trajectory: Sequence[str], order: str, messages: str, reward: str, least: float) -> DataFrame:
    """trajectory and the cleaned messages of the last step of each whose reward (of that step's row) reaches ``least``; a null reward doesn't."""
    last = steps.groupBy(*trajectory).agg(F.max_by(F.struct(messages, reward), order).alias("__l"))
    kept = last.where(F.col(f"__l.{reward}") >= least).select(*trajectory, sft_messages(F.col(f"__l.{messages}")).alias("messages"))
    return kept.where("messages is not null")


def step_messages(messages: Column, response: Column) -> Column:
    """A call's messages and its response as one list."""
    return F.concat(messages, F.array(response))


def grouped_steps(steps: DataFrame, metadata: str, by: str, order: str, name_key: str | None = None) -> DataFrame:
    """Trajectories of the steps with one value under a metadata key; a step without it makes its own."""
    own = F.concat(F.lit("own-"), F.col(order).cast("string"))
    key = F.coalesce(F.try_element_at(metadata, F.lit(by)), own)
    name = F.coalesce(F.min_by(F.try_element_at(metadata, F.lit(name_key)), order), F.lit("agent")) if name_key else F.lit("agent")
    return steps.withColumn("__g", key).groupBy("__g").agg(name.alias("name"), F.sort_array(F.collect_list(order)).alias("steps")).withColumnRenamed("__g", "group")


# test cases --------------------------------------------------------------------------------------


def paired_tests(inputs: Column, outputs: Column, function: Column) -> Column:
    """Test cases from lists of inputs and outputs; the shorter list repeats its first element; functional where a function is named."""
    n = F.greatest(F.size(inputs), F.size(outputs))

    def at(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(x, i), F.get(x, F.lit(0)), F.lit(""))

    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(every, lambda i: F.struct(at(inputs, i).alias("input"), at(outputs, i).alias("output"), F.when(function.isNotNull(), "functional").alias("testtype"), function.alias("func_name")))


def normalised_tests(inputs: Column, outputs: Column, function: Column, kind: Column) -> Column:
    """Test cases of the shorter list's length; the function's name stays with functional ones only."""
    cases = F.slice(F.arrays_zip(inputs.alias("input"), outputs.alias("output")), 1, F.least(F.size(inputs), F.size(outputs)))
    named = F.when(kind == "functional", function)
    return F.transform(cases, lambda c: F.struct(c["input"].alias("input"), c["output"].alias("output"), kind.alias("testtype"), named.alias("func_name")))


def longest_tests(tests: Column, most: int = 15) -> Column:
    """The tests with the longest inputs; equally long ones keep their order."""
    ranked = F.array_sort(F.transform(tests, lambda t, i: F.struct((-F.length(t["input"])).alias("size"), i.alias("place"), t.alias("test"))))
    return F.when(F.size(tests) > most, F.transform(F.slice(ranked, 1, most), lambda r: r["test"])).otherwise(tests)


def _unpacked(packed: str | None) -> str | None:
    if packed is None:
        return None
    try:
        text = zlib.decompress(base64.b64decode(packed)).decode()
        json.loads(text)
        return text
    except (ValueError, zlib.error):
        return None


def _unpacked_series(s: pd.Series) -> pd.Series:
    return s.map(_unpacked)


def unpacked_tests(packed: Column) -> Column:
    """JSON from base64 of zlib; null for anything else (pickles are not read)."""
    return F.pandas_udf(_unpacked_series, T.StringType())(packed)


def _logged(text: Column) -> Column:
    """Second words of the lines that begin with a failure's mark; without any, the text itself where it reads as one test's name."""
    lines = F.transform(F.split(text, r"\R"), lambda x: F.split(F.btrim(x, F.lit(" \t\r")), r"\s+"))
    marked = F.transform(F.filter(lines, lambda x: x[0].isin("ERROR", "FAILED") & (F.size(x) > 1)), lambda x: x[1])
    alone = F.btrim(text, F.lit(" \t\r\n"))
    name = F.when(F.contains(alone, F.lit("::")) | F.startswith(alone, F.lit("test_")), F.array(alone)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(marked) > 0, marked).otherwise(name)


def failed_tests(value: Column, depth: int = 2) -> Column:
    """Names of failed tests by the kind of value: a JSON list has them, an object has them under one of TEST_KEYS or as names of
    failed states, any other text is a log or one name. Objects under a key are read ``depth`` deep; null has none."""
    none = F.array().cast("array<string>")

    def of_fields(fields: Column) -> Column:
        by_state = F.map_keys(F.map_filter(fields, lambda _, state: F.coalesce(F.upper(state).isin(*FAILED), F.lit(False))))
        by_key = [failed_tests(F.try_element_at(fields, F.lit(k)), depth - 1) for k in TEST_KEYS] if depth else []
        return F.coalesce(*(bound(t, lambda x: F.when(F.size(x) > 0, x)) for t in by_key), by_state)

    def of_text(text: Column) -> Column:
        inner = F.when(F.startswith(text, F.lit('"')), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0])
        as_list = F.when(F.startswith(text, F.lit("[")), F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull()))
        in_object = F.when(F.startswith(text, F.lit("{")), bound(F.from_json(text, "map<string,string>"), of_fields))
        return F.coalesce(as_list, in_object, bound(F.coalesce(inner, text), _logged), none)

    return bound(F.btrim(value, F.lit(" \t\r\n")), of_text)


# filters -----------------------------------------------------------------------------------------


def from_sources(df: DataFrame, source: str, *wanted: str) -> DataFrame:
    return df.where(F.col(source).isin(*wanted))


def good_code_rows(subset: Column, subsets: Sequence[str], style: Column, passes: Column, similarity: Column, test_code: Column, key: Column, bad_keys: Sequence[str]) -> Column:
    """Instruct rows of some subsets that are neither too easy, nor near a benchmark, nor poorly tested, nor known as bad."""
    return subset.isin(*subsets) & (style == "instruct") & (passes < 9) & (similarity < 0.9) & (F.regexp_count(test_code, F.lit("def")) >= 8) & ~key.isin(*bad_keys)


def wanted_difficulty(difficulty: Column, inputs: Column, outputs: Column) -> Column:
    """2 to 5, or 10 and more, with more than one test and an output for each."""
    return (difficulty.between(2, 5) | (difficulty >= 10)) & (F.size(inputs) > 1) & (F.size(inputs) == F.size(outputs))


def tested(tests: Column, more_than: int) -> Column:
    return F.size(tests) > more_than


def in_window(ts: Column, start: str, end: str) -> Column:
    """From start on and before end."""
    return (ts >= F.to_timestamp(F.lit(start))) & (ts < F.to_timestamp(F.lit(end)))


def evaluable(sets: Sequence[DataFrame], answer: str, allowed: Column) -> DataFrame:
    """The rows of several sets whose answers can be compared."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.where(F.col(answer).isNotNull() & F.coalesce(allowed, F.lit(False)))


def without_text(column: Column, part: str) -> Column:
    return ~column.contains(part)


def fenced(solution: Column, language: str = "python") -> Column:
    """A solution that is one fenced block."""
    return solution.isNotNull() & solution.startswith(f"```{language}") & solution.endswith("```")


def by_outcome(reward: Column, kind: str) -> Column:
    """zero, positive, one or all."""
    return {"zero": reward == 0, "positive": reward > 0, "one": reward == 1, "all": F.lit(True)}[kind]


def untruncated(mask: Column) -> Column:
    """The last position isn't attended to, so the row ended by itself."""
    return F.element_at(mask, -1) != 1


def mentions(text: Column, wanted: str) -> Column:
    return F.contains(F.lower(text), F.lit(wanted.lower()))


def goal_reached(grid: list[str], start: str = "S", goal: str = "G", hole: str = "H") -> bool:
    """Breadth first over the four neighbours; holes are never entered."""
    cells = {(r, c): x for r, row in enumerate(grid) for c, x in enumerate(row)}
    seen = {p for p, x in cells.items() if x == start}
    edge = list(seen)
    while edge:
        if any(cells[p] == goal for p in edge):
            return True
        near = {(r + a, c + b) for r, c in edge for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))}
        edge = [p for p in near if cells.get(p, hole) != hole and p not in seen]
        seen.update(edge)
    return False


def _reached(s: pd.Series) -> pd.Series:
    return s.map(lambda g: g is not None and goal_reached(list(g)))


def solvable_grid(rows: Column) -> Column:
    return F.pandas_udf(_reached, T.BooleanType())(rows)


# lookups -----------------------------------------------------------------------------------------


def with_experiment(results: DataFrame, experiments: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return results.join(experiments, key).orderBy(*order)


def steps_by_output(outputs: DataFrame, sessions: DataFrame, steps: DataFrame, session: str, step: str) -> DataFrame:
    """Outputs with their session and step; ``missing`` where the step was never stored."""
    found = outputs.join(sessions, session, "left").join(steps.withColumn("__there", F.lit(True)), step, "left")
    return found.withColumn("missing", F.col("__there").isNull()).drop("__there")


def with_hints(rows: DataFrame, hints: DataFrame, key: str, hint: str, order: str, default: str = "(unavailable)") -> DataFrame:
    """Each row with the latest hint of its key."""
    latest = hints.groupBy(key).agg(F.max_by(hint, order).alias(hint))
    return rows.join(latest, key, "left").withColumn(hint, F.coalesce(hint, F.lit(default)))


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def created(experiments: DataFrame, new: DataFrame, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """With new rows whose enumerated columns hold known values; raises for others."""
    for column, allowed in kinds.items():
        if not new.where(~F.col(column).isin(*allowed)).isEmpty():
            raise ValueError(f"unknown {column}")
    return experiments.unionByName(new)


def patched(experiments: DataFrame, key: str, value: object, changes: Mapping[str, object]) -> DataFrame:
    """With some fields of one row changed; raises without any field."""
    if not changes:
        raise ValueError("no fields to change")
    unknown = set(changes) - set(experiments.columns)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    hit = F.col(key) == value
    return experiments.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})
