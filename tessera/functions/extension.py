"""What users plug in: reward functions, grouping and workflow hooks, tools, parsers, and capture of calls as rows."""

from __future__ import annotations

import contextvars
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .agent_text import fenced_tool_calls, tool_calls


@dataclass
class RewardOutput:
    reward: float
    is_correct: bool | None = None
    metadata: Mapping[str, object] = field(default_factory=dict)


REWARD_TYPE = "reward double, is_correct boolean, metadata string"


def reward_column(function: Callable[[dict, str], RewardOutput], task_info: Column, action: Column) -> Column:
    """function(task info, action) on a column of JSON objects and one of texts, as struct(reward, is_correct, metadata in JSON)."""

    def run(tasks: pd.Series, actions: pd.Series) -> pd.DataFrame:
        got = [function(json.loads(t) if t else {}, a) for t, a in zip(tasks, actions, strict=True)]
        return pd.DataFrame({"reward": [float(g.reward) for g in got], "is_correct": [g.is_correct for g in got], "metadata": [json.dumps(dict(g.metadata), sort_keys=True) for g in got]})

    run.__annotations__ = {"tasks": pd.Series, "actions": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, REWARD_TYPE)(task_info, action)


Hook = Callable[[DataFrame], DataFrame]
GROUPING: dict[str, Hook] = {}


def grouping_hook(name: str) -> Callable[[Hook], Hook]:
    """Registers a way to form trajectory groups: a DataFrame with a column ``group`` from one of trajectories."""

    def add(hook: Hook) -> Hook:
        GROUPING[name] = hook
        return hook

    return add


def grouped_by_hook(trajectories: DataFrame, name: str) -> DataFrame:
    out = GROUPING[name](trajectories)
    if "group" not in out.columns:
        raise ValueError(f"{name} gave no group")
    return out


@dataclass
class WorkflowHooks:
    """Expressions that a workflow may replace: a step's reward, its shaping, and an episode's correctness and metrics."""

    reward: Callable[[], Column] = lambda: F.col("reward")
    shaping: Callable[[Column], Column] = lambda r: r
    correct: Callable[[Column], Column] = lambda total: total > 0
    metrics: Mapping[str, Callable[[], Column]] = field(default_factory=dict)

    def episodes(self, steps: DataFrame, episode: str) -> DataFrame:
        shaped = steps.withColumn("__r", self.shaping(self.reward()))
        out = shaped.groupBy(episode).agg(F.sum("__r").alias("reward"), *(m().alias(k) for k, m in self.metrics.items()))
        return out.withColumn("is_correct", self.correct(F.col("reward")))


class Tools:
    """Named tools: Python functions of strings, callable from SQL as ``<prefix>_<name>`` and one by one through ``call``."""

    def __init__(self, prefix: str = "tool") -> None:
        self.prefix, self.known = prefix, {}

    def register(self, name: str, function: Callable[[str], str], description: str = "") -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered")
        self.known[name] = (function, description)

    def names(self) -> list[str]:
        return sorted(self.known)

    def specs(self) -> list[dict]:
        return [{"name": n, "description": self.known[n][1]} for n in self.names()]

    def into(self, spark: SparkSession) -> None:
        for name, (function, _) in self.known.items():
            spark.udf.register(f"{self.prefix}_{name}", F.pandas_udf(_over_series(function), "string"))

    def call(self, tool: Column, argument: Column) -> Column:
        """Each row's tool on its argument; an error text for unknown tools."""
        functions = {n: f for n, (f, _) in self.known.items()}

        def run(tools: pd.Series, arguments: pd.Series) -> pd.Series:
            return pd.Series([functions[t](a) if t in functions else f"unknown tool {t}" for t, a in zip(tools, arguments, strict=True)], dtype=object)

        run.__annotations__ = {"tools": pd.Series, "arguments": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "string")(tool, argument)


def _over_series(function: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return run


#: Parsers of tool calls by a pattern of the model's name, the first that matches.
PARSERS: list[tuple[str, Callable[[Column], Column]]] = [(r"(?i)deepseek|r1", fenced_tool_calls), (r"(?i)qwen|.*", tool_calls)]


def parser_for(model: str) -> Callable[[Column], Column]:
    return next(build for pattern, build in PARSERS if re.search(pattern, model))


_session: contextvars.ContextVar[dict | None] = contextvars.ContextVar("session", default=None)


@contextmanager
def session(name: str | None = None, **metadata: str) -> Iterator[dict]:
    """Calls of captured functions inside become rows of this session; an inner session inherits metadata."""
    outer = _session.get()
    own = {"session": name or uuid.uuid4().hex, "metadata": {**(outer["metadata"] if outer else {}), **metadata}, "rows": outer["rows"] if outer else []}
    token = _session.set(own)
    try:
        yield own
    finally:
        _session.reset(token)


def captured(function: Callable) -> Callable:
    """A function whose calls are rows of the session around them: name, arguments, result and seconds."""

    @wraps(function)
    def run(*args: object, **kwargs: object) -> object:
        began = time.perf_counter()
        out = function(*args, **kwargs)
        if (own := _session.get()) is not None:
            taken = time.perf_counter() - began
            own["rows"].append((own["session"], function.__name__, json.dumps([args, kwargs], default=str), json.dumps(out, default=str), float(taken), own["metadata"]))
        return out

    return run


def captured_rows(spark: SparkSession, own: dict) -> DataFrame:
    return spark.createDataFrame(own["rows"], "session string, name string, input string, output string, seconds double, metadata map<string,string>")
