"""Answers of many rollouts against their truths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import equal_answers


def graded_answers(df: DataFrame, given: str, truth: str, into: str = "is_correct") -> DataFrame:
    """df with whether given equals truth; null where one is null.

    Rollouts repeat their answers, so each distinct pair is compared once: distinct pairs are a grouping with partial
    aggregates, and the join that brings the verdicts back is split by Spark where one pair is most of the rows.
    """
    pairs = df.select(F.col(given).alias("__given"), F.col(truth).alias("__truth")).where("__given is not null and __truth is not null").distinct()
    verdicts = pairs.withColumn(into, equal_answers(F.col("__given"), F.col("__truth")))
    return df.join(verdicts, (F.col(given) == F.col("__given")) & (F.col(truth) == F.col("__truth")), "left").drop("__given", "__truth")


def agreed_answers(df: DataFrame, keys: list[str], given: str) -> DataFrame:
    """The most frequent answer of each task with its share; ties go to the lesser text."""
    counts = df.where(F.col(given).isNotNull()).groupBy(*keys, given).agg(F.count("*").alias("__n"))
    best = F.min_by(F.struct(given, "__n"), F.struct((-F.col("__n")).alias("n"), F.col(given)))
    return counts.groupBy(*keys).agg(best.alias("__b"), F.sum("__n").alias("__all")).select(*keys, F.col(f"__b.{given}").alias(given), (F.col("__b.__n") / F.col("__all")).alias("share"))
