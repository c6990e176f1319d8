"""Contest ratings: the place a performance would have had, and the rating that expects it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problem_score(points: Column, wrong: Column) -> Column:
    """Points less 50 for each wrong attempt before the first pass, not under 0."""
    return F.greatest(F.lit(0), points - 50 * wrong)


def achieved_rank(standings: DataFrame, contest: str, place: str, score: str, mine: DataFrame) -> DataFrame:
    """contest, rank: the first place in each contest whose score ours beats or equals, else one past the last."""
    both = standings.join(mine.select(contest, F.col("my_score")), contest)
    return both.groupBy(contest).agg(F.coalesce(F.min(F.when(F.col("my_score") >= F.col(score), F.col(place))), F.max(place) + 1).alias("rank"))


def expected_rating(standings: DataFrame, contest: str, rating: str, ranks: DataFrame, low: int = 0, high: int = 4000) -> DataFrame:
    """contest, rating: the least whole rating whose expected place is before the achieved one.

    A contest's ratings are counted by value first, so a group holds at most one row for each whole rating.
    """
    counted = standings.groupBy(contest, rating).agg(F.count("*").alias("n")).join(ranks, contest)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, n, rank = pdf[rating].to_numpy(float), pdf["n"].to_numpy(float), float(pdf["rank"].iloc[0])
        a, b = low, high
        while a < b:
            mid = (a + b) // 2
            seed = 1 + float((n / (1 + 10 ** ((mid - r) / 400))).sum())
            a, b = (a, mid) if seed < rank else (mid + 1, b)
        return pd.DataFrame({contest: [pdf[contest].iloc[0]], "rating": [int(a)]})

    kind = dict(standings.dtypes)[contest]
    return counted.groupBy(contest).applyInPandas(one, f"`{contest}` {kind}, rating long")


def mean_rating(ratings: DataFrame, rating: str) -> DataFrame:
    return ratings.agg(F.avg(rating).alias("rating"), F.count("*").alias("contests"))

