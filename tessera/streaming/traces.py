"""Structured Streaming forms: file streams with back-pressure (maxFilesPerTrigger), groups that leave when full, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def full_groups(stream: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """key, values: a group leaves when its n-th member comes, and starts anew."""
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for f in frames:
            held += f[value].tolist()
            while len(held) >= n:
                out.append({key: k[0], "values": held[:n]})
                held = held[n:]
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out)

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, values array<{kinds[value]}>", f"held array<{kinds[value]}>", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, ts: str, by: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Extra: event counts in windows of event time, late rows bounded by a watermark. A time without zone is taken as UTC."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
