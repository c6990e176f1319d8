"""Streams over the events: the trace store, rows held in state, results in the order of completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..streaming import held
from ..streaming.trace_store import TraceStore
from .registry import query, table


def _run(spark: SparkSession, d: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over all events has written by its end."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{d}/events.parque[t]")  # as a pattern it may be a file or a folder
    stream = stream.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), "user_id", "event_type")
    out, folder = work(stream), scratch(spark, "stream")
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("""
SELECT user_id, event_type, arg_max(event_id, epoch_us(ts)) AS last_event, arg_max(value, epoch_us(ts)) AS value, min(epoch_us(ts))::DOUBLE AS created, max(epoch_us(ts))::DOUBLE AS updated FROM events GROUP BY 1, 2""")
def trace_log(spark: SparkSession, d: str) -> DataFrame:
    """Four batches, out of order in time; buckets of more than two runs are merged, and the last batch comes twice."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    events = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("last_event"), "value", at.alias("created"), at.alias("updated"))
    store = TraceStore(spark, scratch(spark, "traces"), ["user_id", "event_type"], "updated", "created", buckets=8, most_runs=2)
    for k in (2, 0, 3, 1, 1):
        store.append(events.where(F.col("last_event") % 4 == k), {2: 0, 0: 1, 3: 2, 1: 3}[k])
    return store.read().select("user_id", "event_type", "last_event", "value", "created", "updated")


@query("""
SELECT event_id, user_id, 0::BIGINT AS release FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 16)""")
def enough_rows(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, lambda s: held.until_enough(s, "user_id", F.col("event_type") == "purchase", 16)).select("event_id", "user_id", "release")


@query("""
SELECT event_type, unnest(range(n // 64)) AS release, 64::BIGINT AS n_rows FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def mini_batches(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, d, lambda s: held.rechunked(s, "event_type", 64))
    return out.groupBy("event_type", "release").agg(F.countDistinct("event_id").alias("n_rows"))


@query("""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id::VARCHAR) AS place, false AS late
FROM (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY user_id) - 86400000000 AS turn FROM events) WHERE epoch_us(ts) <= turn""")
def completion_order(spark: SparkSession, d: str) -> DataFrame:
    out = _run(spark, d, lambda s: held.in_completion_order(s, "user_id", "event_id", "at", 86400e6))
    return out.select("event_id", "user_id", "place", "late")
