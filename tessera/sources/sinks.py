"""Writers: episodes by run and step, metrics in long form, evaluation outputs, training files with their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def episode_key(task: Column) -> Column:
    return F.left(F.sha2(task, 256), F.lit(8))


def write_episodes(df: DataFrame, folder: str) -> None:
    """JSON below mode, step and epoch."""
    df.write.mode("append").partitionBy("mode", "step", "epoch").json(folder)


def long_metrics(df: DataFrame, step: str) -> DataFrame:
    """step, key, value of all number columns."""
    keys = [c for c, t in df.dtypes if c != step and t in ("int", "bigint", "float", "double")]
    return df.select(step, *(F.col(k).cast("double").alias(k) for k in keys)).unpivot([step], keys, "key", "value").where("value is not null")


def write_evaluation(results: DataFrame, traces: DataFrame, folder: str) -> None:
    """Results as JSON lines; traces as JSON, empty ones left out."""
    results.write.mode("overwrite").json(f"{folder}/results")
    traces.where(F.size("traces") > 0).write.mode("overwrite").json(f"{folder}/traces")


def with_sample_index(df: DataFrame, row_idx: str, n: int) -> DataFrame:
    return df.withColumn("sample_idx", F.pmod(F.col(row_idx), F.lit(n)))


def golden_patches(df: DataFrame, instance: str, order: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """First row of each instance, and fingerprint -> instance."""
    first = df.groupBy(instance).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")
    return first, first.groupBy(fingerprint).agg(F.min(instance).alias(instance))


def write_training(samples: DataFrame, trajectory: str, path: str) -> DataFrame:
    """Parquet, and beside it one row: samples, trajectories, samples for each."""
    samples.write.mode("overwrite").parquet(path)
    stored = samples.sparkSession.read.parquet(path)
    meta = stored.groupBy(trajectory).count().agg(F.sum("count").alias("samples"), F.count("*").alias("trajectories")).withColumn("avg_steps", F.col("samples") / F.greatest("trajectories", F.lit(1)))
    meta.write.mode("overwrite").json(f"{path.rstrip('/')}.meta")
    return meta
