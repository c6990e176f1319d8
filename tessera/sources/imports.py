"""Folders of experiments as tables: what kind a folder is, and its trajectories with their ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which file names make a folder an evaluation, a collection or a rollout, in this order.
KINDS = {"eval": r"_n1\.jsonl$", "collection": r"\.(?:pos|neg)\.jsonl$", "rollout": r"^\d+\.jsonl$"}


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """By Spark's own file systems, so in any store that it reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def experiment_type(spark: SparkSession, folder: str) -> str | None:
    """The first of KINDS that a file's name shows; None if none does."""
    names = file_names(spark, folder)
    return next((kind for kind, p in KINDS.items() if any(re.search(p, n) for n in names)), None)


def good_lines(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """file, line (place from 0 among its file's good lines), value (variant) of the JSON lines in files with such names.

    Bad lines are left out and not counted; control characters are let through. A file may be split over many tasks: each part
    is numbered where it is read, and the counts of a file's parts, a row for each, say where a part begins.
    """
    scan = spark.read.option("recursiveFileLookup", False).text(folder).select("value", "_metadata.file_path", "_metadata.file_name", "_metadata.file_block_start")
    json = F.coalesce(F.try_parse_json("value"), F.try_parse_json(F.regexp_replace("value", r"[\x00-\x1f]", " ")))
    good = scan.where(F.col("file_name").rlike(names)).select("file_path", "file_name", "file_block_start", json.alias("v")).where("v is not null")
    placed = good.withColumn("id", F.monotonically_increasing_id())
    part = ["file_path", "file_block_start"]
    counts = placed.groupBy(*part).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*part, "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(starts, part).select(F.col("file_name").alias("file"), (F.col("before") + F.col("id") - F.col("first")).alias("line"), F.col("v").alias("value"))


def _steps(messages: Column) -> Column:
    """How many of the messages (variant) are an assistant's."""
    roles = F.transform(F.try_variant_get(messages, "$", "array<variant>"), lambda m: F.try_variant_get(m, "$.role", "string"))
    return F.coalesce(F.size(F.filter(roles, lambda r: r == "assistant")), F.lit(0))


def _rows(lines: DataFrame, id_: Column, reward: Column, reason: Column, messages: Column, role: Column) -> DataFrame:
    return lines.select(
        id_.alias("instance_id"), F.lit(0).alias("sample_idx"), reward.cast("double").alias("reward"), reason.cast("string").alias("termination_reason"),
        _steps(messages).alias("n_steps"), F.to_json(messages).alias("messages"), role.alias("role"), "file", "line",
    )


def collected(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectories of a collection: those of pos files are chosen, with reward 1, those of neg files rejected, with 0."""
    lines = good_lines(spark, folder, KINDS["collection"])
    get = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    chosen = F.endswith("file", F.lit(".pos.jsonl"))
    text = lambda name: F.coalesce(get(name, "string"), F.lit(""))
    objects = lines.where(F.schema_of_variant("value").startswith("OBJECT"))
    return _rows(objects, text("instance_id"), F.when(chosen, 1.0).otherwise(0.0), text("termination_reason"), F.coalesce(get("messages", "variant"), F.parse_json(F.lit("[]"))), F.when(chosen, "chosen").otherwise("rejected"))


def rollouts(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectories of numbered files, a list of messages or an object with one on each line; ids are rollout_{file}_{line}."""
    lines = good_lines(spark, folder, KINDS["rollout"])
    messages = F.when(F.schema_of_variant("value").startswith("ARRAY"), F.col("value")).otherwise(F.try_variant_get("value", "$.messages", "variant"))
    id_ = F.concat(F.lit("rollout_"), F.regexp_replace("file", r"\.jsonl$", ""), F.lit("_"), F.col("line").cast("string"))
    return _rows(lines.withColumn("__m", messages).where("__m is not null"), id_, F.lit(None), F.lit(None), F.col("__m"), F.lit("primary"))


def imported(spark: SparkSession, folder: str) -> DataFrame:
    """The trajectories of a folder, by its kind; files of another kind beside them are left alone."""
    kind = experiment_type(spark, folder)
    if kind == "collection":
        return collected(spark, folder)
    if kind == "rollout":
        return rollouts(spark, folder)
    raise ValueError(f"no trajectories in {folder}")


def import_summary(rows: DataFrame) -> DataFrame:
    """One row: mode (dpo, rejection or rollout), counts by role, files and instances."""
    count = lambda role: F.count_if(F.col("role") == role)
    mode = F.when(count("primary") > 0, "rollout").when(count("rejected") > 0, "dpo").otherwise("rejection")
    return rows.agg(mode.alias("mode"), count("chosen").alias("pos"), count("rejected").alias("neg"), F.countDistinct("instance_id").alias("instances"), F.countDistinct("file").alias("files"), F.count("*").alias("total"))
