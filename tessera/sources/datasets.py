"""Datasets by file and by name: readers by extension, tolerant and reporting JSON scans, a registry of Parquet splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[SparkSession, str], DataFrame]
#: By extension; other extensions are an error.
READERS: dict[str, Reader] = {
    ".json": lambda s, p: s.read.option("multiLine", True).json(p),
    ".jsonl": lambda s, p: s.read.json(p),
    ".csv": lambda s, p: s.read.option("header", True).option("inferSchema", True).csv(p),
    ".parquet": lambda s, p: s.read.parquet(p),
}
MALFORMED = "malformed"


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file by its extension."""
    for ending, reader in READERS.items():
        if path.rstrip("/").endswith(ending):
            if not exists(spark, path):
                raise FileNotFoundError(path)
            return reader(spark, path)
    raise ValueError(f"unsupported file: {path}")


def exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's file systems, so paths that only Spark can read count too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def catalog_path(root: str, split: str, category: str, name: str) -> str:
    """``root/{train,test}/category/name.json``."""
    if split not in ("train", "test") or not category or not name:
        raise ValueError((split, category, name))
    return f"{root}/{split}/{category}/{name}.json"


def mixture(names: Sequence[str], weights: Sequence[float] | None = None) -> dict[str, float]:
    """Weights that sum to one, uniform by default."""
    w = [1.0] * len(names) if weights is None else list(weights)
    if len(w) != len(names) or not names:
        raise ValueError("one weight for each name")
    return {n: x / sum(w) for n, x in zip(names, w, strict=True)}


def tolerant_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are left out, control characters are let through."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("allowUnquotedControlChars", True).json(path)


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def reasoned(lines: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    return lines.withColumn("termination_reason", F.coalesce("termination_reason", F.lit(default)))


def json_files(spark: SparkSession, folder: str, required: Sequence[str], pattern: str = "*.json") -> DataFrame:
    """One row a file: path, value (variant), problem (null if it is an object with the required fields)."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder).select(F.input_file_name().alias("path"), "value")
    v = raw.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    problem = F.when(F.col("v").isNull(), MALFORMED).when(~kind.startswith("OBJECT"), "not an object")
    for field in required:
        problem = problem.when(F.try_variant_get("v", f"$.{field}", "variant").isNull(), f"no {field}")
    return v.select("path", F.col("v").alias("value"), problem.alias("problem"))


def good_and_bad(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scanned.where("problem is null").select("path", "value"), scanned.where("problem is not null").select("path", F.col("problem").alias("reason"))


def looked_up(df: DataFrame, maps: DataFrame, key: str) -> DataFrame:
    """Rows with their map, null where there is none."""
    return df.join(maps, key, "left")


def tasks(df: DataFrame) -> DataFrame:
    """instance_id as it is, else of repository and commit."""
    return df.withColumn("instance_id", F.coalesce("instance_id", F.concat_ws("__", F.replace("repo", F.lit("/"), F.lit("__")), F.left("base_commit", F.lit(12)))))


def folder_type(files: DataFrame, path: str = "path") -> DataFrame:
    """The kind of experiment a folder of files is: evaluation before collection before rollout; null if none."""
    from .imports import KINDS

    name = F.element_at(F.split(path, "/"), -1)
    kind = F.lit(None).cast("string")
    for k, pattern in reversed(KINDS.items()):
        kind = F.when(F.bool_or(name.rlike(pattern)), k).otherwise(kind)
    return files.agg(kind.alias("type"))


def numbered(df: DataFrame, out: str = "line") -> DataFrame:
    """Rows with their place, from 0, in the order of df's partitions: the order of a file's lines, however the scan splits it.

    Counts by partition (a row for each) give where each starts, so no task sees the whole file.
    """
    placed = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    first = df.sparkSession.createDataFrame(starts, "__part long, __first long")
    place = F.col("__first") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(first, "__part").select(*df.columns, place.alias(out))


def zipped(left: DataFrame, right: DataFrame, number: str = "line") -> DataFrame:
    """Rows of two files side by side, by their place; the shorter ends both."""
    return numbered(left, number).join(numbered(right, number), number)


def looked_up_at(corpus: DataFrame, positions: DataFrame, number: str = "line") -> DataFrame:
    """Rows of a corpus file at given places, as often as asked."""
    return positions.join(numbered(corpus, number), number)


def outcome_rows(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Collected rows with role and reward, and how many steps (assistant messages) they have."""
    n = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    mark = lambda df, role, reward: df.withColumns({"role": F.lit(role), "reward": F.lit(reward), "n_steps": n})
    return mark(pos, "chosen", 1.0).unionByName(mark(neg, "rejected", 0.0))


def distinct_names(df: DataFrame, name: Column) -> DataFrame:
    """Names that are there, once each."""
    return df.select(name.alias("name")).where("name <> ''").distinct()


class Registry:
    """Named datasets with splits as Parquet below one folder; each split also as training envelopes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, split: str, envelope: bool = False) -> str:
        return f"{self.root}/{name}/{split}{'_envelope' if envelope else ''}.parquet"

    def register(self, df: DataFrame, name: str, split: str, truth: Column | None = None) -> None:
        from ..operators.reshape import training_envelope

        df.write.mode("overwrite").parquet(self.path(name, split))
        training_envelope(self.spark.read.parquet(self.path(name, split)), truth if truth is not None else F.lit(None).cast("string")).write.mode("overwrite").parquet(self.path(name, split, True))

    def load(self, name: str, split: str, envelope: bool = False) -> DataFrame | None:
        p = self.path(name, split, envelope)
        return self.spark.read.parquet(p) if exists(self.spark, p) else None

    def _children(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def names(self) -> list[str]:
        return self._children(self.root)

    def splits(self, name: str) -> list[str]:
        return [s.removesuffix(".parquet") for s in self._children(f"{self.root}/{name}") if s.endswith(".parquet") and not s.endswith("_envelope.parquet")]

    def drop(self, name: str, split: str | None = None) -> bool:
        """Whether there was something to drop."""
        paths = [f"{self.root}/{name}"] if split is None else [self.path(name, split), self.path(name, split, True)]
        done = False
        for path in paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            done |= bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True))
        if split is not None and not self._children(f"{self.root}/{name}"):
            self.drop(name)
        return done
