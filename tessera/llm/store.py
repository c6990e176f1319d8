"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: From here on ids stand for null ones inside an operator: such rows come after all others, each text for itself.
NO_ID = (1 << 63) - (1 << 40)
#: Text of a partition of dealt documents, as much as a task of the scan reads.
PARTITION_BYTES = 128 << 20

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or f"file://{LOCAL_FOLDER}"


def named(column: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def id_of(id_col: str, text_col: str) -> Column:
    """The id as a long; for a null one a number from NO_ID on, by the text."""
    return F.coalesce(named(id_col).cast("long"), F.lit(NO_ID) + F.xxhash64(named(text_col).cast("string")).bitwiseAND(F.lit((1 << 40) - 1)))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (NO_ID for null) and text of docs, whatever else it holds."""
    return docs.select(id_of(id_col, text_col).alias("id"), named(text_col).cast("string").alias("text"))


def id_again(column: Column | str) -> Column:
    """The id that ``id_of`` stood for."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c < NO_ID, c)


def free_name(wanted: str, columns: list[str]) -> str:
    """wanted, lengthened until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder; it outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_recording, "lists", []):
        paths.append(path)
    with _own_shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes a query's shuffle files as the query ends; without it they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Nothing reads the shuffles of a write again, so they go with its end: else the disk holds those of all writes at once."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_recording = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that this thread writes meanwhile, for a caller that knows when they are no longer read."""
    paths: list[str] = []
    before = getattr(_recording, "lists", [])
    _recording.lists = [*before, paths]
    try:
        yield paths
    finally:
        _recording.lists = before


def dropped(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def written_alone(work: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table of what work gives; the tables that work wrote on its way go as soon as it is there."""
    with recorded() as paths:
        out = written(work(), name)
    dropped(out.sparkSession, paths[:-1])
    return out


def partitions(spark: SparkSession, total: int) -> int:
    """For a table with so many bytes of text: the session's shuffle width, more only where a task would hold over PARTITION_BYTES."""
    return max(shuffle_width(spark), -(-total // PARTITION_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with over one in HOT of all rows is dealt to several tasks; fewer than HOT keys have so many.
HOT = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row a key and its number of rows in n (total in all).

    Hot keys get a salt for each one in HOT of all rows: a broadcast of under HOT keys says which, and their rows of the
    table are repeated for every salt, under 2 * HOT rows in all.
    """
    least = max(1, total // HOT)
    salts = F.when(F.col(n) > least, F.ceil(F.col(n) / least).cast("int")).otherwise(F.lit(1))
    hot = table.where(F.col(n) > least).select(F.col(key).alias("__hot"), salts.alias("__salts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    dealt = dealt.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__hot", "__salts")
    kept = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    return dealt.join(kept, [key, "__salt"]).drop("__salt")
