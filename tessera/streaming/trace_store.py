"""A trace store without keys of its own: a log of runs by key bucket, merged when read and compacted bucket by bucket.

A batch is written once, as a run that holds only the buckets of its keys; nothing else is read or rewritten. A manifest
names the runs of each bucket, so a batch counts from the moment its manifest is there, and not before. A bucket
with more than ``most_runs`` of them is merged into one. Runs that neither the newest manifest nor the one before
names are deleted, so a reader may finish what it began.

    folder/run=7/bucket=3/part-...parquet
    folder/manifests/12.json
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

RUN, BUCKET = "run", "bucket"


class TraceStore:
    """One writer at a time; a second one fails at its manifest, which is created and never overwritten."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], updated: str, created: str, buckets: int = 64, most_runs: int = 4) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), list(key)
        self.updated, self.created, self.buckets, self.most_runs = updated, created, buckets, most_runs

    # files

    def _path(self, *parts: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        p = self._path(*parts)
        return [s.getPath().getName() for s in self._fs().listStatus(p)] if self._fs().exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        """next: the number of the next run; runs: those of each bucket, oldest first; streams: the last batch of each; schema."""
        known = self.versions()
        if not known:
            return {"version": 0, "next": 0, "runs": {}, "streams": {}, "schema": None}
        path = self._path("manifests", f"{version or known[-1]}.json")
        with_text = self.spark.read.option("wholetext", True).text(path.toString())
        return json.loads(with_text.first()["value"])

    def _commit(self, state: dict[str, Any]) -> None:
        state["version"] += 1
        target, draft = self._path("manifests", f"{state['version']}.json"), self._path("manifests", f"_draft-{state['version']}")
        out = self._fs().create(draft, True)
        out.write(json.dumps(state).encode())
        out.close()
        if self._fs().exists(target) or not self._fs().rename(draft, target):
            raise RuntimeError(f"another writer has committed version {state['version']} of {self.folder}")

    # writing

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key: the latest, of equal times that of the later run, with the earliest creation time."""
        rest = [c for c in rows.columns if c not in (*self.key, self.created, RUN, BUCKET)]
        last = F.max_by(F.struct(*rest), F.struct(self.updated, RUN)).alias("__last")
        one = rows.groupBy(*self.key).agg(last, F.min(self.created).alias(self.created))
        return one.select(*self.key, self.created, *(F.col("__last")[c].alias(c) for c in rest))

    def _write(self, rows: DataFrame, run: int) -> list[int]:
        """The buckets that were written. A run of this number that nobody committed is overwritten."""
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).mode("overwrite").parquet(self._path(f"{RUN}={run}").toString())
        return sorted(int(n.partition("=")[2]) for n in self._names(f"{RUN}={run}") if n.startswith(f"{BUCKET}="))

    def _bucket(self) -> Any:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def append(self, batch: DataFrame, epoch: int, stream: str = "") -> list[int]:
        """Adds a batch of a stream; one that is there already changes nothing. The buckets that it touched."""
        state = self.manifest()
        if state["streams"].get(stream, -1) >= epoch:
            return []
        known = T.StructType.fromJson(json.loads(state["schema"])) if state["schema"] else batch.schema
        rows = self._merged(batch.select(*known.names).withColumn(RUN, F.lit(0))).select(*known.names)
        run = state["next"]
        touched = self._write(rows, run)
        for b in touched:
            state["runs"].setdefault(str(b), []).append(run)
        self._commit(state | {"next": run + 1, "streams": state["streams"] | {stream: epoch}, "schema": known.json()})
        full = [b for b in touched if len(state["runs"][str(b)]) > self.most_runs]
        if full:
            self.compact(full)
        return touched

    def compact(self, buckets: Sequence[int]) -> None:
        """Merges the runs of these buckets into one and deletes what no manifest needs."""
        state = self.manifest()
        run = state["next"]
        self._write(self._merged(self._rows(state, buckets)), run)
        for b in buckets:
            state["runs"][str(b)] = [run]
        self._commit(state | {"next": run + 1})
        self._vacuum()

    def _vacuum(self) -> None:
        versions = self.versions()
        for v in versions[:-2]:
            self._fs().delete(self._path("manifests", f"{v}.json"), False)
        states = [self.manifest(v) for v in versions[-2:]]
        needed = {(r, int(b)) for s in states for b, runs in s["runs"].items() for r in runs}
        for name in self._names():
            run = name.partition("=")[2]
            if not run.isdigit() or int(run) >= states[-1]["next"]:
                continue
            held = [int(n.partition("=")[2]) for n in self._names(name) if n.startswith(f"{BUCKET}=")]
            gone = [b for b in held if (int(run), b) not in needed]
            for path in [self._path(name)] if len(gone) == len(held) else [self._path(name, f"{BUCKET}={b}") for b in gone]:
                self._fs().delete(path, True)

    # reading

    def _rows(self, state: dict[str, Any], buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"])).add(RUN, T.LongType()).add(BUCKET, T.IntegerType())
        wanted = state["runs"] if buckets is None else {str(b): state["runs"][str(b)] for b in buckets if str(b) in state["runs"]}
        paths = [self._path(f"{RUN}={r}", f"{BUCKET}={b}").toString() for b, runs in wanted.items() for r in runs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*paths)

    def read(self) -> DataFrame | None:
        """One row a key of all committed batches; None before the first."""
        state = self.manifest()
        if not state["schema"]:
            return None
        return self._merged(self._rows(state)).select(*json_names(state["schema"]))

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys; only their buckets are read."""
        state = self.manifest()
        if not state["schema"]:
            return None
        named = keys.select(*self.key)
        buckets = [r[0] for r in named.select(self._bucket()).distinct().collect()]  # as many as there are buckets at most
        rows = self._rows(state, buckets).join(named.distinct(), self.key, "left_semi")
        return self._merged(rows).select(*json_names(state["schema"]))


def json_names(schema: str) -> list[str]:
    return T.StructType.fromJson(json.loads(schema)).names


def ingested(stream: DataFrame, store: TraceStore, checkpoint: str, sessions: str | None = None, refused: str | None = None) -> StreamingQuery:
    """Appends all input there is now, batch by batch, and ends; started again with its checkpoint it goes on where it was.

    With ``sessions``, rows that name no session can't be found by one: they go to the folder ``refused``, a part for each batch.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        if sessions is not None:
            lost = F.coalesce(F.size(sessions), F.lit(0)) <= 0
            if refused is not None:
                batch.where(lost).write.mode("overwrite").parquet(f"{refused.rstrip('/')}/batch={epoch}")
            batch = batch.where(~lost)
        store.append(batch, epoch, checkpoint)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flushed(query: StreamingQuery) -> None:
    """Returns when all input that was there at the call is in the store."""
    query.processAllAvailable() if query.isActive else query.awaitTermination()
