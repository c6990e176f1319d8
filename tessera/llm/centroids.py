"""Centroid clustering of quantised vectors by weighted deduplication.

1. Components become integers; equal vectors become one row with its multiplicity, so a round reads every
   distinct vector once, however many copies there are.
2. Each round of Lloyd sends the centroids (``clusters`` rows) to all tasks; a task assigns its distinct vectors
   and returns one row a cluster, the weighted sums. They are added exactly, and the floors are the new centroids.
3. After the last assignment the clusters of distinct vectors are joined back to the ids; a vector with very many
   copies is dealt to several tasks.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; a
component whose integer is beyond ``LARGEST`` counts as ``LARGEST`` with its sign, so that every distance fits a long; repeated rows
count each for itself; a null id is kept, but such a vector is the last to start a centroid; of several vectors
of one id the one with the lesser bytes starts first; with fewer vectors
than clusters each vector starts one; an inertia beyond a long is null; an empty table gives an empty result; only the id and
vector columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free_name, named, spread_join, written

CLUSTERS, ROUNDS, DIMENSIONS, LEVELS = 40, 5, 64, 256
#: Distances of up to 64 components of twice this size fit a long.
LARGEST = 1 << 27
#: Products of components below this are exact in doubles, summed over 64 of them.
EXACT = 1 << 22


def integers(column: pa.Array, dimensions: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integer components)."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = column.filter(right).flatten().cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    fine = np.isfinite(x).all(1)
    with np.errstate(over="ignore"):
        return at[fine], np.clip(np.floor(x[fine] * levels), -LARGEST, LARGEST).astype(np.int64)


def keys_of(x: np.ndarray) -> list[bytes]:
    """One byte string a vector, equal for equal vectors: two bytes a component where all fit, else four."""
    small = (np.abs(x) < 1 << 15).all(1) if len(x) else np.zeros(0, bool)
    narrow, wide = x.astype("<i2"), x.astype("<i4")
    return [(n if s else w).tobytes() for s, n, w in zip(small, narrow, wide, strict=True)]


def vectors_of(column: pa.Array, dimensions: int) -> np.ndarray:
    out = np.empty((len(column), dimensions), np.int64)
    for k, b in enumerate(column.to_pylist()):
        out[k] = np.frombuffer(b, "<i2" if len(b) == 2 * dimensions else "<i4")
    return out


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, levels: int) -> DataFrame:
    """id and key of every kept vector."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, x = integers(batch.column(1), dimensions, levels)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys_of(x), pa.binary())], names=["id", "key"])

    return vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("x")).mapInArrow(run, "id long, key binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row, exactly; ties go to the smaller number."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        p, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best.astype(np.int32), d[np.arange(len(d)), best].astype(np.int64)


def weighted_sums(x: np.ndarray, n: np.ndarray) -> list[int]:
    """Exact componentwise sums of n copies of each row."""
    if float(np.abs(x).max(initial=0)) * float(n.sum(dtype=np.float64)) < 2.0**62:
        return [int(s) for s in (x * n[:, None]).sum(0)]
    return list((x.astype(object) * n.astype(object)[:, None]).sum(0))


def sums_by_cluster(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, componentwise sums) of one assignment; one row a cluster and task is shuffled, one a cluster collected."""
    k, dimensions = centroids.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * k, [[0] * dimensions for _ in range(k)]
        for batch in it:
            x, w = vectors_of(batch.column(0), dimensions), batch.column(1).to_numpy()
            best, _ = nearest(x, centroids)
            for c in np.unique(best).tolist():
                mine = best == c
                n[c] += int(w[mine].sum())
                total[c] = [a + b for a, b in zip(total[c], weighted_sums(x[mine], w[mine]), strict=True)]
        full = [c for c in range(k) if n[c]]
        sums = pa.array([[Decimal(s) for s in total[c]] for c in full], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([n[c] for c in full], pa.int64()), sums], names=["cluster", "n", "sums"])

    rows = distinct.select("key", "n").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    added = rows.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimensions)))
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(dimensions)]) for r in added.collect()}


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Centroids at the floors of their vectors' means; empty ones stay."""
    out = centroids.copy()
    for c, (n, total) in sums.items():
        out[c] = [s // n for s in total]
    return out


def first_vectors(rows: DataFrame, clusters: int, dimensions: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = rows.orderBy(order.asc_nulls_last(), "key").limit(clusters).collect()
    return vectors_of(pa.array([bytes(r["key"]) for r in start], pa.binary()), dimensions)


def with_clusters(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, n, cluster and distance of every distinct vector."""
    dimensions = centroids.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            best, d = nearest(vectors_of(batch.column(0), dimensions), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), pa.array(d)], names=["key", "n", "cluster", "distance"])

    return distinct.select("key", "n").mapInArrow(run, "key binary, n long, cluster int, distance long")


def centroid_clusters(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, levels: int = LEVELS, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid (its final integers) of every kept vector."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, dimensions, levels)
    distinct = written(rows.groupBy("key").agg(F.count("*").alias("n")), "centroids")
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    centroids = first_vectors(rows, clusters, dimensions, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"`{free_name(id_col, names)}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(centroids, sums_by_cluster(distinct, centroids))
    final = written(with_clusters(distinct, centroids), "centroids")
    weight = F.col("n").cast("decimal(38,0)")
    by_cluster = {r["cluster"]: (int(r["n"]), int(r["inertia"])) for r in final.groupBy("cluster").agg(F.sum(weight).alias("n"), F.sum(weight * F.col("distance")).cast("decimal(38,0)").alias("inertia")).collect()}
    total = sum(n for n, _ in by_cluster.values())

    def fits(x: int) -> int | None:
        return x if x < 1 << 63 else None

    everything = fits(sum(i for _, i in by_cluster.values()))
    info = [(c, fits(i), everything, centroids[c].tolist()) for c, (_, i) in sorted(by_cluster.items())]
    info = spark.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = spread_join(rows, final, "key", "n", total).join(F.broadcast(info), "cluster")
    return out.select(F.col("id").alias(free_name(id_col, names)), *names)
