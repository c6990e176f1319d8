"""Trace and experiment stores on tables without keys: merges that keep one row, queries by optional criteria, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str], updated: str, created: str) -> DataFrame:
    """One row a key: the latest, with the earliest creation time. Of equal times new beats old."""
    both = old.withColumn("__s", F.lit(0)).unionByName(new.withColumn("__s", F.lit(1)))
    w = Window.partitionBy(*key)
    kept = both.withColumn(created, F.min(created).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc(updated), F.desc("__s"))))
    return kept.where("__r = 1").select(*old.columns)


def replaced_links(links: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Links of the owners in ``new`` are replaced as a whole."""
    return links.join(new.select(owner).distinct(), owner, "left_anti").select(*links.columns).unionByName(new)


def session_links(traces: DataFrame, trace: str, chain: str, created: str) -> DataFrame:
    """A trace shows in its session and in all that session's ancestors."""
    return traces.select(F.col(trace).alias("trace_id"), F.explode(F.array_distinct(chain)).alias("session_uid"), F.col(created).alias("created_at"))


def traces_where(traces: DataFrame, links: DataFrame | None = None, sessions: Sequence | None = None, context: str | None = None, namespace: str | None = None, since: float | None = None, limit: int = 0) -> DataFrame:
    """Distinct traces by the criteria given; ``since`` is about the link's time if sessions are given; a limit of 0 is none."""
    out = traces
    if sessions is not None and links is not None:
        hit = links.where(F.col("session_uid").isin(*sessions))
        hit = hit if since is None else hit.where(F.col("created_at") >= since)
        out = out.join(hit.select(F.col("trace_id").alias("id")).distinct(), "id", "left_semi")
    elif since is not None:
        out = out.where(F.col("created_at") >= since)
    if context is not None:
        out = out.where(F.col("context_type") == context)
    if namespace is not None:
        out = out.where(F.col("namespace") == namespace)
    out = out.orderBy("created_at", "id") if limit else out
    return out.limit(limit) if limit else out


def listed(df: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, order: Sequence[Column] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Optional conditions; a null value sets none; like ignores the case of ASCII letters."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in (like or {}).items():
        df = df if not v else df.where(F.col(c).ilike(f"%{v}%"))
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """n_<name> of each kind of child, zeros shown."""
    for name, child in children.items():
        parents = parents.join(child.groupBy(key).agg(F.count("*").alias(f"n_{name}")), key, "left")
    return parents.fillna(0, [f"n_{name}" for name in children])


def cascaded(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone.select(key).distinct(), key, "left_anti")


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def preference_rows(df: DataFrame, key: Sequence[str], chosen: str, rejected: str) -> DataFrame:
    """Two rows a pair: role and messages."""
    return df.select(*key, F.stack(F.lit(2), F.lit("chosen"), F.col(chosen), F.lit("rejected"), F.col(rejected)).alias("role", "messages"))


def packed_extras(df: DataFrame, known: Sequence[str], out: str = "extra_json") -> DataFrame:
    """Columns that the table doesn't have, as JSON."""
    rest = [c for c in df.columns if c not in known]
    return df.select(*(c for c in known if c in df.columns), F.to_json(F.struct(*rest)).alias(out) if rest else F.lit("{}").alias(out))
