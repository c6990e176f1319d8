"""Interval joins on a shared key, and what localisation reports make of them.

Keys with few ranges join as they are, with the range as residual. On a key with more than ``FEW`` ranges pairs are
never formed: lines are the leaves of a binary tree, a range is at most two nodes on each level, and least
values by (key, node) answer all queries by equi-joins. So rows grow with the logarithm of line numbers, and a hot key is dealt by node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR = 1e-6
#: Levels of the tree: line numbers are below 2^31.
LEVELS = 31
FEW = 256


def tree_nodes(start: Column, end: Column) -> Column:
    """The nodes (level, place) that make up the whole numbers from start to end; none if it is empty. Numbers below 0 count as 0."""
    node = lambda level, place: F.struct(level.cast("int").alias("level"), place.alias("place"))
    empty = F.array().cast("array<struct<level:int,place:bigint>>")
    first = F.struct(F.greatest(F.ceil(start).cast("long"), F.lit(0)).alias("a"), (F.floor(end).cast("long") + 1).alias("b"), empty.alias("out"))

    def climb(s: Column, level: Column) -> Column:
        # what is left to take at this level begins at a and ends before b
        left, right = (s["a"] < s["b"]) & (s["a"] % 2 == 1), (s["a"] < s["b"]) & (s["b"] % 2 == 1)
        taken = F.concat(s["out"], F.when(left, F.array(node(level, s["a"]))).otherwise(empty), F.when(right, F.array(node(level, s["b"] - 1))).otherwise(empty))
        return F.struct(F.shiftright(F.when(left, s["a"] + 1).otherwise(s["a"]), 1).alias("a"), F.shiftright(F.when(right, s["b"] - 1).otherwise(s["b"]), 1).alias("b"), taken.alias("out"))

    width = _width(start, end)
    last = F.when(width > 1, F.least(F.length(F.bin(width)) - 1, F.lit(LEVELS))).otherwise(0)  # a node on a level k has 2^k numbers
    return F.aggregate(F.sequence(F.lit(0), last), first, climb, lambda s: s["out"])


def _width(start: Column, end: Column) -> Column:
    return F.floor(end).cast("long") + 1 - F.greatest(F.ceil(start).cast("long"), F.lit(0))


def last_level(ranges: DataFrame, start: str, end: str) -> int:
    """The highest level on which a range of the table has a node."""
    widest = ranges.agg(F.max(_width(F.col(start), F.col(end)))).first()[0] or 1
    return min(max(widest, 1).bit_length() - 1, LEVELS)


def ancestors(point: Column, last: int = LEVELS) -> Column:
    """The nodes that hold a whole number, up to a level."""
    place = F.greatest(point.cast("long"), F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(place / F.pow(F.lit(2.0), k)).cast("long").alias("place")))


def _kinds(*parts: tuple[int, Column]) -> Column:
    """(kind, level, place) of nodes, each part under its kind."""

    def of(kind: int, nodes: Column) -> Column:
        return F.transform(nodes, lambda n: F.struct(F.lit(kind).alias("__kind"), n["level"].alias("__level"), n["place"].alias("__place")))

    return F.concat(*(of(k, nodes) for k, nodes in parts))


#: Kinds of rows that meet: pairs of a key with few ranges; what begins within; what holds the beginning.
PAIRS, BEGINS, HOLDS, NOTHING = 0, 1, 2, -1
_ON = ["__kind", "__level", "__place"]


def _one(kind: int) -> Column:
    return F.array(F.struct(F.lit(kind).alias("__kind"), F.lit(0).alias("__level"), F.lit(0).cast("long").alias("__place")))


#: Hot keys up to this number are broadcast.
MOST_SENT = 50_000


def hot_keys(ranges: DataFrame, keys: Sequence[str], few: int) -> DataFrame | None:
    """Keys with more than few ranges, to be broadcast; None if there are none.

    Where over MOST_SENT keys have so many, the bar is doubled until no more are over it, so a key under the bar has fewer than
    2 / MOST_SENT of all ranges: pairs on so many middling keys are cheaper than their nodes.
    """
    counted = ranges.groupBy(*keys).agg(F.count("*").alias("__n"))
    bars = [min(few << k, 1 << 62) for k in range(48)]
    over = counted.where(F.col("__n") > few).agg(*(F.count_if(F.col("__n") > b) for b in bars)).first()
    bar, n = next((b, n) for b, n in zip(bars, over, strict=True) if n <= MOST_SENT)
    return F.broadcast(counted.where(F.col("__n") > bar).select(*keys, F.lit(True).alias("__hot"))) if n else None


def _least_by_pairs(queries: DataFrame, ranges: DataFrame, keys: Sequence[str], ids: Sequence[str], query: tuple[str, str], span: tuple[str, str], value: str) -> DataFrame:
    """ids and the least value met, null if none, over the pairs of a key."""
    q, n = queries.alias("q"), ranges.alias("n")
    hit = (F.col(f"q.{query[0]}") <= F.col(f"n.{span[1]}")) & (F.col(f"q.{query[1]}") >= F.col(f"n.{span[0]}")) & (F.col(f"q.{query[0]}") <= F.col(f"q.{query[1]}"))
    for k in keys:
        hit = hit & (F.col(f"q.{k}") == F.col(f"n.{k}"))
    return q.join(n, hit, "left").groupBy(*(F.col(f"q.{c}").alias(c) for c in ids)).agg(F.min(f"n.{value}").alias("__v"))


def _dealt(ranges: DataFrame, hot: DataFrame, keys: Sequence[str], span: tuple[str, str], value: str, kinds: Sequence[int]) -> DataFrame:
    """keys, the node, __x, __y and the least value: ranges of few as they are, of hot keys one row a node."""
    r = ranges.select(*keys, F.col(span[0]).alias("__x"), F.col(span[1]).alias("__y"), F.col(value).alias("__v")).join(hot, [*keys], "left")
    parts = {BEGINS: ancestors(F.ceil("__x")), HOLDS: tree_nodes(F.col("__x"), F.col("__y"))}
    nodes = F.when(F.col("__hot"), _kinds(*((k, parts[k]) for k in kinds))).otherwise(_one(PAIRS))
    dealt = r.select(*keys, "__x", "__y", "__v", F.inline(nodes)).withColumns({c: F.when(F.col("__kind") == PAIRS, F.col(c)) for c in ("__x", "__y")})
    return dealt.groupBy(*keys, *_ON, "__x", "__y").agg(F.min("__v").alias("__v"))


def _least(asked: DataFrame, dealt: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """ids and the least value met, null if none; a query is read once, whatever its kind."""
    q, n = asked.alias("q"), dealt.alias("n")
    hit = (F.col("q.__kind") != PAIRS) | ((F.col("q.__a") <= F.col("n.__y")) & (F.col("q.__b") >= F.col("n.__x")))
    for k in [*keys, *_ON]:
        hit = hit & (F.col(f"q.{k}") == F.col(f"n.{k}"))
    return q.join(n, hit, "left").groupBy(*(F.col(f"q.{c}").alias(c) for c in ids)).agg(F.min("n.__v").alias("__v"))


def overlap_min(
    reads: DataFrame, nodes: DataFrame, key: Sequence[str], read: tuple[str, str], node: tuple[str, str], read_id: Sequence[str], distance: str, out: str = "distance", few: int = FEW
) -> DataFrame:
    """Least distance of the nodes whose range of whole numbers overlaps a read's, -1 if none; rows of one read_id are one read. A read that ends before it begins meets nothing.

    A range overlaps if it begins within the read, or holds the read's beginning.
    """
    hot = hot_keys(nodes, key, few)
    if hot is None:
        return _least_by_pairs(reads, nodes, key, read_id, read, node, distance).select(*read_id, F.coalesce("__v", F.lit(-1.0)).alias(out))
    cols = [*dict.fromkeys([*key, *read_id])]
    r = reads.select(*cols, F.col(read[0]).alias("__a"), F.col(read[1]).alias("__b")).join(hot, [*key], "left")
    parts = _kinds((BEGINS, tree_nodes(F.col("__a"), F.col("__b"))), (HOLDS, ancestors(F.ceil("__a"), last_level(nodes, *node))))
    nothing = F.coalesce(F.col("__a") > F.col("__b"), F.lit(True))
    asked = r.select(*cols, "__a", "__b", F.inline(F.when(nothing, _one(NOTHING)).when(F.col("__hot"), parts).otherwise(_one(PAIRS))))
    met = _least(asked, _dealt(nodes, hot, key, node, distance, (BEGINS, HOLDS)), key, read_id)
    return met.select(*read_id, F.coalesce("__v", F.lit(-1.0)).alias(out))


def first_enclosing(points: DataFrame, ranges: DataFrame, key: str, point: str, start: str, end: str, order: str, point_id: Sequence[str], few: int = FEW, carry: Sequence[str] = ()) -> DataFrame:
    """The first range in list order that holds each point (a whole number), with its columns in carry; points in none drop out."""
    hot = hot_keys(ranges, [key], few)
    listed = ranges.withColumn("__f", F.struct(F.col(order).alias("o"), *carry, F.col(start).alias("s")))
    if hot is None:
        met = _least_by_pairs(points, listed, [key], point_id, (point, point), (start, end), "__f").where("__v is not null")
        return met.select(*point_id, F.col("__v.s").alias(start), F.col("__v.o").alias(order), *(F.col(f"__v.{c}").alias(c) for c in carry))
    cols = [*dict.fromkeys([key, *point_id])]
    p = points.select(*cols, F.col(point).alias("__a"), F.col(point).alias("__b")).join(hot, key, "left")
    asked = p.select(*cols, "__a", "__b", F.inline(F.when(F.col("__a").isNull(), _one(NOTHING)).when(F.col("__hot"), _kinds((HOLDS, ancestors(F.col("__a"), last_level(ranges, start, end))))).otherwise(_one(PAIRS))))
    met = _least(asked, _dealt(listed, hot, [key], (start, end), "__f", (HOLDS,)), [key], point_id).where("__v is not null")
    return met.select(*point_id, F.col("__v.s").alias(start), F.col("__v.o").alias(order), *(F.col(f"__v.{c}").alias(c) for c in carry))


def step_distances(steps: DataFrame, step_id: Sequence[str], reads: str, key: Sequence[str], nodes: DataFrame, node: tuple[str, str], distance: str, few: int = FEW) -> DataFrame:
    """step_id and the least distance of all the graph's nodes that a step's reads (array of file_path, start_line, end_line) show, -1 if none.

    Nodes have the columns of ``key`` (which the steps have too), file_path, their range and distance.
    """
    shown = steps.select(*dict.fromkeys([*step_id, *key]), F.explode_outer(reads).alias("__r")).select("*", "__r.*").drop("__r")
    return overlap_min(shown, nodes, [*key, "file_path"], ("start_line", "end_line"), node, step_id, distance, few=few)


def distance_bucket(d: Column) -> Column:
    """Five half-open buckets of a normalised distance."""
    return F.when(d < 0, "off").when(d < 0.2, "0.0-0.2").when(d < 0.4, "0.2-0.4").when(d < 0.6, "0.4-0.6").when(d < 0.8, "0.6-0.8").otherwise("0.8-1.0")


def trajectory_localisation(df: DataFrame, trajectory: Sequence[str], step: str, distance: str) -> DataFrame:
    """n_steps, n_on_graph, step_to_root (first step at distance 0, else -1), min_distance (-1 if never on the graph)."""
    on = F.col(distance) >= 0
    return df.groupBy(*trajectory).agg(
        F.count("*").alias("n_steps"), F.count_if(on).alias("n_on_graph"),
        F.coalesce(F.min(F.when(on & (F.col(distance) < NEAR), F.col(step))), F.lit(-1)).cast("long").alias("step_to_root"),
        F.coalesce(F.min(F.when(on, F.col(distance))), F.lit(-1.0)).alias("min_distance"),
    )


def localisation_summary(per: DataFrame) -> DataFrame:
    """Rates with at least one as denominator, and the steps to the root cause of those that reached it."""
    n, hit = F.greatest(F.count("*"), F.lit(1)), F.col("step_to_root") >= 0
    step = F.when(hit, F.col("step_to_root"))
    return per.agg(
        F.count("*").alias("n"), (F.count_if(hit) / n).alias("hit_rate"), (F.count_if(F.col("n_on_graph") > 0) / n).alias("on_graph_rate"),
        F.coalesce(F.avg(step), F.lit(-1.0)).alias("mean_step"), F.coalesce(F.percentile(step, 0.5), F.lit(-1.0)).alias("median_step"), F.coalesce(F.min(step), F.lit(-1)).alias("min_step"), F.coalesce(F.max(step), F.lit(-1)).alias("max_step"),
    )


def reshape_metrics(df: DataFrame, advantage: str, reshaped: str, distance: str) -> DataFrame:
    a, r, on = F.col(advantage), F.col(reshaped), F.col(distance) >= 0
    factor = F.when(on & (a != 0), r / a)
    return df.agg(
        F.count_if(on).alias("n_on_graph"), F.count_if(~on).alias("n_off_graph"), F.avg(factor).alias("mean_factor"), F.max(factor).alias("max_factor"), F.min(factor).alias("min_factor"),
        F.avg(F.when(a > 0, a)).alias("mean_positive_before"), F.avg(F.when(a > 0, r)).alias("mean_positive_after"), F.avg(F.when(a < 0, a)).alias("mean_negative_before"), F.avg(F.when(a < 0, r)).alias("mean_negative_after"),
    )


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key, by order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")
