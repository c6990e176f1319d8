"""Localisation on stand-ins: line items are reads of parts, their quantities line ranges; events of a user are stack frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import agent_text as at
from ..operators import advantage as adv
from ..operators import callgraph as cg
from ..operators import grouping as grp
from ..operators import ranges as rg
from ..operators import sequence as seq
from .registry import query, table


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Events with a distance of 0 to 1, or -1 off the graph."""
    e = grp.step_positions(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts"])
    return e.withColumn("d", F.when(F.col("event_id") % 4 == 0, F.lit(-1.0)).otherwise(F.col("event_id") % 11 / 10.0))


_STEPS = """(SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step, CASE WHEN event_id % 4 = 0 THEN -1.0 ELSE (event_id % 11) / 10.0 END::DOUBLE AS d FROM events)"""


@query("""
WITH r AS (SELECT DISTINCT l_partkey, l_quantity AS a, l_quantity + 5 AS b FROM lineitem), n AS (SELECT p_partkey, p_size AS x, p_size + 2 AS y, p_retailprice / 3000 AS d FROM part)
SELECT l_partkey, a, round(coalesce(min(d), -1.0), 6) AS distance FROM r LEFT JOIN n ON l_partkey = p_partkey AND a <= y AND b >= x GROUP BY 1, 2""")
def range_overlap_min(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("a"), (F.col("l_quantity") + 5).alias("b")).distinct()
    n = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x"), (F.col("p_size") + 2).alias("y"), (F.col("p_retailprice") / 3000).alias("dist"))
    return rg.overlap_min(r, n, ["k"], ("a", "b"), ("x", "y"), ["k", "a"], "dist").select(F.col("k").alias("l_partkey"), "a", F.round("distance", 6).alias("distance"))


@query("""
WITH q AS (SELECT user_id, event_id % 50 AS s, event_id % 50 + 10 AS e, event_id AS ord FROM events WHERE event_id % 2 = 0), p AS (SELECT event_id, user_id, (value)::BIGINT % 60 AS pt FROM (SELECT *, floor(value) AS value FROM events) WHERE event_id % 2 = 1)
SELECT event_id, min(ord) AS ord FROM p JOIN q ON p.user_id = q.user_id AND pt BETWEEN s AND e GROUP BY 1""".replace("(SELECT *, floor(value) AS value FROM events)", "(SELECT event_id, user_id, floor(value) AS value FROM events)"))
def first_enclosing_range(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    q = e.where("event_id % 2 = 0").select("user_id", (F.col("event_id") % 50).alias("s"), (F.col("event_id") % 50 + 10).alias("e"), F.col("event_id").alias("ord"))
    p = e.where("event_id % 2 = 1").select("event_id", "user_id", (F.floor("value") % 60).alias("pt"))
    return rg.first_enclosing(p, q, "user_id", "pt", "s", "e", "ord", ["event_id"]).select("event_id", "ord")


@query(f"""
SELECT user_id, count(*) AS n_steps, count(*) FILTER (d >= 0) AS n_on_graph, coalesce(min(step) FILTER (d >= 0 AND d < 1e-6), -1)::BIGINT AS step_to_root, round(coalesce(min(d) FILTER (d >= 0), -1.0), 6) AS min_distance FROM {_STEPS} GROUP BY 1""")
def trajectory_localisation(spark: SparkSession, d: str) -> DataFrame:
    return rg.trajectory_localisation(_steps(spark, d), ["user_id"], "step_idx", "d").withColumn("min_distance", F.round("min_distance", 6))


@query(f"""
WITH t AS (SELECT user_id, count(*) FILTER (d >= 0) AS g, coalesce(min(step) FILTER (d >= 0 AND d < 1e-6), -1) AS s FROM {_STEPS} GROUP BY 1)
SELECT count(*) AS n, round(count(*) FILTER (s >= 0) / count(*)::DOUBLE, 6) AS hit_rate, round(count(*) FILTER (g > 0) / count(*)::DOUBLE, 6) AS on_graph_rate, round(avg(s) FILTER (s >= 0), 6) AS mean_step,
  quantile_cont(s::DOUBLE, 0.5) FILTER (s >= 0) AS median_step, min(s) FILTER (s >= 0) AS min_step, max(s) FILTER (s >= 0) AS max_step FROM t""")
def localisation_summary(spark: SparkSession, d: str) -> DataFrame:
    s = rg.localisation_summary(rg.trajectory_localisation(_steps(spark, d), ["user_id"], "step_idx", "d"))
    return s.select("n", *(F.round(c, 6).alias(c) for c in ("hit_rate", "on_graph_rate", "mean_step")), "median_step", "min_step", "max_step")


@query("""
SELECT CASE WHEN d < 0.2 THEN '0.0-0.2' WHEN d < 0.4 THEN '0.2-0.4' WHEN d < 0.6 THEN '0.4-0.6' WHEN d < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM (SELECT l_quantity / 50 AS d FROM lineitem) GROUP BY 1""")
def distance_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(rg.distance_bucket(F.col("l_quantity") / 50).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""
WITH x AS (SELECT value - 50 AS a, d, CASE WHEN d < 0 THEN value - 50 WHEN value > 50 THEN (value - 50) * pow(3.0, 1 - d) WHEN value < 50 THEN (value - 50) * pow(3.0, d - 1) ELSE 0 END AS r FROM {_STEPS})
SELECT count(*) FILTER (d >= 0) AS n_on_graph, count(*) FILTER (d < 0) AS n_off_graph, round(avg(r / a) FILTER (d >= 0 AND a <> 0), 6) AS mean_factor, round(avg(a) FILTER (a > 0), 6) AS mean_positive_before, round(avg(r) FILTER (a > 0), 6) AS mean_positive_after, round(avg(r) FILTER (a < 0), 6) AS mean_negative_after FROM x""")
def reshape_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d).withColumn("a", F.col("value") - 50)
    m = rg.reshape_metrics(s.withColumn("r", adv.reshaped(F.col("a"), F.col("d"))), "a", "r", "d")
    return m.select("n_on_graph", "n_off_graph", *(F.round(c, 6).alias(c) for c in ("mean_factor", "mean_positive_before", "mean_positive_after", "mean_negative_after")))


@query("""
WITH f AS (SELECT user_id, event_type, event_type = 'purchase' AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
h AS (SELECT user_id, event_type, min(CASE WHEN p THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - k AS hop FROM f),
m AS (SELECT user_id % 7 AS instance, event_type || '.py::f' AS node, min(hop) AS hop FROM h WHERE hop IS NOT NULL GROUP BY 1, 2)
SELECT instance, node, hop::INT AS hop_distance, round(hop / greatest(1, max(hop) OVER (PARTITION BY instance))::DOUBLE, 6) AS normalized_distance FROM m""")
def call_graph_hops(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").select("user_id", "ts", (F.col("user_id") % 7).alias("instance"), F.concat("event_type", F.lit(".py::f")).alias("node"), "event_type")
    g = cg.trace_hops(f, ["user_id"], ["ts"], F.col("event_type") == "purchase", "instance", "node")
    return g.select("instance", "node", F.col("hop_distance").cast("int").alias("hop_distance"), F.round("normalized_distance", 6).alias("normalized_distance"))


@query("""
SELECT o_custkey, len(list_intersect(f, o))::INT AS both, len(list_filter(f, lambda x: NOT list_contains(o, x)))::INT AS unobserved, len(list_filter(o, lambda x: NOT list_contains(f, x)))::INT AS extra
FROM (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS f, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS o FROM orders GROUP BY 1)""")
def observed_and_expected(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(pick("F").alias("f"), pick("O").alias("o"))
    return o.select("o_custkey", cg.set_report(F.col("o"), F.col("f")).alias("r")).select("o_custkey", "r.*")


@query("""
SELECT CASE WHEN e > 12 THEN 'error' WHEN p = 0 AND w = 0 THEN 'no_callable' WHEN p = 0 THEN 'only_new' WHEN t = 0 THEN 'no_trace' WHEN s = 0 THEN 'all_unobserved' WHEN s < p THEN 'partly_observed' WHEN w > 0 THEN 'observed_with_new' ELSE 'all_pass' END AS case_type, count(*) AS n
FROM (SELECT c_custkey % 14 AS e, c_custkey % 3 AS p, c_custkey % 2 AS w, c_custkey % 5 AS t, c_custkey % 4 AS s FROM customer) GROUP BY 1""")
def case_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").groupBy(at.case_type(k % 3, k % 2, k % 5, k % 4, k % 14 > 12).alias("case_type")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 5000 AND c_mktsegment = 'BUILDING' THEN 'rich+building' WHEN c_acctbal > 5000 THEN 'rich' WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'none' END AS category FROM customer""")
def static_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", cg.static_category({"rich": F.col("c_acctbal") > 5000, "building": F.col("c_mktsegment") == "BUILDING"}).alias("category"))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY hop DESC NULLS LAST, o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 10 END AS hop FROM orders)) WHERE r <= 3""")
def hop_sorted_nodes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("hop", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 10))
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("hop"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


@query("""
SELECT user_id, count(*) AS n_frames, NOT (user_id % 4 = 0 AND count(*) > 3 OR user_id % 4 = 1 AND count(*) > 5) AS cumulative FROM events GROUP BY 1""")
def cumulative_check(spark: SparkSession, d: str) -> DataFrame:
    """Messages grow step by step, but for users whose third step changes an earlier one, or whose fifth begins anew."""
    s = grp.step_positions(table(spark, d, "events").select("user_id", "ts"), ["user_id"], ["ts"])
    k, user = F.col("step_idx"), F.col("user_id") % 4
    grown = F.sequence(F.lit(0).cast("long"), k)
    changed = F.concat(F.array(F.lit(-1).cast("long")), F.slice(grown, F.lit(2), F.size(grown)))
    s = s.withColumn("m", F.when((user == 0) & (k == 3), changed).when((user == 1) & (k == 5), F.slice(grown, F.lit(1), F.lit(1))).otherwise(grown))
    return seq.is_cumulative(s, ["user_id"], ["ts"], "m").join(s.groupBy("user_id").agg(F.count("*").alias("n_frames")), "user_id")
