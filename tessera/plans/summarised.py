"""Reports over evaluations, environments and call-graph maps on stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summaries as su
from .registry import query, table


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("""
WITH t AS (SELECT o_orderpriority, o_custkey, bool_or(o_orderstatus = 'F') AS any_ok FROM orders GROUP BY 1, 2),
a AS (SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 6) AS pass_at_1, round(avg(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1)
SELECT a.*, p.pass_at_n FROM a JOIN (SELECT o_orderpriority, round(avg(any_ok::INT), 6) AS pass_at_n FROM t GROUP BY 1) p USING (o_orderpriority)""")
def validation_pass(spark: SparkSession, d: str) -> DataFrame:
    v = su.validation_pass(table(spark, d, "orders"), "o_orderpriority", "o_custkey", F.col("o_orderstatus") == "F", ["o_totalprice"])
    return _rounded(v, "pass_at_1", "pass_at_n").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""
WITH t AS (SELECT l_suppkey AS e, l_orderkey AS k, count(*) AS turns, sum(l_linenumber) AS ob, sum(l_quantity::INT) AS ac, (l_orderkey % 2)::DOUBLE AS r FROM lineitem GROUP BY 1, 2),
e AS (SELECT e, min(r) AS lo, max(r) AS hi FROM t GROUP BY 1)
SELECT round(avg(r), 6) AS reward, round(sum(ob) / sum(turns)::DOUBLE, 6) AS ob_tokens_per_turn, round(sum(ac) / sum(turns)::DOUBLE, 6) AS ac_tokens_per_turn, round(avg(ob), 6) AS ob_tokens_per_trajectory, round(avg(ac), 6) AS ac_tokens_per_trajectory,
  count(*) AS total_trajectories, sum(turns)::BIGINT AS total_turns, round(sum(turns) / count(*)::DOUBLE, 6) AS turns_per_trajectory,
  (SELECT round(avg((lo = hi AND lo >= 0.5)::INT), 6) FROM e) AS frac_all_good, (SELECT round(avg((lo = hi AND lo < 0.5)::INT), 6) FROM e) AS frac_all_bad, (SELECT round(avg((lo <> hi)::INT), 6) FROM e) AS frac_mixed FROM t""")
def environment_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").withColumn("ac", F.col("l_quantity").cast("int")).withColumn("r", (F.col("l_orderkey") % 2).cast("double"))
    m = su.environment_metrics(s, "l_suppkey", "l_orderkey", "l_linenumber", "ac", "r")
    return _rounded(m, *(c for c in m.columns if not c.startswith("total")))


@query("""
SELECT 'x' AS key, round(avg(value), 6) AS mean FROM events UNION ALL SELECT 'y', round(avg(event_id), 6) FROM events WHERE event_id % 2 = 0""")
def mean_of_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    y = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("text")
    return _rounded(su.mean_of_numbers(e.select(F.create_map(F.lit("x"), F.col("value").cast("string"), F.lit("y"), y, F.lit("z"), F.lit("no")).alias("info")), "info"), "mean")


@query("""
WITH t AS (SELECT l_orderkey, bool_or(l_returnflag = 'N' AND l_linestatus <> 'F') AS hit FROM lineitem GROUP BY 1)
SELECT 'with' AS form, true AS present, count(*) FILTER (hit) AS instances, round(count(*) FILTER (hit) / 1000.0::DOUBLE, 6) AS share FROM t UNION ALL SELECT 'legacy', false, NULL, NULL""")
def unobserved_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") != "F", F.col("l_returnflag") != "N").alias("seen"))
    legacy = n.withColumn("seen", F.lit(None).cast("boolean"))
    parts = [su.unobserved_nodes(x, "l_orderkey", "seen", 1000).withColumn("form", F.lit(f)) for f, x in (("with", n), ("legacy", legacy))]
    return _rounded(parts[0].unionByName(parts[1]), "share")


@query("""
WITH t AS (SELECT l_orderkey, count(*) AS p, count(*) FILTER (l_quantity > 40) AS u FROM lineitem GROUP BY 1)
SELECT 'with' AS form, true AS present, sum(u)::BIGINT AS unobserved, round(avg(u), 6) AS mean, count(*) FILTER (u > 0) AS instances, round(sum(u) / sum(p)::DOUBLE, 6) AS share FROM t UNION ALL SELECT 'legacy', false, NULL, NULL, NULL, NULL""")
def unobserved_callables(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("p"), F.collect_list(F.when(F.col("l_quantity") > 40, F.col("l_linenumber"))).alias("u"))
    parts = [su.unobserved_callables(x, "u", "p").withColumn("form", F.lit(f)) for f, x in (("with", m), ("legacy", m.withColumn("u", F.lit(None).cast("array<int>"))))]
    return _rounded(parts[0].unionByName(parts[1]), "mean", "share")


@query("SELECT count(*) AS n, min(o_totalprice) AS min, round(avg(o_totalprice), 2) AS mean, median(o_totalprice) AS median, max(o_totalprice) AS max FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0")
def hop_distribution(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("ok"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("hops"))
    return su.hop_distribution(o, "ok", "hops").withColumn("mean", F.round("mean", 2))


@query("SELECT o_orderpriority, count(*) AS instances, count(*) FILTER (o_orderstatus = 'F') AS traceable, round(avg((o_orderstatus = 'F')::INT), 6) AS share, round(avg(o_orderkey % 5), 6) AS mean_callables FROM orders GROUP BY 1")
def traceability(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("ok"), (F.col("o_orderkey") % 5).alias("n"))
    return _rounded(su.traceability(o, "o_orderpriority", "ok", "n"), "share", "mean_callables")


@query("""
WITH p AS (SELECT l_shipdate::DATE < DATE '1995-01-01' AS part, l_returnflag, l_orderkey FROM lineitem GROUP BY ALL), a AS (SELECT part, l_returnflag, count(*) AS n, list_sort(list(l_orderkey))[1:3] AS e FROM p GROUP BY 1, 2)
SELECT l_returnflag, sum(n)::BIGINT AS instances, list_aggregate(list_transform(list_sort(flatten(list(e)))[1:3], lambda x: x::VARCHAR), 'string_agg', ',') AS examples, round(sum(n) * 100.0::DOUBLE / 5000, 6) AS percent FROM a GROUP BY 1""")
def category_prevalence(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    early = F.col("l_shipdate").cast("date") < F.lit("1995-01-01").cast("date")
    parts = [su.category_prevalence(line.where(c), "l_returnflag", "l_orderkey", 5000, 3) for c in (early, ~early)]
    out = su.combined_prevalence(parts, "l_returnflag", 5000, 3)
    return _rounded(out, "percent").withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query("""
SELECT count(*) AS samples, count(*) FILTER (o_orderstatus = 'F') AS correct, round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy, round(avg((o_orderkey % 4 = 0)::INT), 6) AS exact_match_rate, round(avg(o_orderkey % 7), 6) AS mean_f1,
  round(avg(o_totalprice), 2) AS mean_seconds, count(*) FILTER (o_orderstatus = 'P') AS errors FROM orders""")
def answer_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumns({"f1": k % 7, "error": F.when(F.col("o_orderstatus") == "P", "timeout")})
    r = su.answer_report(o, F.col("o_orderstatus") == "F", k % 4 == 0, "f1", "o_totalprice", "error")
    return _rounded(r, "accuracy", "exact_match_rate", "mean_f1").withColumn("mean_seconds", F.round("mean_seconds", 2))


@query("SELECT event_type AS tool, count(*) AS uses FROM events GROUP BY 1")
def tool_counts(spark: SparkSession, d: str) -> DataFrame:
    return su.tool_counts(table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("tools")), "tools")


@query("""
SELECT count(*) AS questions, count(*) FILTER (event_id % 3 = 0) AS correct, round(avg((event_id % 3 = 0)::INT), 6) AS accuracy, round(avg(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 10 END), 6) AS mean_rounds,
  (SELECT string_agg(r || '=' || n, ',' ORDER BY r) FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS r, count(*) AS n FROM events GROUP BY 1)) AS ends FROM events""")
def rounds_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, d, "events").select((k % 3 == 0).alias("ok"), F.when(k % 5 != 0, k % 10).alias("rounds"), F.when(k % 4 != 0, F.col("event_type")).alias("reason"))
    r = _rounded(su.rounds_report(e, F.col("ok"), "rounds", "reason"), "accuracy", "mean_rounds")
    return r.withColumn("ends", F.array_join(F.transform(F.map_entries("ends"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ","))


@query("""
SELECT o_orderkey AS l_orderkey, count(DISTINCT l_suppkey) AS num_trajectories, count(l_orderkey) AS steps_used, round(coalesce(avg(l_quantity), 0), 6) AS mean_response_len, coalesce(max(l_quantity), 0) AS max_response_len,
  coalesce(min(l_quantity), 0) AS min_response_len, coalesce(max(l_linenumber), 0) AS max_prompt_len, coalesce(min(l_linenumber), 0) AS min_prompt_len, (count(l_orderkey) = 0)::INT AS empty FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def episode_lengths(spark: SparkSession, d: str) -> DataFrame:
    everything = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return _rounded(su.episode_lengths(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", everything), "mean_response_len")


@query("SELECT (p_size)::INT AS contest, string_agg(p_size || 'A' || p_partkey || ':' || (p_partkey % 2), ',' ORDER BY p_size || 'A' || p_partkey) AS problems FROM part GROUP BY 1")
def contests(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit("A"), F.col("p_partkey").cast("string")).alias("problem"), (F.col("p_partkey") % 2).alias("passed"))
    out = su.by_contest(p, "problem", "passed")
    return out.withColumn("problems", F.array_join(F.transform("problems", lambda x: F.concat_ws(":", x["problem"], x["passed"].cast("string"))), ","))
