"""Rollout groups on stand-ins: orders of a customer are the rollouts of a task, events of a user its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advantage as adv
from ..operators import grouping as grp
from ..operators import sequence as seq
from .registry import query, table

#: A reward of 0 or 1, and a graded one with gaps.
WON = "CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END"


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.expr("cast(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END as double)").alias("won"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")


@query("""
SELECT o_orderkey, o_custkey, round(CASE WHEN n = 1 THEN r WHEN s > 1e-8 THEN (r - m) / s ELSE r - m END, 6) AS advantage
FROM (SELECT o_orderkey, o_custkey, o_totalprice AS r, avg(o_totalprice) OVER w AS m, stddev_pop(o_totalprice) OVER w AS s, count(*) OVER w AS n
      FROM orders WINDOW w AS (PARTITION BY o_custkey))""")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    return adv.advantages(rollouts(spark, d), "grpo", ["o_custkey"], "o_totalprice").select("o_orderkey", "o_custkey", F.round("advantage", 6).alias("advantage"))


@query("""
WITH x AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS r FROM orders),
y AS (SELECT *, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s, count(r) OVER w AS n FROM x WINDOW w AS (PARTITION BY o_custkey)),
z AS (SELECT *, CASE WHEN n = 1 THEN r WHEN s > 1e-8 THEN (r - m) / s ELSE r - m END AS a FROM y)
SELECT o_orderkey, round(coalesce(a, min(a) OVER (PARTITION BY o_custkey)), 6) AS advantage, round(coalesce(r, min(r) OVER (PARTITION BY o_custkey)), 6) AS reinforce FROM z""")
def advantage_with_missing_rewards(spark: SparkSession, d: str) -> DataFrame:
    r = rollouts(spark, d).withColumn("r", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    both = adv.reinforce(adv.group_advantage_with_gaps(r, ["o_custkey"], "r"), ["o_custkey"], "r", "reinforce")
    return both.select("o_orderkey", F.round("advantage", 6).alias("advantage"), F.round("reinforce", 6).alias("reinforce"))


@query("""
SELECT o_orderpriority AS role, count(*) AS n, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(max(a), 6) AS most, round(min(a), 6) AS least, round(avg(CASE WHEN abs(a) < 1e-8 THEN 1.0 ELSE 0.0 END), 6) AS fraction_zero
FROM (SELECT o_orderpriority, CASE WHEN count(*) OVER w = 1 THEN won WHEN stddev_pop(won) OVER w > 1e-8 THEN (won - avg(won) OVER w) / stddev_pop(won) OVER w ELSE won - avg(won) OVER w END AS a
      FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS won FROM orders) WINDOW w AS (PARTITION BY o_custkey)) GROUP BY 1""")
def advantage_stats_by_role(spark: SparkSession, d: str) -> DataFrame:
    a = adv.group_advantage(rollouts(spark, d), ["o_custkey"], "won").withColumn("group_id", grp.group_key(F.col("o_custkey"), F.col("o_orderpriority")))
    return a.groupBy(grp.role_of(F.col("group_id")).alias("role")).agg(
        F.count("*").alias("n"), F.round(F.avg("advantage"), 6).alias("mean"), F.round(F.stddev_pop("advantage"), 6).alias("std"), F.round(F.max("advantage"), 6).alias("most"),
        F.round(F.min("advantage"), 6).alias("least"), F.round(F.avg((F.abs("advantage") < 1e-8).cast("double")), 6).alias("fraction_zero"),
    )


@query("""
SELECT user_id, event_type, step_idx, round(CASE WHEN n = 1 THEN value WHEN s > 1e-8 THEN (value - m) / s ELSE value - m END, 6) AS advantage
FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n
      FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step_idx FROM events)
      WINDOW w AS (PARTITION BY event_type, step_idx))""")
def per_step_advantage(spark: SparkSession, d: str) -> DataFrame:
    s = grp.step_positions(steps(spark, d), ["user_id"], ["ts"])
    return adv.per_step_advantage(s, ["event_type"], "step_idx", "value").select("user_id", "event_type", F.col("step_idx").cast("long").alias("step_idx"), F.round("advantage", 6).alias("advantage"))


@query("""
WITH RECURSIVE s AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events),
g AS (SELECT user_id, ts, k, value AS g FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.ts, s.k, s.value + 0.95 * g.g FROM s JOIN g ON s.user_id = g.user_id AND s.k = g.k + 1)
SELECT user_id, ts, round(g, 6) AS mc_return FROM g""")
def discounted_return(spark: SparkSession, d: str) -> DataFrame:
    return adv.discounted_returns(steps(spark, d), ["user_id"], ["ts"], "value").select("user_id", "ts", F.round("mc_return", 6).alias("mc_return"))


@query("""
SELECT event_id, round(value + 0.5 * coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 0), 6) AS shaped FROM events""")
def reward_shaping_lag(spark: SparkSession, d: str) -> DataFrame:
    return adv.shaped_reward(steps(spark, d), ["user_id"], ["ts"], "value", 0.5).select("event_id", F.round("shaped", 6).alias("shaped"))


@query("""
WITH t AS (SELECT event_type, user_id, max(CASE WHEN user_id % 3 > 0 AND event_type <> 'click' THEN value END) AS own, arg_max(value, ts) AS last FROM events GROUP BY 1, 2)
SELECT event_type, user_id, round(CASE WHEN count(own) OVER w = 0 THEN last ELSE own END, 6) AS reward, count(own) OVER w IN (0, count(*) OVER w) AS consistent FROM t WINDOW w AS (PARTITION BY event_type)""")
def last_step_reward(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).withColumn("own", F.when((F.col("user_id") % 3 > 0) & (F.col("event_type") != "click"), F.col("value")))
    return adv.last_step_reward(s, ["event_type"], "user_id", "ts", "value", "own").withColumn("reward", F.round("reward", 6))


@query("""
SELECT event_id, round(v, 6) AS broadcast, round(v / n, 6) AS shared FROM (
  SELECT event_id, max(CASE WHEN k = n THEN value END) OVER (PARTITION BY user_id) AS v, n FROM (
    SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events))""")
def last_step_advantage_to_all(spark: SparkSession, d: str) -> DataFrame:
    s = grp.step_positions(steps(spark, d), ["user_id"], ["ts"])
    s = adv.last_step_to_all(adv.last_step_to_all(s, ["user_id"], "is_last", "value"), ["user_id"], "is_last", "value", "shared", per_step=True)
    return s.select("event_id", F.round("broadcast", 6).alias("broadcast"), F.round("shared", 6).alias("shared"))


@query("""
SELECT o_custkey, count(*) AS n, CASE WHEN max(won) <= 0 THEN 'none' WHEN min(won) >= 1 THEN 'all' ELSE 'partial' END AS outcome
FROM (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS won FROM orders) GROUP BY 1""")
def group_outcome_split(spark: SparkSession, d: str) -> DataFrame:
    return grp.solve_split(rollouts(spark, d), ["o_custkey"], "won")


@query("""
WITH g AS (SELECT o_custkey FROM (SELECT o_custkey, abs(w - first_value(w) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS dev FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS w FROM orders)) GROUP BY 1 HAVING max(dev) >= 1e-8)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM g)""")
def varied_reward_groups(spark: SparkSession, d: str) -> DataFrame:
    return grp.varied_groups(rollouts(spark, d), ["o_custkey"], ["o_orderkey"], "won").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 5)")
def min_group_size(spark: SparkSession, d: str) -> DataFrame:
    return grp.large_groups(rollouts(spark, d), ["o_custkey"], 5).select("o_orderkey", "o_custkey")


@query("""
SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) < 4)""")
def without_dropped_groups(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d)
    return grp.without_dropped(s, s.groupBy("user_id").count().where("count < 4"), "user_id").select("event_id", "user_id")


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) WHERE k <= n // 64 * 64""")
def divisible_prefix(spark: SparkSession, d: str) -> DataFrame:
    o = rollouts(spark, d).withColumn("bucket", F.floor(F.col("o_orderkey") / 1000))
    return grp.divisible_prefix(o, ["o_orderkey"], 64, "bucket").select("o_orderkey")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (coalesce(r, 'UNKNOWN') NOT IN ('TIMEOUT', 'UNKNOWN')) AS valid
FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 'TIMEOUT' WHEN 'view' THEN NULL ELSE 'ENV_DONE' END AS r FROM events) GROUP BY 1""")
def compact_filter(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).withColumn("r", F.when(F.col("event_type") == "error", "TIMEOUT").when(F.col("event_type") == "view", F.lit(None)).otherwise("ENV_DONE"))
    return grp.compact(s, "r", ["TIMEOUT", "UNKNOWN"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("valid"))


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'default_traj_name_' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)) AS name,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS rollout_idx FROM orders""")
def imputed_names(spark: SparkSession, d: str) -> DataFrame:
    r = rollouts(spark, d).withColumn("name", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))
    return grp.rollout_index(grp.imputed_names(r, "o_custkey", ["o_orderkey"], "name"), "o_custkey", ["o_orderkey"]).select("o_orderkey", "name", "rollout_idx")


@query("""
SELECT task_id || ':' || name AS group_id, count(*) AS size, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members
FROM (SELECT o_custkey::VARCHAR AS task_id, o_orderpriority AS name, o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def trajectory_groups(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").withColumn("episode", F.concat_ws(":", "o_custkey", "o_orderkey"))
    o = o.withColumn("group_id", grp.group_key(grp.task_of(F.col("episode")), F.col("o_orderpriority")))
    g = grp.collected_groups(o, ["group_id"], ["o_orderkey"], ["o_totalprice"])
    return g.select("group_id", F.size("members").cast("long").alias("size"), F.array_join(F.transform("members", lambda x: x["o_orderkey"].cast("string")), ",").alias("members"))


@query("""
SELECT count(*) AS groups, sum(n)::BIGINT AS trajectories, round(avg(n), 6) AS mean_size, max(n) AS most, min(n) AS least FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)""")
def grouping_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = rollouts(spark, d).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.sum("n").alias("trajectories"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("most"), F.min("n").alias("least"))


@query("""
SELECT event_id, user_id || '_step' || k AS step_uid, k AS step_idx, n AS n_steps, k = n - 1 AS is_last FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def step_metadata(spark: SparkSession, d: str) -> DataFrame:
    s = grp.step_positions(steps(spark, d), ["user_id"], ["ts"])
    return s.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("_step"), F.col("step_idx").cast("string")).alias("step_uid"), F.col("step_idx").cast("long").alias("step_idx"), "n_steps", "is_last")


@query("""
WITH x AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
c AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS i FROM x WHERE s = 'F'),
r AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS j, count(*) OVER (PARTITION BY k) AS n FROM x WHERE s = 'O')
SELECT c.k AS o_custkey, c.id AS chosen_o_orderkey, r.id AS rejected_o_orderkey FROM c JOIN r ON c.k = r.k AND c.i % r.n = r.j""")
def pref_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return grp.round_robin_pairs(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", ["o_orderkey"], ["o_orderkey"]).select("o_custkey", "chosen_o_orderkey", "rejected_o_orderkey")


@query("""
SELECT event_id, (min(CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - k)::INT AS hops
FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events)""")
def next_marker_distance(spark: SparkSession, d: str) -> DataFrame:
    return seq.next_marker_distance(steps(spark, d), ["user_id"], ["ts"], F.col("event_type") == "purchase").select("event_id", "hops")


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_id % 3 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
p AS (SELECT *, CASE WHEN k % 4 = 1 THEN [a] ELSE [lag(a, (k - 1) % 4) OVER w] || CASE WHEN k % 4 >= 2 OR k % 4 = 0 THEN [lag(a, ((k - 1) % 4) - 1) OVER w] ELSE [] END END AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT event_id, ((k - 1) // 4)::INT AS segment FROM e""")
def segment_merge(spark: SparkSession, d: str) -> DataFrame:
    """Prompts restart at every fourth step and else continue the step before, so segments are runs of four."""
    s = grp.step_positions(steps(spark, d), ["user_id"], ["ts"])
    base = F.floor(F.col("step_idx") / 4) * 4
    prompt = F.transform(F.sequence(base, F.col("step_idx")), lambda i: i)
    s = s.withColumn("prompt", F.concat(F.array(F.lit(-1).cast("long") - base), prompt)).withColumn("response", F.array(F.col("step_idx").cast("long") + 1))
    return seq.prefix_segments(s, ["user_id"], ["ts"], "prompt", "response").select("event_id", "segment")


@query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, n <= 4 AS whole FROM e WHERE k < 4""")
def assembled_steps(spark: SparkSession, d: str) -> DataFrame:
    s = grp.step_positions(steps(spark, d), ["user_id"], ["ts"])
    base = F.floor(F.col("step_idx") / 4) * 4
    s = s.withColumn("prompt", F.concat(F.array(F.lit(-1).cast("long") - base), F.sequence(base, F.col("step_idx")))).withColumn("response", F.array(F.col("step_idx").cast("long") + 1))
    return seq.assembled(s, ["user_id"], ["ts"], "prompt", "response").select("event_id", "whole")


@query("""
WITH m AS (SELECT c.conv_id, c.turn, count(*) AS n, string_agg(x.role || '=' || length(x.text), ',' ORDER BY x.turn) AS s FROM conversations c JOIN conversations x ON c.conv_id = x.conv_id AND x.turn < c.turn WHERE c.role = 'assistant' AND x.role IN ('system', 'user', 'assistant') GROUP BY 1, 2)
SELECT c.conv_id, c.turn, length(c.text) AS n_target, coalesce(m.n, 0) AS n_context, coalesce(m.s, '') AS context FROM conversations c LEFT JOIN m ON c.conv_id = m.conv_id AND c.turn = m.turn WHERE c.role = 'assistant'""")
def sft_samples(spark: SparkSession, d: str) -> DataFrame:
    s = seq.sft_samples(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    shape = F.array_join(F.transform("context", lambda x: F.concat(x["role"], F.lit("="), F.length(x["content"]).cast("string"))), ",")
    return s.select("conv_id", "turn", F.length("target").cast("long").alias("n_target"), F.size("context").cast("long").alias("n_context"), shape.alias("context"))


@query("""
WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1)
SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN l USING (conv_id) WHERE c.turn = last OR (c.turn > coalesce(last, -1) AND role IN ('user', 'tool'))""")
def recent_messages(spark: SparkSession, d: str) -> DataFrame:
    return seq.recent_messages(table(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "role")


@query("""
WITH s AS (SELECT DISTINCT event_type AS k, list_distinct(list(v))::BIGINT[] AS q FROM (SELECT event_type, user_id, user_id % 5 AS v FROM events) GROUP BY event_type, user_id),
r AS (SELECT k, q[1] AS v FROM s) SELECT DISTINCT k, v FROM r""")
def maximal_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of one element: all are maximal; the general relation is tested on small data."""
    s = steps(spark, d).select(F.col("event_type").alias("k"), F.array(F.col("user_id") % 5).alias("q"))
    return seq.maximal_sequences(s, "k", "q").select("k", F.get("q", F.lit(0)).alias("v"))


@query("""
SELECT event_id, round(CASE WHEN d < 0 THEN value WHEN value > 0 THEN value * pow(3.0, 1 - d) WHEN value < 0 THEN value * pow(3.0, d - 1) ELSE value END, 6) AS reshaped
FROM (SELECT event_id, value - 50 AS value, CASE WHEN event_id % 4 = 0 THEN -1.0 ELSE (event_id % 11) / 10.0 END AS d FROM events)""")
def distance_reshape(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d).select("event_id", (F.col("value") - 50).alias("value"), F.when(F.col("event_id") % 4 == 0, F.lit(-1.0)).otherwise(F.col("event_id") % 11 / 10.0).alias("d"))
    return s.select("event_id", F.round(adv.reshaped(F.col("value"), F.col("d")), 6).alias("reshaped"))
