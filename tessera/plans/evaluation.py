"""Success rates, reports, sampling and set operations on stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import passk, rating, reports
from ..operators import reshape as rs
from .registry import query, table


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as samples of one task; the label is the reward."""
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id").withColumn("reward", F.col("quality").cast("double"))


@query("""
WITH t AS (SELECT source, count(*)::INT AS n, sum(quality)::INT AS c, avg(quality) AS m FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, n, c, round(m, 6) AS mean_reward,
  round(CASE WHEN c = 0 THEN 0.0 ELSE 1 - (n - c) / n::DOUBLE END, 6) AS pass_at_1,
  round(CASE WHEN c = 0 THEN 0.0 WHEN n - c < least(5, n) THEN 1.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - least(5, n) / i::DOUBLE), lambda x, y: x * y) END, 6) AS pass_at_5 FROM t""")
def passk_unbiased(spark: SparkSession, d: str) -> DataFrame:
    t = passk.by_task(graded(spark, d), ["source"], "reward")
    return t.select("source", "n", "c", *(F.round(x, 6).alias(x) for x in ("mean_reward", "pass_at_1", "pass_at_5")))


_TASKS = """(SELECT o_custkey, o_custkey % 7 AS repo, count(*)::INT AS n, count(*) FILTER (o_orderstatus = 'F')::INT AS c, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS m FROM orders GROUP BY 1)"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("repo", F.col("o_custkey") % 7).withColumn("reward", (F.col("o_orderstatus") == "F").cast("double"))
    return passk.by_task(o, ["o_custkey", "repo"], "reward")


@query(f"""
WITH p AS (SELECT *, CASE WHEN c = 0 THEN 0.0 ELSE 1 - (n - c) / n::DOUBLE END AS p1,
  CASE WHEN c = 0 THEN 0.0 WHEN n - c < least(5, n) THEN 1.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - least(5, n) / i::DOUBLE), lambda x, y: x * y) END AS p5 FROM {_TASKS})
SELECT repo, count(*) AS n_tasks, count(*) FILTER (c > 0) AS solved, round(avg(m), 6) AS mean, round(stddev_pop(m) / sqrt(count(*)), 6) AS sem, round(avg(p1), 6) AS pass_at_1, round(avg(p5), 6) AS pass_at_5 FROM p GROUP BY ROLLUP (repo)""")
def repository_report(spark: SparkSession, d: str) -> DataFrame:
    r = passk.by_group(_tasks(spark, d), "repo")
    return r.select("repo", "n_tasks", "solved", *(F.round(c, 6).alias(c) for c in ("mean", "sem", "pass_at_1", "pass_at_5")))


@query(f"SELECT o_custkey, c, n, row_number() OVER (ORDER BY c DESC, o_custkey) AS place FROM {_TASKS} WHERE c > 0")
def solved_tasks(spark: SparkSession, d: str) -> DataFrame:
    return passk.solved_tasks(_tasks(spark, d), "o_custkey")


@query("""
SELECT round(sum(c) / sum(n)::DOUBLE, 6) AS pass_at_1, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0 END), 6) AS pass_at_k, count(*) AS n_tasks, sum(n)::BIGINT AS n_rollouts
FROM (SELECT source, sum(quality)::BIGINT AS c, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def passk_observed(spark: SparkSession, d: str) -> DataFrame:
    o = passk.observed(graded(spark, d), ["source"], F.col("reward") > 0)
    return o.select(F.round("pass_at_1", 6).alias("pass_at_1"), F.round("pass_at_k", 6).alias("pass_at_k"), "n_tasks", "n_rollouts")


@query("""
WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::INT AS c FROM orders GROUP BY 1), h AS (SELECT c, count(*) AS tasks FROM t GROUP BY 1)
SELECT b.c::INT AS c, coalesce(tasks, 0) AS tasks FROM range(13) b(c) LEFT JOIN h ON h.c = b.c""")
def solve_histogram(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("c"))
    return passk.solve_histogram(t, 12)


@query("""
WITH t AS (SELECT o_custkey, bool_and(o_orderstatus = 'F') AS e, bool_or(o_orderstatus = 'F') AS s FROM orders GROUP BY 1)
SELECT round(count(*) FILTER (e) / count(*)::DOUBLE, 6) AS solve_all, round(count(*) FILTER (s AND NOT e) / count(*)::DOUBLE, 6) AS solve_partial, round(count(*) FILTER (NOT s) / count(*)::DOUBLE, 6) AS solve_none FROM t""")
def rejection_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = passk.task_solving(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")
    return t.select(*(F.round(c, 6).alias(c) for c in t.columns))


@query("""
WITH t AS (SELECT o_orderpriority, o_custkey, sum(greatest(0, least(1, o_totalprice / 300000 - 0.2))) AS s, count(*) AS n, max(o_totalprice / 300000 - 0.2) AS b FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, round(sum(s) / sum(n)::DOUBLE, 6) AS mean_score, round(avg(CASE WHEN b >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k FROM t GROUP BY 1""")
def source_scores(spark: SparkSession, d: str) -> DataFrame:
    s = passk.clipped_source_scores(table(spark, d, "orders").withColumn("r", F.col("o_totalprice") / 300000 - 0.2), "o_orderpriority", "o_custkey", "r")
    return s.select("o_orderpriority", F.round("mean_score", 6).alias("mean_score"), F.round("pass_at_k", 6).alias("pass_at_k"))


@query("""
SELECT conv_id, coalesce(s[1] > 0, false) AS first_ok, len(list_filter(s, lambda x: x > 0)) > 0 AS any_ok FROM (SELECT conv_id, list(turn % 3 ORDER BY turn) AS s FROM conversations WHERE turn > 0 GROUP BY 1)""")
def positional_pass(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    a, b = passk.first_and_any(F.transform("t", lambda x: x % 3))
    return c.select("conv_id", a.alias("first_ok"), b.alias("any_ok"))


@query("""
SELECT source, count(*) AS n, sum(quality)::BIGINT AS solved, round(avg(quality), 6) AS rate, round(avg(quality), 6) AS mean, round(stddev_pop(quality), 6) AS std FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""")
def single_sample_report(spark: SparkSession, d: str) -> DataFrame:
    r = reports.single_sample(graded(spark, d), "source", "reward")
    return r.select("source", "n", "solved", *(F.round(c, 6).alias(c) for c in ("rate", "mean", "std")))


@query("""
SELECT count(*) AS n_tasks, round(avg(m), 6) AS mean, round(stddev_pop(m) / sqrt(count(*)), 6) AS sem FROM (SELECT source, avg(quality) AS m FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def report_standard_error(spark: SparkSession, d: str) -> DataFrame:
    r = reports.standard_error(graded(spark, d).groupBy("source").agg(F.avg("reward").alias("m")), "m")
    return r.select("n_tasks", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS most, min(value) AS least FROM events GROUP BY 1")
def reward_by_name(spark: SparkSession, d: str) -> DataFrame:
    r = reports.reward_by_name(table(spark, d, "events"), "event_type", "value")
    return r.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "most", "least")


@query("""
SELECT k AS key, round(CASE WHEN contains(k, 'batch/') THEN sum(value) ELSE avg(value) END, 4) AS value FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'batch/' ELSE 'env/' END || event_type AS k, value FROM events) GROUP BY 1""")
def reduced_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, "batch/").otherwise("env/"), F.col("event_type")).alias("key"), "value")
    return reports.reduced_metrics(e, "key", "value").withColumn("value", F.round("value", 4))


@query("""
SELECT metric, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM (SELECT 'l_quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax - 0.02 FROM lineitem) WHERE v >= 0 GROUP BY 1""")
def trajectory_timings(spark: SparkSession, d: str) -> DataFrame:
    t = reports.timings(table(spark, d, "lineitem").select("l_quantity", (F.col("l_tax") - 0.02).alias("l_tax")), ["l_quantity", "l_tax"])
    return t.withColumn("mean", F.round("mean", 6))


@query("""
SELECT c_custkey, c_name, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, CASE WHEN coalesce(total, 0) > 0 THEN round(passed / total::DOUBLE, 6) ELSE 0.0 END AS rate
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def compare_experiments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").cast("int").alias("won"))
    return reports.compared(table(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey", "won").withColumn("rate", F.round("rate", 6))


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def termination_shares(spark: SparkSession, d: str) -> DataFrame:
    return reports.counted_shares(table(spark, d, "events"), "event_type").withColumn("share", F.round("share", 6))


@query("""
WITH c AS (SELECT * FROM (VALUES (0, 'error'), (1, 'purchase'), (2, 'none such'), (3, 'view')) v(position, category))
SELECT position, category, coalesce(n, 0) AS n, coalesce(s, '') AS samples FROM c LEFT JOIN (
  SELECT event_type, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (r <= 5) AS s FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) GROUP BY 1) ON event_type = category""")
def case_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = reports.fixed_histogram(table(spark, d, "events"), "event_type", ["error", "purchase", "none such", "view"], "event_id")
    return h.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query("""
SELECT round(max(x), 6) AS most, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT abs(exp(-l_discount) - exp(-l_tax)) AS x FROM lineitem)""")
def rollout_probability_difference(spark: SparkSession, d: str) -> DataFrame:
    r = reports.prob_difference(table(spark, d, "lineitem").select((-F.col("l_discount")).alias("a"), (-F.col("l_tax")).alias("b")), "a", "b")
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("""
SELECT round(avg(l_tax - l_discount), 6) AS kl_v1, round(0.5 * avg((l_tax - l_discount) * (l_tax - l_discount)), 6) AS kl_v2, round(avg(l_discount), 6) AS entropy, round(exp(avg(l_discount)), 6) AS perplexity FROM lineitem""")
def divergence_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = reports.divergences(table(spark, d, "lineitem").select((-F.col("l_discount")).alias("s"), (-F.col("l_tax")).alias("c")), "s", "c")
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem")
def token_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    return reports.weighted_mean(table(spark, d, "lineitem"), "l_discount", "l_quantity").select(F.round("mean", 6).alias("mean"))


@query("""
SELECT user_id, round(sum(value - 50), 4) AS total, sum(value - 50) > 0 AS is_correct, count(DISTINCT event_type) AS names FROM events GROUP BY 1""")
def episode_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = reports.episode_outcomes(table(spark, d, "events").withColumn("value", F.col("value") - 50), "user_id", "event_type", "value")
    return e.select("user_id", F.round("total", 4).alias("total"), "is_correct", F.size(F.map_keys("acc")).cast("long").alias("names"))


@query("""
SELECT round(count(*) FILTER (c_acctbal < 5000) / count(*)::DOUBLE * 100, 1) AS percentile FROM customer""")
def elo_percentile(spark: SparkSession, d: str) -> DataFrame:
    return passk.percentile_rank(F.lit(5000.0), table(spark, d, "customer"), "c_acctbal")


@query("""
WITH s AS (SELECT c_nationkey AS contest, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place, c_acctbal AS score FROM customer),
k AS (SELECT contest, coalesce(min(place) FILTER (4000 >= score), max(place) + 1) AS rank FROM s GROUP BY 1),
c AS (SELECT contest, m AS rating, rank, 1 + (SELECT sum(1 / (1 + pow(10, (m - round(1500 + x.score / 10)) / 400))) FROM s x WHERE x.contest = k.contest) AS seed FROM k, range(0, 4001) r(m))
SELECT contest, rank, min(rating) FILTER (seed < rank) AS rating FROM (SELECT * FROM c UNION ALL SELECT contest, 4000, rank, -1 FROM k) GROUP BY 1, 2""")
def contest_ratings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("contest", F.col("c_nationkey")).withColumn("r", F.round(1500 + F.col("c_acctbal") / 10))
    from pyspark.sql import Window

    c = c.withColumn("place", F.row_number().over(Window.partitionBy("contest").orderBy(F.desc("c_acctbal"), "c_custkey")))
    mine = c.select("contest").distinct().withColumn("my_score", F.lit(4000.0))
    ranks = rating.achieved_rank(c, "contest", "place", "c_acctbal", mine)
    return ranks.withColumn("rank", F.col("rank").cast("long")).join(rating.expected_rating(c, "contest", "r", ranks), "contest")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'rare' WHEN doc_id % 10 = 1 THEN 'few' ELSE lang END AS stratum FROM documents),
c AS (SELECT stratum, count(*) AS n FROM d GROUP BY 1),
level AS (SELECT v, s FROM (SELECT v, sum(least(n, v)) AS s FROM c, range(0, 304) r(v) GROUP BY v) WHERE s <= 303 ORDER BY v DESC LIMIT 1),
take AS (SELECT stratum, least(n, v) + CASE WHEN n > v AND row_number() OVER (PARTITION BY n > v ORDER BY stratum) <= 303 - s THEN 1 ELSE 0 END AS t FROM c, level),
r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || doc_id)) AS k FROM d)
SELECT doc_id, stratum FROM r JOIN take USING (stratum) WHERE k <= t""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """303 documents of strata that are small, middling and large: what small ones lack the others give, odd ones by name."""
    stratum = F.when(F.col("doc_id") % 50 == 0, "rare").when(F.col("doc_id") % 10 == 1, "few").otherwise(F.col("lang"))
    return reports.stratified_sample(table(spark, d, "documents").select("doc_id", stratum.alias("stratum")), "stratum", "doc_id", 303, 7)


@query("SELECT source, ('0x' || substr(sha256(source), 1, 8))::BIGINT AS seed FROM (SELECT DISTINCT source FROM documents)")
def default_seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().select("source", reports.default_seed(F.col("source")).alias("seed"))


@query("SELECT n_nationkey * 3 + c AS id, n_nationkey, c::INT AS copy FROM nation, range(3) r(c)")
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    r = rs.repeated(table(spark, d, "nation").select("n_nationkey"), 3)
    return r.select((F.col("n_nationkey") * 3 + F.col("copy")).cast("long").alias("id"), "n_nationkey", "copy")


@query("""
SELECT p::INT AS position, n_name FROM (SELECT generate_subscripts([5, 3, 3, -1, 99, 0], 1) - 1 AS p, unnest([5, 3, 3, -1, 99, 0]) AS i) JOIN nation ON n_nationkey = i""")
def selected_rows(spark: SparkSession, d: str) -> DataFrame:
    return rs.selected(table(spark, d, "nation"), "n_nationkey", [5, 3, 3, -1, 99, 0]).select("position", "n_name")


@query("""
SELECT doc_id, CASE WHEN doc_id < 100 THEN 'test' ELSE 'train' END AS split FROM documents""")
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    test, train = rs.prefix_split(table(spark, d, "documents").select("doc_id"), "doc_id", 100)
    return test.withColumn("split", F.lit("test")).union(train.withColumn("split", F.lit("train")))


@query("""
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= count(*) OVER () * 8 // 10 AS train FROM documents""")
def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    return rs.ratio_split(table(spark, d, "documents").select("doc_id"), "doc_id", 8, 10, 42)


@query("SELECT o_orderpriority FROM orders INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return rs.in_both(o.select("o_orderpriority"), o.where("o_orderstatus = 'P'").select("o_orderpriority"))


@query("""
SELECT 'f' AS part, o_orderkey AS key, NULL::VARCHAR AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o', o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'""")
def dataset_concat(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    f = o.where("o_orderstatus = 'F'").select(F.lit("f").alias("part"), F.col("o_orderkey").alias("key"))
    return f.unionByName(o.where("o_orderstatus = 'O'").select(F.lit("o").alias("part"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("note")), allowMissingColumns=True)


@query("""
SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'A') = 0""")
def added_not_deleted(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_orderkey").distinct().join(li.where("l_returnflag = 'A'").select("l_orderkey"), "l_orderkey", "left_anti")


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5""")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    return rs.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 5)


@query("""
SELECT c_mktsegment, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) USING (c_mktsegment)""")
def reward_cross_tab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 9000).alias("n"))


@query("""
SELECT event_id FROM (SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS done, event_type FROM events) WHERE done <= 2 AND event_type = 'purchase'""")
def accumulate_until_target(spark: SparkSession, d: str) -> DataFrame:
    return rs.until_target(table(spark, d, "events"), ["user_id"], ["ts"], F.col("event_type") == "purchase", 2).select("event_id")
