"""Token rows on stand-ins: ids and arrays derived from keys and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouping as grp
from ..operators import sequence as seq
from ..operators import tokens as tok
from .registry import query, table


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 7 + 1).cast("int")), lambda i: i * 10).alias("ids"))


@query("""
SELECT o_orderkey, list_transform(range(1, 6), lambda i: CASE WHEN n + i - 5 >= 1 THEN (n + i - 5) * 10 ELSE 0 END)::VARCHAR AS l, list_transform(range(1, 6), lambda i: CASE WHEN i <= n THEN i * 10 ELSE 0 END)::VARCHAR AS r
FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS n FROM orders)""")
def padded_sequences(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    return _ids(spark, d).select("o_orderkey", text(tok.left_padded(F.col("ids"), 5)).alias("l"), text(tok.right_padded(F.col("ids"), 5)).alias("r"))


@query("""
SELECT o_orderkey, max(n) OVER (PARTITION BY o_orderkey % 10 < 5)::INT AS width, (max(n) OVER (PARTITION BY o_orderkey % 10 < 5) - n)::INT AS padding FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS n FROM orders)""")
def batch_padding(spark: SparkSession, d: str) -> DataFrame:
    b = tok.batch_padded(_ids(spark, d).withColumn("batch", F.col("o_orderkey") % 10 < 5), ["batch"], "ids")
    return b.select("o_orderkey", F.size("padded").alias("width"), F.size(F.filter("padded", lambda x: x == 0)).alias("padding"))


@query("""
SELECT o_orderkey, list_transform(range(1, 9), lambda i: greatest(0, least(i, 8 - o_orderkey % 3) - o_orderkey % 3 - 1))::VARCHAR AS p FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, list_transform(range(1, 9), lambda i: greatest(0, i - o_orderkey % 3 - 1))::VARCHAR FROM orders WHERE o_orderkey % 3 > 0""")
def position_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i > F.col("o_orderkey") % 3).cast("int")).alias("m"))
    return o.select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform(tok.positions(F.col("m")), lambda x: x.cast("string")), ", "), F.lit("]")).alias("p"))


@query("""
SELECT event_id, CASE WHEN n BETWEEN 1 AND 4 THEN n ELSE 0 END::INT AS at, round(CASE WHEN n BETWEEN 1 AND 4 THEN value ELSE 0 END, 6) AS total FROM (SELECT event_id, value, event_id % 6 AS n FROM events)""")
def token_level_reward(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 6
    e = table(spark, d, "events").select("event_id", tok.place_of_end(n, 4).alias("at"), tok.reward_at_end(n, F.col("value"), 4).alias("r"))
    return e.select("event_id", "at", F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""
SELECT o_orderkey, n::INT AS n_inputs, n::INT AS n_targets, (n * (n + 3) / 2)::BIGINT AS target_sum FROM (SELECT o_orderkey, o_orderkey % 7 AS n FROM orders)""")
def datum_shift(spark: SparkSession, d: str) -> DataFrame:
    s = F.sequence(F.lit(1), (F.col("o_orderkey") % 7 + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", tok.shifted(s, s, s, s).alias("x"))
    return o.select("o_orderkey", F.size("x.inputs").alias("n_inputs"), F.size("x.targets").alias("n_targets"), F.aggregate("x.targets", F.lit(0), lambda a, y: a + y).cast("long").alias("target_sum"))


@query("""
SELECT l_orderkey, round(sum(l_discount - l_tax), 6) + 0.0 AS advantage FROM lineitem GROUP BY 1""")
def distill_advantage(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_discount", "l_tax")).alias("x"))
    a = tok.distilled(F.transform("x", lambda y: y["l_discount"]), F.transform("x", lambda y: y["l_tax"]))
    return li.select("l_orderkey", (F.round(F.aggregate(a, F.lit(0.0), lambda s, y: s + y), 6) + 0.0).alias("advantage"))


@query("""
SELECT conv_id, sum(n)::INT AS n_tokens, sum(n) FILTER (role = 'assistant')::INT AS n_masked FROM (
  SELECT conv_id, role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM conversations) GROUP BY 1 HAVING sum(n) FILTER (role = 'assistant') IS NOT NULL""")
def token_masks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    c = c.where(F.exists("m", lambda x: x["role"] == "assistant")).select("conv_id", tok.message_masks(F.col("m")).alias("k"))
    return c.select("conv_id", F.size("k").alias("n_tokens"), F.aggregate("k", F.lit(0), lambda a, x: a + x).alias("n_masked"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k FROM events)
SELECT user_id, (k // 4)::INT AS segment, count(*)::INT AS n_steps, count(*)::INT + 1 AS n_tokens, count(*)::INT AS n_masked FROM e GROUP BY 1, 2""")
def merged_token_rows(spark: SparkSession, d: str) -> DataFrame:
    """Steps that extend the one before by one token merge into one row, all tokens but the first two of a segment's prompt... masked."""
    s = grp.step_positions(table(spark, d, "events").select("user_id", "ts"), ["user_id"], ["ts"])
    base = F.floor(F.col("step_idx") / 4) * 4
    s = s.withColumn("prompt", F.concat(F.array((F.lit(-1) - base).cast("long")), F.filter(F.sequence(base, F.col("step_idx")), lambda i: i > base))).withColumn("response", F.array(F.col("step_idx").cast("long") + 1))
    seg = seq.prefix_segments(s, ["user_id"], ["ts"], "prompt", "response")
    m = tok.merged_data(seg, ["user_id"], ["ts"], "prompt", "response")
    return m.select("user_id", "segment", "n_steps", F.size("seq").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_masked"))


@query("""
WITH c AS (SELECT c_custkey, length(c_name) AS n FROM customer)
SELECT c_custkey, i::INT AS idx, round(CASE WHEN i * 2 + 1 < n THEN -1.0 ELSE -0.5 END, 6)::DOUBLE AS logprob FROM c, range(0, 100) r(i) WHERE i * 2 < n""")
def aligned_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """Names as tokens of two letters for the student and of four for the teacher, whose logprobs are half their length, negative."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    cut = lambda n: F.transform(F.sequence(F.lit(0), ((F.length("c_name") - 1) / n).cast("int")), lambda i: F.substring("c_name", i * n + 1, F.lit(n)))
    student = tok.token_spans(c.withColumn("t", cut(2)), ["c_custkey"], "t")
    teacher = tok.token_spans(c.withColumn("t", cut(4)), ["c_custkey"], "t").withColumn("logprob", -(F.col("end") - F.col("start")) / 2.0)
    return tok.aligned_logprobs(student, teacher, ["c_custkey"]).withColumn("logprob", F.round("logprob", 6))
