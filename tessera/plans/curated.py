"""Curation, rewards and lookups on stand-ins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, extension, search
from ..operators import curation as cu
from ..operators import grading
from .registry import query, table

_RANK = "(SELECT *, row_number() OVER (ORDER BY md5('{s}:' || {k}), {k}) - 1 AS r FROM {t})"


@query(f"SELECT item_id, i.copy::INT AS copy, r || '_' || i.copy AS uid FROM {_RANK.format(s=42, k='item_id', t='benchmark')} t, range(4) i(copy) WHERE r < 10")
def sampled_copies(spark: SparkSession, d: str) -> DataFrame:
    return cu.sampled_copies(table(spark, d, "benchmark"), "item_id", 10, 4).select("item_id", "copy", "uid")


@query(f"WITH t AS (SELECT *, least(200, count(*) OVER () // 2) AS size FROM {_RANK.format(s=7, k='o_orderkey', t='orders')}) SELECT o_orderkey, CASE WHEN r < 2 * size THEN (r // size)::INT END AS stage FROM t")
def staged_subsets(spark: SparkSession, d: str) -> DataFrame:
    return cu.staged(table(spark, d, "orders"), "o_orderkey", 200, 2, 7).select("o_orderkey", "stage")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return cu.first_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 25)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('3:' || o_custkey), o_custkey LIMIT 5)")
def random_groups(spark: SparkSession, d: str) -> DataFrame:
    return cu.random_groups(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5, 3)


@query("SELECT user_id, min(event_id) AS task_order FROM events GROUP BY 1")
def first_task_order(spark: SparkSession, d: str) -> DataFrame:
    return cu.first_seen_order(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def hard_subset(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return cu.listed_only(table(spark, d, "part"), listed, "p_partkey").select("p_partkey", "p_name")


@query("""
SELECT user_id, event_id, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_last FROM events""")
def last_and_earlier_steps(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select("user_id", "event_id")
    last = s.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    earlier = s.join(last, ["user_id", "event_id"], "left_anti").withColumn("is_last", F.lit(False))
    return cu.last_and_earlier(last.withColumn("is_last", F.lit(True)), earlier)


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') x ON o_orderkey = l_orderkey")
def resumed_tasks(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return cu.not_done(table(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query(r"""
SELECT '' AS data_source, 'user' AS role, text || ' Let''s think step by step and output the final answer within \boxed{}.' AS content, 'math' AS ability, 'rule' AS style, item_id::VARCHAR AS ground_truth, 'train' AS split, item_id AS index FROM benchmark""")
def math_rows(spark: SparkSession, d: str) -> DataFrame:
    r = cu.math_rows(table(spark, d, "benchmark"), "text", "item_id", "item_id", "train")
    return r.select("data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.*", "extra_info.*")


@query(r"""
SELECT item_id, 'Solve.' || chr(10) || chr(10) || text || CASE WHEN item_id % 3 = 0 THEN '### Format: Use the starter code.' || chr(10) || '```python' || chr(10) || 'def f' || item_id || '():' || chr(10) || '```' || chr(10) || chr(10)
  ELSE '### Format: Write a program.' || chr(10) || '```python' || chr(10) || '# YOUR CODE HERE' || chr(10) || '```' || chr(10) || chr(10) END || '### Answer: (use the provided format with backticks)' || chr(10) || chr(10) AS prompt FROM benchmark""")
def code_prompts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    starter = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("def f"), F.col("item_id").cast("string"), F.lit("():"))).when(F.col("item_id") % 3 == 1, "")
    return b.select("item_id", cu.code_prompt(F.col("text"), starter, "Solve.", "Use the starter code.", "Write a program.").alias("prompt"))


@query("""
SELECT l_orderkey, 'Using the numbers ' || string_agg(l_quantity::INT::VARCHAR, ', ' ORDER BY l_linenumber, l_quantity::INT) || ', find a way to reach the target number ' || sum(l_linenumber)::BIGINT || '.' AS question FROM lineitem GROUP BY 1""")
def countdown_questions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"), F.sum("l_linenumber").alias("t"))
    return g.select("l_orderkey", cu.countdown_question(F.col("x.q"), F.col("t")).alias("question"))


@query("""
WITH t AS (SELECT i AS index, [('0x' || substr(md5('11:' || w || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE FOR w IN ['seed', 'size', 'p']] AS u FROM range(50) r(i))
SELECT index, floor(u[1] * 100000)::INT AS seed, (floor(u[2] * 8) + 2)::INT AS size, round(u[3] * (0.85::DOUBLE - 0.6::DOUBLE) + 0.6::DOUBLE, 6) AS p FROM t""")
def grid_tasks(spark: SparkSession, d: str) -> DataFrame:
    return cu.grid_tasks(spark, 50, 11).withColumn("p", F.round("p", 6)).withColumn("index", F.col("index"))


@query("SELECT p_partkey AS id, p_name AS problem, p_size AS n_tests FROM part")
def renamed_columns(spark: SparkSession, d: str) -> DataFrame:
    return cu.reshaped(table(spark, d, "part"), {"p_partkey": "id", "p_name": "problem", "p_size": "n_tests"}, ["p_brand", "p_type", "p_retailprice"])


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 9.1 WHEN '2-HIGH' THEN 7.3 WHEN '3-MEDIUM' THEN 3.7 WHEN '5-LOW' THEN 1.9 ELSE -1 END::DOUBLE AS difficulty FROM orders""")
def difficulty_numbers(spark: SparkSession, d: str) -> DataFrame:
    names = {"1-URGENT": "VERY_HARD", "2-HIGH": "HARD", "3-MEDIUM": "MEDIUM", "5-LOW": "EASY"}
    label = F.coalesce(*(F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in names.items()), F.lit("OTHER"))
    return table(spark, d, "orders").select("o_orderkey", cu.difficulty_number(label).alias("difficulty"))


@query("""
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'u' || o_orderkey ELSE 't' || o_orderkey END AS uid, CASE WHEN o_orderkey % 3 = 0 THEN 'code' ELSE 'swe' END AS data_source,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END::DOUBLE AS reward, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 4)::INT ELSE 0 END AS sample_idx, 1 AS n_samples, '' AS instance_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'r1' WHEN o_orderkey % 5 = 0 THEN 'r2' ELSE '' END AS repo, CASE WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN' ELSE o_orderstatus END AS termination_reason FROM orders""")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")

    def some(*pairs: tuple) -> F.Column:
        kept = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), F.when(c, v).alias("v")) for n, c, v in pairs)), lambda x: x["v"].isNotNull())
        return F.map_from_entries(kept)

    task = some(("_uid", k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))), ("data_source", k % 3 == 0, F.lit("code")), ("_sample_idx", k % 2 == 0, (k % 4).cast("string")), ("repo", k % 3 == 0, F.lit("r1")), ("repo_name", k % 5 == 0, F.lit("r2")))
    t = table(spark, d, "orders").select(
        F.concat(F.lit("t"), k.cast("string")).alias("uid"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("reward"), task.alias("task"), some(("termination_reason", k % 7 != 0, F.col("o_orderstatus"))).alias("info")
    )
    return cu.result_rows(t)


@query("""
SELECT conv_id, CASE conv_id % 4 WHEN 3 THEN 'only' ELSE coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role = 'assistant' AND text <> ''), '') END AS said FROM conversations GROUP BY 1""")
def assistant_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    messages = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    steps = F.to_json(F.struct(F.transform(F.filter("m", lambda x: (x["role"] == "assistant") & (x["content"] != "")), lambda x: F.struct(x["content"].alias("response"))).alias("steps")))
    whole = F.concat(F.lit('{"messages":'), messages, F.lit("}"))
    shape = F.when(F.col("conv_id") % 4 == 0, messages).when(F.col("conv_id") % 4 == 1, steps).when(F.col("conv_id") % 4 == 2, whole).otherwise('{"response": "only"}')
    return c.select("conv_id", F.array_join(cu.assistant_texts(shape), "|").alias("said"))


@query("""
WITH l AS (SELECT l_orderkey, list(l_shipdate::DATE::VARCHAR ORDER BY l_linenumber, l_shipdate::DATE::VARCHAR) AS c FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END || list_reduce(list_prepend('', list_transform(c[1:3], lambda x, i: chr(10) || chr(64 + i::INT) || '. ' || x)), lambda a, b: a || b) || chr(10) || 'extra' AS question
FROM orders JOIN l ON o_orderkey = l_orderkey""")
def questions_with_choices(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("s")))).alias("x"))
    o = table(spark, d, "orders").join(c, F.col("o_orderkey") == F.col("l_orderkey"))
    q = cu.first_filled(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" "), F.col("o_orderstatus"))
    return o.select("o_orderkey", cu.question_with_choices(q, F.col("x.s"), F.array(F.lit("extra")), 3).alias("question"))


@query("""
WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN '' ELSE trim(text, chr(32) || chr(10) || chr(13) || chr(9)) END AS t FROM conversations), k AS (SELECT * FROM m WHERE t <> '' AND role <> '')
SELECT conv_id, count(*)::INT AS n, string_agg(t, '|' ORDER BY turn) AS joined FROM k GROUP BY 1 HAVING count(*) >= 2""")
def sft_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("content", F.when(F.col("turn") % 3 == 2, "  ").otherwise(F.col("text")))
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    return c.select("conv_id", cu.sft_messages(F.col("m")).alias("m")).where("m is not null").select("conv_id", F.size("m").alias("n"), F.array_join("m.content", "|").alias("joined"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT o_custkey, 'user:' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '|assistant:' || o_orderstatus END || '|assistant:end' AS chat FROM s WHERE r = 1 AND o_totalprice >= 200000""")
def sft_examples(spark: SparkSession, d: str) -> DataFrame:
    """The last order of a customer is the last step, its price the reward; every third says nothing between."""
    o = table(spark, d, "orders")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    middle = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" \n")).otherwise(F.concat(F.lit(" "), "o_orderstatus"))
    m = F.array(said("user", F.col("o_orderpriority")), said("assistant", middle), said("assistant", F.lit("end ")), said(" ".strip(), F.lit("no role")))
    out = cu.sft_examples(o.withColumn("m", m), ["o_custkey"], "o_orderkey", "m", "o_totalprice", 200000.0)
    return out.select("o_custkey", F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("chat"))


@query("""
SELECT CASE WHEN event_id % 5 = 0 THEN 'own-' || event_id ELSE 's' || user_id END AS "group", arg_min(CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'agent' END, event_id) AS name, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS steps
FROM events GROUP BY 1""")
def grouped_steps(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    by = F.when(e % 5 != 0, F.create_map(F.lit("session"), F.concat(F.lit("s"), F.col("user_id").cast("string")))).otherwise(none)
    named = F.when(e % 2 == 0, F.create_map(F.lit("agent"), F.col("event_type"))).otherwise(none)
    g = cu.grouped_steps(table(spark, d, "events").select("event_id", F.map_concat(by, named).alias("info")), "info", "session", "event_id", "agent")
    return g.select("group", "name", F.array_join(F.transform("steps", lambda x: x.cast("string")), ",").alias("steps"))


@query("""
SELECT conv_id, string_agg(text, '|' ORDER BY turn) || '|done' AS texts FROM conversations GROUP BY 1""")
def step_messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    m = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    out = cu.step_messages(m, F.struct(F.lit("assistant").alias("role"), F.lit("done").alias("content")))
    return c.select("conv_id", F.array_join(out["content"], "|").alias("texts"))


_TESTS = """
WITH t AS (SELECT l_orderkey AS k, list('i' || l_quantity::INT ORDER BY l_linenumber, l_quantity, l_partkey) AS i, coalesce(list('o' || l_partkey ORDER BY l_linenumber, l_quantity, l_partkey) FILTER (l_linenumber <= 2 OR l_orderkey % 2 = 0), []) AS o FROM lineitem GROUP BY 1)
"""


def _tests(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("x"))
    i = F.transform("x", lambda r: F.concat(F.lit("i"), r["l_quantity"].cast("int").cast("string")))
    o = F.transform(F.filter("x", lambda r: (r["l_linenumber"] <= 2) | (F.col("k") % 2 == 0)), lambda r: F.concat(F.lit("o"), r["l_partkey"].cast("string")))
    return line.select("k", i.alias("i"), o.alias("o"))


@query(_TESTS + """SELECT k, n::INT AS test, coalesce(i[n], i[1]) AS input, coalesce(o[n], o[1], '') AS output, CASE WHEN k % 3 = 0 THEN 'functional' END AS testtype, CASE WHEN k % 3 = 0 THEN 'f' || k END AS func_name
FROM (SELECT *, unnest(range(1, greatest(len(i), len(o)) + 1)) AS n FROM t)""")
def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    t = _tests(spark, d)
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("f"), F.col("k").cast("string")))
    out = t.select("k", F.posexplode(cu.paired_tests(F.col("i"), F.col("o"), name)).alias("test", "c"))
    return out.select("k", (F.col("test") + 1).alias("test"), "c.*")


@query(_TESTS + """SELECT k, n::INT AS test, i[n] AS input, o[n] AS output, CASE WHEN k % 2 = 0 THEN 'functional' ELSE 'stdin_stdout' END AS testtype, CASE WHEN k % 2 = 0 THEN 'solve' END AS func_name
FROM (SELECT *, unnest(range(1, least(len(i), len(o)) + 1)) AS n FROM t)""")
def normalised_tests(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("k") % 2 == 0, "functional").otherwise("stdin_stdout")
    out = _tests(spark, d).select("k", F.posexplode(cu.normalised_tests(F.col("i"), F.col("o"), F.lit("solve"), kind)).alias("test", "c"))
    return out.select("k", (F.col("test") + 1).alias("test"), "c.*")


@query("""
WITH t AS (SELECT user_id, event_id, repeat('x', event_id % 7) AS input, row_number() OVER (PARTITION BY user_id ORDER BY (event_id % 7) DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY CASE WHEN n > 15 THEN r ELSE event_id END) AS tests FROM t WHERE r <= 15 GROUP BY 1""")
def longest_tests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int")).alias("input")))).alias("t"))
    return e.select("user_id", F.array_join(F.transform(cu.longest_tests(F.col("t")), lambda x: x["event_id"].cast("string")), ",").alias("tests"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_linenumber < 9 AND l_discount * 10 < 0.9::DOUBLE AND len(repeat('def ', l_quantity::INT)) >= 32 AND NOT l_orderkey IN (1, 7)")
def good_code_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").withColumn("style", F.when(F.col("l_linestatus") == "F", "instruct").otherwise("complete")).withColumn("code", F.repeat(F.lit("def "), F.col("l_quantity").cast("int")))
    good = cu.good_code_rows(F.col("l_returnflag"), ["A", "R"], F.col("style"), F.col("l_linenumber"), F.col("l_discount") * 10, F.col("code"), F.col("l_orderkey"), [1, 7])
    return t.where(good).select("l_orderkey", "l_linenumber")


@query("""
WITH t AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber <> 6) AS m, max(l_linenumber) * 2 AS x FROM lineitem GROUP BY 1)
SELECT l_orderkey, n::INT AS n, n > 4 AS more_than_4 FROM t WHERE (x BETWEEN 2 AND 5 OR x >= 10) AND n > 1 AND n = m""")
def difficulty_band(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("i"), F.collect_list(F.when(F.col("l_linenumber") != 6, 1)).alias("o"), (F.max("l_linenumber") * 2).alias("x"))
    return t.where(cu.wanted_difficulty(F.col("x"), F.col("i"), F.col("o"))).select("l_orderkey", F.size("i").alias("n"), cu.tested(F.col("i"), 4).alias("more_than_4"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-07-01' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND NOT contains(o_orderstatus, 'P')")
def windowed_orders(spark: SparkSession, d: str) -> DataFrame:
    o = cu.from_sources(table(spark, d, "orders"), "o_orderpriority", "1-URGENT", "5-LOW")
    return o.where(cu.in_window(F.col("o_orderdate"), "1995-01-01", "1996-07-01") & cu.without_text(F.col("o_orderstatus"), "P")).select("o_orderkey")


@query("""
SELECT p_name AS answer, 'part' AS source FROM part WHERE len(list_distinct(regexp_extract_all(regexp_replace(p_name, 'sqrt|frac', '', 'g'), '[a-zA-Z]'))) <= 2
UNION ALL SELECT r_regionkey || '+x', 'region' FROM region UNION ALL SELECT 'xyz'[1:n_nationkey % 4] , 'nation' FROM nation WHERE n_nationkey % 4 BETWEEN 0 AND 2""")
def evaluable_answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_name").alias("answer"), F.lit("part").alias("source"))
    b = table(spark, d, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit("+x")).alias("answer"), F.lit("region").alias("source"))
    c = table(spark, d, "nation").select(F.substring(F.lit("xyz"), F.lit(1), F.col("n_nationkey") % 4).alias("answer"), F.lit("nation").alias("source"))
    return cu.evaluable([a, b, c], "answer", answers.symbolic_allowed(F.col("answer")))


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```python' || chr(10) || 'x' || chr(10) || '```' WHEN 1 THEN '```python' WHEN 2 THEN 'x```' END AS s, doc_id % 3 AS r, [1, 1, doc_id % 2] AS m FROM documents)
SELECT doc_id, coalesce(s IS NOT NULL AND s LIKE '```python%' AND s LIKE '%```' , false) AS fenced, r = 0 AS zero, r > 0 AS positive, r = 1 AS one, true AS "all", m[3] <> 1 AS untruncated FROM t""")
def row_filters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id")
    k = F.col("doc_id")
    s = F.when(k % 4 == 0, "```python\nx\n```").when(k % 4 == 1, "```python").when(k % 4 == 2, "x```")
    return t.select("doc_id", F.coalesce(cu.fenced(s), F.lit(False)).alias("fenced"), *(cu.by_outcome(k % 3, x).alias(x) for x in ("zero", "positive", "one", "all")), cu.untruncated(F.array(F.lit(1), F.lit(1), k % 2)).alias("untruncated"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the quick') OR contains(lower(text), 'license')")
def transcript_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(cu.mentions(F.col("text"), "The Quick") | cu.mentions(F.col("text"), "LICENSE")).select("doc_id")


@query("""
WITH RECURSIVE g AS (SELECT p_partkey AS id, [CASE WHEN i = 0 THEN 'S' WHEN i = 15 THEN 'G' WHEN (p_partkey * 7 + i * 13 + p_size) % 10 < 3 THEN 'H' ELSE 'F' END FOR i IN range(16)] AS c FROM part),
w(id, pos) AS (SELECT id, 0::BIGINT FROM g UNION SELECT w.id, n.b FROM w JOIN g USING (id) JOIN (SELECT a.a, b.b FROM range(16) a(a), range(16) b(b) WHERE abs(a // 4 - b // 4) + abs(a % 4 - b % 4) = 1) n ON n.a = w.pos WHERE g.c[n.b + 1] <> 'H')
SELECT id, count(*) FILTER (pos = 15) > 0 AS solvable FROM w GROUP BY 1""")
def solvable_grids(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda i: F.when(i == 0, "S").when(i == 15, "G").when((F.col("p_partkey") * 7 + i * 13 + F.col("p_size")) % 10 < 3, "H").otherwise("F")
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.array_join(F.transform(F.sequence(r * 4, r * 4 + 3), cell), ""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), cu.solvable_grid(rows).alias("solvable"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def results_with_experiment(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    return cu.with_experiment(r, table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey", ["l_orderkey", "l_linenumber"])


@query("""
SELECT o_orderkey, o_custkey, c_name, l_quantity, l_orderkey IS NULL AS missing FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 3) ON l_orderkey = o_orderkey""")
def steps_by_output(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    s = table(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return cu.steps_by_output(o, c, s, "o_custkey", "o_orderkey")


@query("""
SELECT c_custkey, coalesce(h, '(unavailable)') AS hint FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS h FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) ON o_custkey = c_custkey""")
def dataset_hints(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("hint"), "o_orderkey")
    return cu.with_hints(table(spark, d, "customer").select("c_custkey"), h, "c_custkey", "hint", "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 5 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1, 'F', 2.0")
def changed_experiments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = spark.createDataFrame([(-1, "F", 2.0)], o.schema)
    return cu.patched(cu.created(o, new, {"o_orderstatus": ["F", "O", "P"]}), "o_orderkey", 5, {"o_orderstatus": "X", "o_totalprice": 1.5})


@query("SELECT * FROM part WHERE p_partkey = 17")
def row_by_id(spark: SparkSession, d: str) -> DataFrame:
    return cu.by_id(table(spark, d, "part"), "p_partkey", 17)


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN json_extract_string(to_json({'n': p_name}), '$.n') WHEN 1 THEN NULL ELSE NULL END AS name FROM part""")
def unpacked_tests(spark: SparkSession, d: str) -> DataFrame:
    import base64
    import zlib

    @F.udf("string")
    def packed(name: str, key: int) -> str:
        raw = json.dumps({"n": name}).encode() if key % 3 == 0 else b"\x80\x04N."
        return base64.b64encode(zlib.compress(raw)).decode() if key % 3 < 2 else "no base64!"

    p = table(spark, d, "part")
    return p.select("p_partkey", F.get_json_object(cu.unpacked_tests(packed("p_name", "p_partkey")), "$.n").alias("name"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'a,b' WHEN 1 THEN 't1,t3' WHEN 2 THEN 'x::y,z' WHEN 3 THEN 'test_' || o_orderkey WHEN 4 THEN '' ELSE 'q' || o_orderkey END AS tests FROM orders""")
def failed_test_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = (
        F.when(k % 6 == 0, '["a", "b"]').when(k % 6 == 1, '{"t1": "FAILED", "t2": "PASSED", "t3": "error"}').when(k % 6 == 2, "ok\nFAILED x::y - why\n ERROR z\nFAILED")
        .when(k % 6 == 3, F.concat(F.lit(" test_"), k.cast("string"))).when(k % 6 == 4, "nothing here").otherwise(F.concat(F.lit('{"tests": [], "f2p_tests": ["q'), k.cast("string"), F.lit('"]}')))
    )
    return table(spark, d, "orders").select("o_orderkey", F.array_join(cu.failed_tests(text), ",").alias("tests"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 18 IN (6, 8, 11) OR p_size % 2 = 1 THEN 0.0 ELSE 1.0 END AS reward FROM part""")
def math_answer_forms(spark: SparkSession, d: str) -> DataFrame:
    """Sizes written in 18 ways; odd ones get a truth that is off by one."""
    z, off = F.col("p_size").cast("long"), (F.col("p_size") + F.col("p_size") % 2).cast("long")
    forms = [
        (("\\boxed{1\\,%03d \\text{ meters}}", z), ("%d", 1000 + off)), (("\\boxed{%d\\%%}", z), ("%d", off)), (("\\boxed{x = %d}", z), ("%d", off)), (("\\boxed{%d\\frac{1}{2}}", z), ("%d.5", off)),
        (("\\boxed{%d 1/2}", z), ("%d.5", off)), (("\\boxed{\\frac{%d}{101}}", z), ("\\dfrac{%d}{101}", off)), (("\\boxed{\\frac{%d}{4}}", 2 * z), ("\\frac{%d}{2}", z)), (("\\boxed{(%d, 2]}", z), ("(%d,2]", off)),
        (("\\boxed{(%d, 2)}", z), ("(%d,2]", z)), (("\\boxed{\\sqrt{%d}}", 4 * z), ("2\\sqrt{%d}", off)), (("<|begin_of_box|>%d<|end_of_box|> \\boxed{8}", z), ("%d", off)), (("no box %d", z), ("%d", z)),
        (("<think>\\boxed{1}</think> \\boxed{%d}", z), ("%d", off)), (("\\boxed{%d^\\circ}", z), ("%d degrees", off)), (("\\boxed{%d and 4}", z), ("%d,4", off)), (("\\boxed{%d million}", z), ("%d*10^6", off)),
        (("\\boxed{.%03d}", z), ("0.%03d0", off)), (("\\boxed{%dx+x}", z), ("%dx", off + 1)),
    ]
    form = F.col("p_partkey") % 18
    action, truth = (F.coalesce(*(F.when(form == k, F.format_string(*pair[side])) for k, pair in enumerate(forms))) for side in (0, 1))
    return table(spark, d, "part").select("p_partkey", answers.math_reward(action, F.array(truth), F.lit(False)).alias("reward"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 5 THEN false WHEN 7 THEN n = m AND q % 4 <> 0 ELSE n = m END AS is_correct
FROM (SELECT *, l_quantity::BIGINT AS q, l_partkey % 5 + 1 AS n, l_suppkey % 5 + 1 AS m FROM lineitem)""")
def equal_answers(spark: SparkSession, d: str) -> DataFrame:
    """Sums of like terms, fractions, roots, products and decimals against other forms of them."""
    q, n, m = F.col("l_quantity").cast("long"), F.col("l_partkey") % 5 + 1, F.col("l_suppkey") % 5 + 1
    forms = [
        (("%dx+%dx", q, n), ("%dx", q + m)), (("\\frac{%d}{%d}", q, n), ("%d/%d", q, m)), (("\\sqrt{%d}", q * q * n), ("%d\\sqrt{%d}", q, m)), (("(x+%d)(x-%d)", q, n), ("x^2+(%d)x-%d", q - m, q * m)),
        (("%d", q), ("%d/%d", q * n, m)), (("1/(\\sqrt{%d}-\\sqrt{%d})", q + 1, q), ("\\sqrt{%d}+\\sqrt{%d}", q + 1, q + F.abs(n - m))),
        (("%d.%02d", F.floor(q / 4), 25 * (q % 4)), ("%d/4", q + F.when(n == m, 0).otherwise(1))),
    ]
    given, truth = (F.coalesce(*(F.when(F.col("l_linenumber") == k + 1, F.format_string(*pair[side])) for k, pair in enumerate(forms))) for side in (0, 1))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", given.alias("given"), truth.alias("truth"))
    return grading.graded_answers(lines, "given", "truth").select("l_orderkey", "l_linenumber", "is_correct")


@query("""
SELECT o_custkey, answer, round(n / sum(n) OVER (PARTITION BY o_custkey), 6) AS share FROM (SELECT o_custkey, o_orderpriority AS answer, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, answer) = 1""")
def agreed_answers(spark: SparkSession, d: str) -> DataFrame:
    a = grading.agreed_answers(table(spark, d, "orders").withColumn("answer", F.col("o_orderpriority")), ["o_custkey"], "answer")
    return a.withColumn("share", F.round("share", 6))


_NAMES = ("Ada Lovelace", "Alan Turing", "Grace Hopper", "Mary Anne Evans", "Emmy Noether")


@query("""
WITH r AS (SELECT o_orderkey, (o_orderkey % 9)::INT AS form, (o_custkey % 5)::INT AS w, o_custkey, o_orderdate::DATE AS day, floor(o_totalprice)::BIGINT AS price FROM orders),
a AS (SELECT *, ['Ada Lovelace', 'Alan Turing', 'Grace Hopper', 'Mary Anne Evans', 'Emmy Noether'][w + 1] AS name, ['red', 'green', 'blue', 'white', 'black'][w + 1] AS colour FROM r),
f AS (SELECT *, CASE form WHEN 0 THEN 'Clerk {' || o_custkey || '} x' WHEN 1 THEN 'Big ' || colour || ' one' WHEN 2 THEN strftime(day, '%B ') || day(day) || ', ' || year(day) WHEN 3 THEN name
  WHEN 4 THEN price::VARCHAR WHEN 5 THEN colour || ' tea leaves' WHEN 6 THEN 'what came was ' || colour || ' and warm' WHEN 7 THEN 'in New York we like ' || colour ELSE '' END AS answer,
  CASE form WHEN 0 THEN 'clerk ' || o_custkey || ' x' WHEN 1 THEN 'big ' || colour WHEN 2 THEN strftime(day, '%B ') || day(day) || ' ' || year(day) WHEN 3 THEN 'Alan Turing' WHEN 4 THEN price::VARCHAR WHEN 5 THEN 'green tea' WHEN 6 THEN 'blue' WHEN 7 THEN 'blue' ELSE 'x' END AS truth FROM a)
SELECT o_orderkey, answer, round(CASE form WHEN 0 THEN 1 WHEN 1 THEN 0.8 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN w = 1 THEN 1 ELSE 0 END WHEN 4 THEN 1 WHEN 5 THEN CASE WHEN w = 1 THEN 0.8 ELSE 0.4 END
  WHEN 6 THEN CASE WHEN w = 2 THEN 2 / 7.0 ELSE 0 END WHEN 7 THEN CASE WHEN w = 2 THEN 2 / 7.0 ELSE 0 END ELSE 0 END * CASE WHEN form IN (6, 7) THEN 0 ELSE 1 END, 6)::DOUBLE AS reward FROM f""")
def search_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Responses that hide an answer in nine ways, made of orders."""
    o = table(spark, d, "orders")
    key, w = F.col("o_orderkey") % 9, (F.col("o_custkey") % 5).cast("int") + 1
    name, colour = F.element_at(F.array(*map(F.lit, _NAMES)), w), F.element_at(F.array(*map(F.lit, ("red", "green", "blue", "white", "black"))), w)
    day, price = F.date_format("o_orderdate", "MMMM d, yyyy"), F.floor("o_totalprice")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    responses = [
        said("<think>\\boxed{no}</think> It is \\boxed{Clerk {", F.col("o_custkey"), "} x} now, {not} 1999"), said("so ** ** it is **Big ", colour, " one** since 1999"), said("we think it came on ", day, " by Ship Mail"),
        said("we met ", name, " in New York, twice in 12 days"), said("about ", price, " people and 7 dogs came"), said("I guess. The answer is: ", colour, " tea leaves!"), said("meh. what came was ", colour, " and warm. no more of it"),
        said("in New York  we like\n", colour), F.lit("<think>only thoughts</think> "),
    ]
    truths = [said("clerk ", F.col("o_custkey"), " x"), said("big ", colour), F.regexp_replace(day, ",", ""), F.lit("Alan Turing"), price.cast("string"), F.lit("green tea"), F.lit("blue"), F.lit("blue"), F.lit("x")]
    response, truth = (F.coalesce(*(F.when(key == k, x) for k, x in enumerate(xs))) for xs in (responses, truths))
    rows = o.select("o_orderkey", search.short_answer(response).alias("answer"), truth.alias("truth"))
    return rows.select("o_orderkey", "answer", F.round(search.search_reward(F.col("answer"), F.array("truth"))["reward"], 6).alias("reward"))


def _length_reward(task: dict, action: str) -> extension.RewardOutput:
    return extension.RewardOutput(float(len(action) % task["m"]), len(action) % task["m"] == 0, {"m": task["m"]})


@query("""SELECT n_nationkey, (len(n_name) % 3)::DOUBLE AS reward, len(n_name) % 3 = 0 AS is_correct, '{"m": 3}' AS metadata FROM nation""")
def plugged_rewards(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "nation").select("n_nationkey", extension.reward_column(_length_reward, F.lit('{"m": 3}'), F.col("n_name")).alias("r"))
    return out.select("n_nationkey", "r.*")


@extension.grouping_hook("by_region")
def _by_region(trajectories: DataFrame) -> DataFrame:
    return trajectories.withColumn("group", F.col("n_regionkey") % 2)


@query('SELECT n_nationkey, n_regionkey % 2 AS "group" FROM nation')
def hooked_groups(spark: SparkSession, d: str) -> DataFrame:
    return extension.grouped_by_hook(table(spark, d, "nation"), "by_region").select("n_nationkey", "group")


@query("SELECT l_orderkey, round(sum(l_discount * 2), 6) AS reward, max(l_quantity) AS most, round(sum(l_discount * 2), 6) > 0.3 AS is_correct FROM lineitem GROUP BY 1")
def hooked_episodes(spark: SparkSession, d: str) -> DataFrame:
    hooks = extension.WorkflowHooks(reward=lambda: F.col("l_discount"), shaping=lambda r: r * 2, correct=lambda t: F.round(t, 6) > 0.3, metrics={"most": lambda: F.max("l_quantity")})
    return hooks.episodes(table(spark, d, "lineitem"), "l_orderkey").withColumn("reward", F.round("reward", 6))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN upper(n_name) || '!' WHEN 1 THEN reverse(n_name) ELSE 'unknown tool other' END AS said, reverse(n_name) AS direct FROM nation")
def called_tools(spark: SparkSession, d: str) -> DataFrame:
    tools = extension.Tools("demo")
    tools.register("shout", lambda s: s.upper() + "!")
    tools.register("mirror", lambda s: s[::-1])
    tools.into(spark)
    name = F.when(F.col("n_nationkey") % 3 == 0, "shout").when(F.col("n_nationkey") % 3 == 1, "mirror").otherwise("other")
    return table(spark, d, "nation").select("n_nationkey", tools.call(name, F.col("n_name")).alias("said"), F.expr("demo_mirror(n_name)").alias("direct"))
