"""Stores, sources and retrieval on stand-ins: events are traces, users their sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import agent_text as at
from ..operators import neardup as nd
from ..operators import reshape as rs
from ..operators import stores as st
from ..sources import datasets as ds
from ..sources import imports as im
from ..sources import sinks
from ..sources.scratch import scratch
from .registry import query, table


def _traces(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("context_type"), F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")).alias("namespace"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("created_at"), F.col("value").alias("updated_at"), F.col("user_id"))


@query("""
SELECT event_id AS id, event_type AS context_type FROM events WHERE user_id IN (1, 2, 3) AND epoch_us(ts) >= epoch_us(TIMESTAMP '2023-01-01') AND event_type = 'click'""")
def session_traces(spark: SparkSession, d: str) -> DataFrame:
    t = _traces(spark, d)
    links = st.session_links(t.withColumn("chain", F.array("user_id")), "id", "chain", "created_at")
    since = 1672531200e6
    return st.traces_where(t, links, [1, 2, 3], context="click", since=since).select("id", "context_type")


@query("SELECT event_id AS trace_id, unnest(list_distinct([user_id, user_id % 10, -1])) AS session_uid FROM events")
def nested_sessions(spark: SparkSession, d: str) -> DataFrame:
    t = _traces(spark, d).withColumn("chain", F.array(F.col("user_id"), F.col("user_id") % 10, F.lit(-1).cast("long")))
    return st.session_links(t, "id", "chain", "created_at").select("trace_id", "session_uid")


@query("""
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS updated_at FROM events WHERE event_id % 3 > 0 OR event_id % 2 = 0""")
def upserted_traces(spark: SparkSession, d: str) -> DataFrame:
    t = _traces(spark, d).select("id", "created_at", "updated_at")
    new = t.where("id % 2 = 0").withColumn("updated_at", F.col("updated_at") + 1).withColumn("created_at", F.col("created_at") + 5)
    return st.upserted(t.where("id % 3 > 0"), new, ["id"], "updated_at", "created_at").select("id", "updated_at")


@query("""
SELECT event_id AS trace_id, CASE WHEN event_id % 2 = 0 THEN -2 ELSE user_id END AS session_uid FROM events""")
def replaced_sessions(spark: SparkSession, d: str) -> DataFrame:
    links = _traces(spark, d).select(F.col("id").alias("trace_id"), F.col("user_id").alias("session_uid"))
    return st.replaced_links(links, links.where("trace_id % 2 = 0").withColumn("session_uid", F.lit(-2).cast("long")), "trace_id")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND lower(c_name) LIKE '%customer#0000001%' ORDER BY c_custkey DESC LIMIT 15 OFFSET 2""")
def experiment_list(spark: SparkSession, d: str) -> DataFrame:
    return st.listed(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}, {"c_name": "CUSTOMER#0000001"}, [F.desc("c_custkey")], 15, 2).select("c_custkey", "c_name")


@query("""
SELECT n_nationkey, coalesce((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey), 0) AS n_customers, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey), 0) AS n_suppliers FROM nation""")
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    kids = {"customers": table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "suppliers": table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")}
    return st.child_counts(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", kids)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return st.cascaded(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


@query("""
SELECT user_id, event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2""")
def keep_last_per_key(spark: SparkSession, d: str) -> DataFrame:
    return st.keep_last(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts")]).select("user_id", "event_type", "event_id")


@query("""
SELECT o_orderkey, 'chosen' AS role, o_orderpriority AS messages FROM orders UNION ALL SELECT o_orderkey, 'rejected', o_orderstatus FROM orders""")
def preference_rows(spark: SparkSession, d: str) -> DataFrame:
    return st.preference_rows(table(spark, d, "orders"), ["o_orderkey"], "o_orderpriority", "o_orderstatus")


@query("""
SELECT s_suppkey, s_name, '{"s_nationkey":' || s_nationkey || '}' AS extra_json FROM supplier""")
def packed_extras(spark: SparkSession, d: str) -> DataFrame:
    return st.packed_extras(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), ["s_suppkey", "s_name"])


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def prop_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT event_id, event_type, coalesce(props::JSON ->> '$.k', 'none') AS k FROM events")
def normalised_tasks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    return rs.with_extra(e, "props", ["event_type", "k"]).select("event_id", "event_type", F.coalesce("k", F.lit("none")).alias("k"))


@query("""
SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS pool, 'mirror.local/set/' || p_brand AS image, coalesce(TRY_CAST(string_split(p_type, ' ')[-1] AS DOUBLE), 0) AS level FROM part""")
def names_and_images(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", rs.pool_name(F.col("p_name")).alias("pool"), rs.mirrored_image(F.concat(F.lit("docker.io/x/"), "p_brand"), "mirror.local", "set").alias("image"), rs.level_number(F.col("p_type")).alias("level"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'org__' || c_mktsegment || '__' || left(md5(c_name), 8) ELSE left(md5(c_name), 12) END AS instance_id FROM customer""")
def instance_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("commit", F.md5("c_name")).withColumn("k", F.col("c_custkey") % 3)
    given = F.when(F.col("k") == 0, F.col("c_name")).otherwise(F.col("commit"))
    repo = F.when(F.col("k") == 1, F.concat(F.lit("org/"), "c_mktsegment"))
    return c.select("c_custkey", rs.instance_id(given, repo, F.col("commit"), F.lit(None).cast("string")).alias("instance_id"))


@query("SELECT DISTINCT p_brand AS name FROM part WHERE p_brand <> ''")
def distinct_images(spark: SparkSession, d: str) -> DataFrame:
    return ds.distinct_names(table(spark, d, "part"), F.col("p_brand"))


@query("""
SELECT l_shipdate::DATE AS day, key, round(value, 4) AS value FROM (SELECT l_shipdate, 'price' AS key, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_shipdate, 'tax', avg(l_tax) FROM lineitem GROUP BY 1)""")
def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax"))
    return sinks.long_metrics(m, "day").withColumn("value", F.round("value", 4))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def golden_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("fp"))
    return sinks.golden_patches(o, "o_custkey", "o_orderkey", "fp")[0].select("o_custkey", "o_orderkey")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def near_dup_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = nd.cosine_top_k(q, e, "query_id", "vec_id", "embedding", 4).where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").withColumn("score", F.round("score", 6))


@query("""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k+7], ' ')))) AS g FROM w WHERE len(w) >= 8),
n AS (SELECT item_id, count(*) AS size FROM i GROUP BY 1),
v AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k+7], ' ')))) AS g FROM v WHERE len(w) >= 8)
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, size HAVING count(*) / size::DOUBLE >= 0.5""")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    return nd.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", 8, 0.5).select("doc_id", "item_id", "shared")


@query("""
WITH v AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM v), t AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark WHERE item_id % 20 = 0),
f AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM v) GROUP BY 1, 2, 3), g AS (SELECT t, count(*) AS df FROM f GROUP BY 1),
x AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len / a))) AS score FROM t JOIN f USING (t) JOIN g USING (t), s GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) WHERE rank <= 5""")
def bm25_retrieval(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").where("item_id % 20 = 0")
    return nd.bm25(table(spark, d, "documents"), q, "doc_id", "item_id", "text", 5).select("item_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS n_steps, max(turn) AS last, CASE WHEN conv_id % 3 = 0 THEN 'rejected' ELSE 'chosen' END AS role, CASE WHEN conv_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS reward FROM conversations GROUP BY 1""")
def imported_rollouts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("messages"))
    o = ds.outcome_rows(c.where("conv_id % 3 <> 0"), c.where("conv_id % 3 = 0"))
    return o.select("conv_id", F.size("messages").cast("long").alias("n"), F.col("n_steps").cast("long").alias("n_steps"), F.element_at("messages", -1)["turn"].alias("last"), "role", "reward")


@query("""
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'assistant')::INT AS n_steps FROM conversations GROUP BY 1),
g AS (SELECT *, conv_id % 11 + 1 AS f, row_number() OVER (PARTITION BY conv_id % 11 ORDER BY conv_id) - 1 AS line FROM c WHERE conv_id % 7 <> 3)
SELECT 'rollout_' || f || '_' || line AS instance_id, n_steps, 'primary' AS role FROM g WHERE conv_id % 7 <> 5""")
def imported_folder(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in numbered files, as lists or in objects; every seventh line is no JSON, another has no messages, and other files lie beside them."""
    folder = scratch(spark, "import")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    kind, listed = F.col("conv_id") % 7, F.to_json("m")
    line = F.when(kind == 3, F.lit("{bad")).when(kind == 5, F.lit('{"other": 1}')).when(kind < 3, listed).otherwise(F.concat(F.lit('{"messages": '), listed, F.lit("}")))
    rows = c.select("conv_id", (F.col("conv_id") % 11 + 1).alias("f"), line.alias("value")).repartition("f").sortWithinPartitions("f", "conv_id")
    rows.select("f", "value").write.partitionBy("f").text(f"{folder}/written")
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *parts]))
    fs.mkdirs(path("in"))
    for k in range(1, 12):
        for name in im.file_names(spark, f"{folder}/written/f={k}") if fs.exists(path("written", f"f={k}")) else []:
            if name.startswith("part-"):
                fs.rename(path("written", f"f={k}", name), path("in", f"{k}.jsonl"))
    fs.create(path("in", "notes.jsonl")).close()
    return im.imported(spark, f"{folder}/in").select("instance_id", "n_steps", "role")


@query("""
SELECT event_id, 'child' AS owner, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'c' END AS level FROM events""")
def inherited_metadata(spark: SparkSession, d: str) -> DataFrame:
    parent = F.create_map(F.lit("owner"), F.lit("parent"), F.lit("kind"), F.col("event_type"), F.lit("level"), F.lit("p"))
    child = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("owner"), F.lit("child"))).otherwise(F.create_map(F.lit("owner"), F.lit("child"), F.lit("level"), F.lit("c")))
    e = table(spark, d, "events").select("event_id", at.inherited(parent, child).alias("m"))
    return e.select("event_id", *(F.element_at("m", k).alias(k) for k in ("owner", "kind", "level")))
