"""Text functions on stand-ins: documents, benchmark items, conversations, and texts put together from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import agent_text as at
from ..functions import answers as an
from ..functions import chat
from ..functions import normalise as nm
from ..operators import reshape as rs
from ..operators import tokens as tok
from .registry import query, table

_PUNCT = nm.PUNCTUATION.replace("'", "''")


@query(f"""
SELECT item_id, array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '{_PUNCT}', ''), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ') AS words, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS plain FROM benchmark""")
def normalised_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", nm.answer_words(F.col("text")).alias("words"), nm.collapsed(F.col("text")).alias("plain"))


@query(f"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(translate(lower(text), '{_PUNCT}', ''), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS w FROM benchmark),
p AS (SELECT a.item_id, a.w AS p, b.w AS g FROM w a JOIN w b ON b.item_id = a.item_id + 1),
c AS (SELECT item_id, len(p) AS np, len(g) AS ng, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) AS same FROM p)
SELECT item_id, round(CASE WHEN coalesce(same, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * same / (np + ng) END, 6) AS f1 FROM c""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    g = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth"))
    return b.join(g, "item_id").select("item_id", F.round(nm.token_f1(F.col("text"), F.col("truth")), 6).alias("f1"))


@query("""
WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark)
SELECT a.item_id, round(CASE WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END, 6) AS f1 FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    g = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth"))
    return b.join(g, "item_id").select("item_id", F.round(nm.set_f1(F.col("text"), F.col("truth")), 6).alias("f1"))


@query("SELECT c_custkey, 1.0::DOUBLE AS best FROM customer")
def best_of_truths(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", nm.best_f1(F.col("c_name"), F.array(F.lit("other words"), F.concat(F.lit("The "), F.upper("c_name"), F.lit(".")))).alias("best"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS short FROM documents")
def shortened_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", nm.shortened(F.col("text"), 40).alias("short"))


@query("SELECT conv_id, turn, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 250) AS fp FROM conversations")
def problem_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", nm.fingerprint(F.concat(F.lit("[ISSUE]"), "text", F.lit("[/ISSUE]"))).alias("fp"))


@query("""
SELECT p_partkey, p_size % 4 = 1 OR p_size % 4 = 2 AS is_test, CASE p_size % 4 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'pkg/tests/a.py' WHEN 2 THEN 'pkg/test_a.py' ELSE 'contest/a.py' END AS path FROM part""")
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 4
    path = F.when(m == 0, "/testbed/src/a.py").when(m == 1, "/testbed/pkg/tests/a.py").when(m == 2, "/testbed/pkg/test_a.py").otherwise("/testbed/contest/a.py")
    return table(spark, d, "part").select("p_partkey", nm.is_test_path(nm.sandbox_path(path)).alias("is_test"), nm.sandbox_path(path).alias("path"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'x = ' || c_custkey END AS code FROM customer")
def last_code_block(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("no code")).otherwise(F.concat(F.lit("```python\nold\n```\nthen\n```py\nx = "), k, F.lit("\n```\nend")))
    return table(spark, d, "customer").select("c_custkey", an.last_code_block(text).alias("code"))


@query("SELECT c_custkey, 'a = ' || c_custkey || chr(10) || 'b = 2' AS code FROM customer")
def stripped_main(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("a = "), F.col("c_custkey").cast("string"), F.lit("\nif __name__ == '__main__':\n    run()\n\n    stop()\nb = 2"))
    return table(spark, d, "customer").select("c_custkey", an.without_main(code).alias("code"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 3) THEN 0.0 ELSE CASE WHEN c_custkey % 2 = 0 THEN 1.5 ELSE 1.0 END END::DOUBLE AS reward FROM customer")
def math_rewards(spark: SparkSession, d: str) -> DataFrame:
    """A whole number equals 5.0, but no quotient."""
    k = F.col("c_custkey")
    answer = F.when(k % 4 == 0, F.concat(F.lit("\\frac{"), (k * 2).cast("string"), F.lit("}{2}"))).when(k % 4 == 3, F.lit("-1")).otherwise(F.concat(k.cast("string"), F.lit(".0")))
    action = F.concat(F.lit("<think>\\boxed{9}</think> so \\boxed{"), answer, F.lit("}"))
    return table(spark, d, "customer").select("c_custkey", an.math_reward(action, F.array(F.lit("none"), k.cast("string")), k % 2 == 0).alias("reward"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM customer")
def countdown_rewards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    action = F.when(k % 3 == 0, F.concat(F.lit("<answer>("), s, F.lit(" + 4) * 2</answer>"))).when(k % 3 == 1, F.concat(F.lit("<answer>"), s, F.lit(" * 2 + 4</answer>"))).otherwise(F.lit("<answer>7</answer>"))
    return table(spark, d, "customer").select("c_custkey", an.countdown_reward(action, F.array(k, F.lit(4).cast("long"), F.lit(2).cast("long")), (k + 4) * 2).alias("reward"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'get' ELSE NULL END AS name, CASE WHEN c_custkey % 2 = 0 THEN '{\"k\":' || c_custkey || '}' END AS arguments FROM customer")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.when(k % 2 == 0, F.concat(F.lit('{"name": "get", "arguments": {"k": '), k.cast("string"), F.lit("}}"))).otherwise(F.lit("{bad"))
    c = table(spark, d, "customer").select("c_custkey", F.get(at.tool_calls(F.concat(F.lit("t <tool_call>"), body, F.lit("</tool_call> u <tool_call>{"))), F.lit(0)).alias("x"))
    return c.select("c_custkey", F.col("x.name").alias("name"), F.col("x.arguments").alias("arguments"))


@query("SELECT c_custkey, 'edit show --a ''it''\"''\"''s'' --path /x/' || c_custkey || '.py' AS command FROM customer")
def action_commands(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("ok <function=edit>\n<parameter=command>show</parameter>\n<parameter=path>/old</parameter>\n<parameter=path>/x/"), F.col("c_custkey").cast("string"), F.lit(".py</parameter>\n<parameter=a>it's</parameter>\n</function>"))
    c = table(spark, d, "customer").select("c_custkey", at.xml_action(text).alias("x"))
    return c.select("c_custkey", at.shell_command(F.col("x.function"), F.col("x.parameters")).alias("command"))


@query("""
SELECT conv_id, CASE WHEN bool_or(role = 'system' AND turn = m) THEN '' ELSE '<|im_start|>system' || chr(10) || 'help' || '<|im_end|>' || chr(10) END || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS chat
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY 1""")
def rendered_chats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", at.chat_text(F.col("m"), system="help", open_turn=True).alias("chat"))


@query("""
WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant', 'system')),
r AS (SELECT conv_id, k, role, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM c),
l AS (SELECT conv_id, '<|begin_of_text|>' || string_agg('<|start_header_id|>' || CASE role WHEN 'tool' THEN 'user' ELSE role END || '<|end_header_id|>' || chr(10) || chr(10) || CASE role WHEN 'tool' THEN '<|start_header_id|>tool_response<|end_header_id|>' || chr(10) || chr(10) ELSE '' END || text || CASE role WHEN 'tool' THEN '<|eot_id|><|eot_id|>' ELSE '<|eot_id|>' END, '' ORDER BY k) AS llama,
  sum(CASE WHEN role = 'assistant' THEN length(text) + length('<|eot_id|>') ELSE 0 END)::BIGINT AS trained FROM r GROUP BY 1),
d AS (SELECT conv_id, '<｜begin▁of▁sentence｜>' || string_agg(CASE role WHEN 'system' THEN text WHEN 'user' THEN '<｜User｜>' || text WHEN 'tool' THEN '<｜User｜><｜tool▁output▁begin｜>' || chr(10) || text || chr(10) || '<｜tool▁output▁end｜>' ELSE '<｜Assistant｜><think>' || chr(10) || 'r' || k || CASE WHEN t <> '' THEN chr(10) || '</think>' || chr(10) || chr(10) || t ELSE '' END || '<｜end▁of▁sentence｜>' END, '' ORDER BY k) || '<｜Assistant｜><think>' || chr(10) AS r1 FROM r GROUP BY 1)
SELECT conv_id, md5(llama) AS llama, md5(r1) AS r1, trained FROM l JOIN d USING (conv_id)""")
def chat_families(spark: SparkSession, d: str) -> DataFrame:
    """Conversations, every fifth turn a tool's, for two families: one with thoughts kept, one with what is trained on counted."""
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant", "system"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    m = F.struct("k", F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("reasoning"))
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    messages = chat.as_messages(F.col("m"), ("role", "content", "reasoning"))
    llama = c.select("conv_id", chat.pieces(messages, "llama").alias("l"), chat.pieces(messages, "r1", keep_reasoning=True, open_turn=True).alias("r"))
    spans = F.aggregate(chat.trained_spans(F.col("l")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return llama.select("conv_id", F.md5(chat.rendered(F.col("l"))).alias("llama"), F.md5(chat.rendered(F.col("r"))).alias("r1"), spans.alias("trained"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS thought, CASE WHEN turn % 2 = 0 THEN 'go ' || turn ELSE '<function=f' || turn END AS action, turn % 2 = 0 AS balanced FROM conversations")
def thoughts_and_actions(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("turn") % 2 == 0
    text = F.when(even, F.concat(F.lit("<think>\n"), "role", F.lit("\n</think>\ngo "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("<function=f"), F.col("turn").cast("string")))
    c = table(spark, d, "conversations").select("conv_id", "turn", at.think_and_rest(text).alias("x"), tok.format_ok(text).alias("balanced"))
    return c.select("conv_id", "turn", "x.thought", "x.action", "balanced")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'PASSED' WHEN 'O' THEN 'FAILED' ELSE 'ERROR' END AS status, 1 AS n, o_orderstatus = 'F' AS solved FROM orders")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "PASSED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("ERROR")
    log = F.concat(F.lit("PASSED x::before\n== short test summary info ==\n\x1b[31m"), s, F.lit("\x1b[0m a/t.py::T::go - why\nnoise\n"))
    o = table(spark, d, "orders").select("o_orderkey", at.test_statuses(log).alias("m"))
    want = F.create_map(F.lit("T.go"), F.lit("PASSED"))
    return o.select("o_orderkey", F.element_at("m", "T.go").alias("status"), F.size("m").alias("n"), at.same_statuses(F.col("m"), want).alias("solved"))


@query("""
SELECT p_partkey, 'a/p' || p_partkey || '.py' AS file_path, 1::INT AS start_line, CASE WHEN p_size % 3 = 0 THEN p_size + 1 WHEN p_size % 3 = 1 THEN 50 ELSE 999999 END::INT AS end_line FROM part""")
def shell_reads(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("a/p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    m = F.col("p_size") % 3
    cmd = F.when(m == 0, F.concat(F.lit("sed -n '1,"), (F.col("p_size") + 1).cast("string"), F.lit("p' "))).when(m == 1, F.lit("head ")).otherwise(F.lit("cat "))
    p = table(spark, d, "part").select("p_partkey", F.explode(at.shell_reads(F.concat(F.lit("$ "), cmd, path, F.lit(" | wc")))).alias("r"))
    return p.select("p_partkey", "r.*")


@query("SELECT p_partkey, 'a/p' || p_partkey || '.py' AS file_path, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END::INT AS start_line, CASE WHEN p_size % 2 = 0 THEN p_size + 9 ELSE 999999 END::INT AS end_line FROM part")
def viewed_ranges(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("view a/p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    text = F.when(F.col("p_size") % 2 == 0, F.concat(path, F.format_string(" --view_range [%d, %d]", F.col("p_size"), F.col("p_size") + 9))).otherwise(path)
    return table(spark, d, "part").select("p_partkey", F.explode(at.viewed_ranges(text)).alias("r")).select("p_partkey", "r.*")


@query("""
SELECT p_partkey, CASE WHEN starts_with(p_type, 'S') AND p_size % 3 < 2 THEN CASE WHEN p_size % 2 = 0 THEN 'swap' ELSE 'add' END WHEN p_size % 3 = 2 AND p_size % 2 = 0 THEN 'remove' END AS change FROM part""")
def decorator_changes(spark: SparkSession, d: str) -> DataFrame:
    """Hunks whose lines come from sizes and types: decorators that go, come, or both, beside other changes or not."""
    out = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n-  @"), "p_brand")).otherwise(F.lit(""))
    plus = F.concat(F.lit("\n+  "), F.when(F.startswith("p_type", F.lit("S")), F.lit("@")).otherwise(F.lit("")), "p_type")
    hunk = F.concat(F.lit("--- a/m.py\n+++ b/m.py\n@@ -1,3 +1,3 @@"), out, F.when(F.col("p_size") % 3 < 2, plus).otherwise(F.lit("")), F.lit("\n def f():"))
    return table(spark, d, "part").select("p_partkey", at.decorator_change(hunk).alias("change"))


@query("SELECT c_custkey, c_name AS name, 'x' AS kind FROM customer")
def slug_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", at.slug_metadata(at.metadata_slug(F.create_map(F.lit("name"), F.col("c_name"), F.lit("kind"), F.lit("x")))).alias("m"))
    return c.select("c_custkey", F.element_at("m", "name").alias("name"), F.element_at("m", "kind").alias("kind"))


@query("SELECT p_partkey, p_size % 10 AS rating, CASE WHEN p_size % 2 = 0 THEN (p_size + 2) / 2.0 END::DOUBLE AS judged FROM part")
def ratings_and_judges(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    tags = F.array(F.lit("dp"), F.lit("*x"), F.concat(F.lit("*"), (s % 10).cast("string")))
    outputs = F.when(s % 2 == 0, F.array(s.cast("string"), F.lit("Error 5"), F.lit("2"), F.lit("?"))).otherwise(F.array(F.lit("error")))
    return table(spark, d, "part").select("p_partkey", rs.starred_rating(tags).alias("rating"), rs.judge_mean(outputs).alias("judged"))
