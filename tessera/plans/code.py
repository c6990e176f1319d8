"""Diffs, callables, fault traces and reads on stand-ins: documents are files, parts are modules, line items patched ranges and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agent_text as at
from ..operators import callgraph as cg
from ..operators import diffs
from ..operators import fault_traces as ft
from ..operators import ranges as rg
from .registry import query, table


@query("""
SELECT doc_id, (doc_id % n + 1)::VARCHAR AS added, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_removed, CASE WHEN doc_id % 2 = 1 THEN 'add' END AS change
FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)""")
def file_hunks(spark: SparkSession, d: str) -> DataFrame:
    """A line of each document is replaced, or gets a decorator before it; the hunks between both go to unified text and back."""
    lines, at_ = F.split("text", "\n"), (F.col("doc_id") % F.size(F.split("text", "\n"))).cast("int")
    mark = F.array(F.when(F.col("doc_id") % 2 == 0, F.format_string("### %d", "doc_id")).otherwise(F.format_string("    @mark(%d)", "doc_id")))
    rest = F.slice(lines, at_ + F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1), F.size(lines))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.array_join(F.concat(F.slice(lines, F.lit(1), at_), mark, rest), "\n").alias("new"))
    found = diffs.hunks(docs, "text", "new").withColumn("unified", diffs.hunk_text()).select("doc_id", F.col("hunk").alias("nth"), "unified")
    changed = diffs.changed_lines(diffs.diff_lines(found, ["doc_id", "nth"], "unified"), ["doc_id", "nth"])
    numbers = F.array_join(F.transform(F.flatten(F.array_sort(F.collect_list("new_changed"))), lambda x: x.cast("string")), ",")
    return changed.groupBy("doc_id").agg(numbers.alias("added"), F.sum(F.size("old_changed")).alias("n_removed"), F.max("change").alias("change"))


@query("""
SELECT p_partkey, unnest(['P' || p_partkey || '.get', 'P' || p_partkey || '.get.<locals>.inner', 'f']) AS qualified_name, unnest([3, 4, 9]) AS start_line, unnest([6, 5, 10]) AS end_line, unnest([2, 4, 9]) AS decorated_line FROM part""")
def code_callables(spark: SparkSession, d: str) -> DataFrame:
    """Callables of a module for each part."""
    code = "class P%d:\n    @cached\n    def get(self):\n        def inner():\n            return %d\n        return inner()\n\n\ndef f():\n    return 1\n"
    p = table(spark, d, "part").select("p_partkey", F.format_string(code, "p_partkey", "p_size").alias("code"))
    return cg.callables(p, ["p_partkey"], "code").select("p_partkey", "qualified_name", "start_line", "end_line", "decorated_line")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'f' WHEN p_size % 3 = 1 THEN 'f.<locals>.g' END AS qualified_name, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END::INT AS start_line FROM part WHERE p_size % 3 < 2""")
def modified_callables(spark: SparkSession, d: str) -> DataFrame:
    """Of an outer and an inner function one, or none, changes."""
    code = "def f():\n    def g():\n        return %d\n    return %d\n"
    size = F.col("p_size")
    new = table(spark, d, "part").select("p_partkey", F.format_string(code, size + F.when(size % 3 == 1, 1).otherwise(0), size + F.when(size % 3 == 0, 1).otherwise(0)).alias("code"))
    old = table(spark, d, "part").select("p_partkey", F.format_string(code, "p_size", "p_size").alias("code"))
    key = ["p_partkey"]
    return cg.modified(cg.callables(old, key, "code"), cg.callables(new, key, "code"), key).select("p_partkey", "qualified_name", "start_line")


@query("""
WITH hit AS (SELECT p_partkey, p_size, min({'o': l_orderkey * 10 + l_linenumber, 'n': l_orderkey || '.' || l_linenumber}) AS m FROM part JOIN lineitem ON l_partkey = p_partkey AND p_size BETWEEN l_quantity::BIGINT AND l_quantity::BIGINT + l_linenumber GROUP BY 1, 2)
SELECT p_partkey, form, func_name, CASE WHEN func_name = 'go' THEN m.n ELSE func_name END AS qualified_name, func_name = 'go' AS is_patched
FROM hit, (VALUES ('markers'), ('json')) f(form), (VALUES ('go'), ('T.test_go[1]')) n(func_name) WHERE p_size % 2 = 0""")
def fault_frames(spark: SparkSession, d: str) -> DataFrame:
    """Traces of parts in both forms; line items are the patched ranges, and tests of even sizes are wanted."""
    text = "x\n<<<FAULT_TRACE_BEGIN:m:m.py:%1$d>>>\n/testbed/tests/t.py:1:T.test_go[1]:go(a: int)\n/testbed/m.py:%1$d:go:raise\n/u/site-packages/z.py:1:z:z\n<<<FAULT_TRACE_END>>>\n/testbed/m.py:%1$d:after:x"
    lines = '{"frames": [{"file": "/testbed/tests/t.py", "line": 1, "name": "T.test_go[1]", "code": ""}, {"file": "/testbed/m.py", "line": %d, "name": "go", "code": "raise"}]}\n{bad'
    p = table(spark, d, "part").select("p_partkey", "p_size", F.format_string(text, "p_size").alias("log"), F.format_string(lines, "p_size").alias("jsonl"))
    first, key = F.col("l_quantity").cast("long"), ["p_partkey"]
    patched = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.lit("m.py").alias("file_path"), first.alias("start_line"), (first + F.col("l_linenumber")).alias("end_line"),
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("qualified_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    wanted = p.where("p_size % 2 = 0").select("p_partkey", F.lit("test_go").alias("test"))

    frames = ft.marker_frames(p, key, "log").withColumn("form", F.lit("markers")).unionByName(ft.json_frames(p, key, "jsonl").withColumn("form", F.lit("json")))
    both = ft.with_patched(ft.from_wanted_tests(frames, key, wanted, "test", per=["form"]), key, patched, few=20, per=["form"])  # both drop whole traces, whichever is first
    return both.select("p_partkey", "form", "func_name", "qualified_name", "is_patched")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS step, l_orderkey % 3 AS inst, 'p' || l_suppkey % 9 || '.py' AS f, CASE WHEN l_linenumber = 4 THEN 1 ELSE l_quantity::BIGINT * 3 END AS a, CASE WHEN l_linenumber = 4 THEN 999999 ELSE l_quantity::BIGINT * 3 + 5 END AS b FROM lineitem WHERE l_linenumber < 6),
n AS (SELECT p_partkey % 3 AS inst, 'p' || (p_partkey // 3) % 50 || '.py' AS f, p_size * 4 AS x, p_size * 4 + 2 AS y, (p_partkey % 40) / 39.0::DOUBLE AS d FROM part),
j AS (SELECT l_orderkey, step, coalesce(min(d), -1.0) AS d FROM s LEFT JOIN n ON s.inst = n.inst AND s.f = n.f AND a <= y AND b >= x GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS n_steps, count(*) FILTER (d >= 0) AS n_on_graph, coalesce(min(step) FILTER (d >= 0 AND d < 1e-6), -1)::BIGINT AS step_to_root, round(coalesce(min(d) FILTER (d >= 0), -1.0), 6) AS min_distance FROM j GROUP BY 1""")
def read_localisation(spark: SparkSession, d: str) -> DataFrame:
    """What steps read, in four forms, against the ranges of a call graph; then by trajectory."""
    path, first = F.concat(F.lit("/testbed/p"), (F.col("l_suppkey") % 9).cast("string"), F.lit(".py")), F.col("l_quantity").cast("long") * 3
    k, last = F.col("l_linenumber"), first + 5
    text = (
        F.when(k == 1, F.format_string("sed -n '%d,%dp' %s", first, last, path))
        .when(k == 2, F.format_string('<function=file_editor> {"command": "view", "path": "%s", "view_range": [%d, %d]} </function>', path, first, last))
        .when(k == 3, F.format_string("<function=file_editor><parameter=command>view</parameter><parameter=path>%s</parameter><parameter=view_range>[%d, %d]</parameter>", path, first, last))
        .when(k == 4, F.concat(F.lit("cat "), path)).otherwise(F.format_string('<function=file_editor><parameter name="command">view</parameter><parameter name="path">%s</parameter><parameter name="view_range">[%d, %d]</parameter>', path, first, last))
    )
    steps = table(spark, d, "lineitem").where("l_linenumber < 6").select("l_orderkey", (k - 1).alias("step"), (F.col("l_orderkey") % 3).alias("inst"), at.all_reads(text).alias("reads"))
    file_ = F.concat(F.lit("p"), (F.floor(F.col("p_partkey") / 3) % 50).cast("string"), F.lit(".py"))
    nodes = table(spark, d, "part").select((F.col("p_partkey") % 3).alias("inst"), file_.alias("file_path"), (F.col("p_size") * 4).alias("x"), (F.col("p_size") * 4 + 2).alias("y"), ((F.col("p_partkey") % 40) / 39.0).alias("d"))
    distances = rg.step_distances(steps, ["l_orderkey", "step"], "reads", ["inst"], nodes, ("x", "y"), "d", few=10)
    return rg.trajectory_localisation(distances, ["l_orderkey"], "step", "distance").withColumn("min_distance", F.round("min_distance", 6))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'diff --git a/m.py b/m.py' || chr(10) || '--- a/m.py' || chr(10) || '+++ b/m.py' || chr(10) || '@@ -' || p_size || ',2 +' || p_size || ',2 @@ def f' || chr(10) || ' ' || p_name || chr(10) || '-' || p_brand || chr(10) || '+' || p_type END AS patch FROM part""")
def commit_patches(spark: SparkSession, d: str) -> DataFrame:
    """Structured commits of parts; every fourth touches only tests, and one file is no Python."""
    span = F.struct(F.col("p_size").alias("start"), F.lit(2).alias("length"))
    line = lambda c, kind: F.struct(F.col(c).alias("content"), F.lit(kind).alias("type"))
    hunk = F.struct(F.struct(span.alias("old_range"), span.alias("new_range"), F.lit("def f").alias("section")).alias("descriptor"), F.struct(F.array(line("p_name", "context"), line("p_brand", "deleted"), line("p_type", "added")).alias("all_lines")).alias("line_group"))
    file_ = lambda path: F.struct(F.struct(F.struct(path.alias("path")).alias("file")).alias("header"), F.array(hunk).alias("hunks"))
    own = F.when(F.col("p_size") % 4 == 0, "tests/m.py").otherwise("m.py")
    commit = F.to_json(F.struct(F.array(file_(own), file_(F.lit("readme.md"))).alias("file_diffs")))
    return table(spark, d, "part").select("p_partkey", diffs.commit_patch(commit).alias("patch"))
