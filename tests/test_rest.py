"""Small functions that no query calls by themselves."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import agent_text as at
from tessera.functions import answers as an
from tessera.operators import advantage as adv
from tessera.operators import callgraph as cg
from tessera.operators import curation as cu
from tessera.operators import grouping as gp
from tessera.operators import neardup as nd
from tessera.operators import ranges as rg
from tessera.operators import rating as rt
from tessera.operators import reshape as rs
from tessera.sources import datasets as ds
from tessera.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_files_and_logs(spark, tmp_path):
    log = str(tmp_path / "log")
    for k in (1, 2):
        cu.append_log(spark.createDataFrame([(k, "done")], "id int, state string"), log)
    assert sorted(r.id for r in spark.read.json(log).collect()) == [1, 2]
    (tmp_path / "x.jsonl").write_text('{"id": "a", "termination_reason": "X"}\n{bad\n{"id": "b"}\n')
    path, schema = str(tmp_path / "x.jsonl"), "id string, termination_reason string"
    assert sorted((r.id, r.termination_reason) for r in ds.reasoned(ds.tolerant_lines(spark, path, schema)).collect()) == [("a", "X"), ("b", "UNKNOWN")]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        ds.strict_lines(spark, path, schema).collect()
    assert ds.catalog_path("r", "train", "math", "n") == "r/train/math/n.json" and ds.mixture(["a", "b"], [1, 3]) == {"a": 0.25, "b": 0.75} and ds.mixture(["a", "b"]) == {"a": 0.5, "b": 0.5}
    for bad in (lambda: ds.catalog_path("r", "dev", "math", "n"), lambda: ds.mixture(["a"], [1, 2]), lambda: ds.mixture([])):
        with pytest.raises(ValueError):
            bad()
    assert one(spark, sinks.episode_key(F.lit("task"))) == hashlib.sha256(b"task").hexdigest()[:8]
    sinks.write_episodes(spark.createDataFrame([("train", 1, 2, "x")], "mode string, step int, epoch int, e string"), str(tmp_path / "ep"))
    assert (tmp_path / "ep/mode=train/step=1/epoch=2").is_dir()
    traces = spark.createDataFrame([(1, ["t"]), (2, [])], "id int, traces array<string>")
    sinks.write_evaluation(spark.range(3), traces, str(tmp_path / "ev"))
    assert spark.read.json(str(tmp_path / "ev/results")).count() == 3 and [r.id for r in spark.read.json(str(tmp_path / "ev/traces")).collect()] == [1]
    assert [r.sample_idx for r in sinks.with_sample_index(spark.range(5), "id", 2).orderBy("id").collect()] == [0, 1, 0, 1, 0]


def test_rows_and_groups(spark):
    lists = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"a": 3}), (2, {"a": 4})], "k int, m map<string,int>")
    assert {(r.k, r.name): sorted(r["values"]) for r in rs.merged_lists(lists, ["k"], "m").collect()} == {(1, "a"): [1, 3], (1, "b"): [2], (2, "a"): [4]}
    steps = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "g int, t string")
    assert [(r.g, r.least, r.most) for r in adv.unequal_step_counts(steps, ["g"], "t").collect()] == [(1, 1, 2)]
    assert [one(spark, gp.masked_overlong(F.array(F.lit(1), F.lit(0)), F.lit(x))) for x in ("TIMEOUT", "DONE")] == [[0, 0], [1, 0]]
    kept = rg.keep_first(spark.createDataFrame([(1, 3), (1, 2), (2, 9)], "k int, v int"), ["k"], ["v"]).collect()
    assert sorted((r.k, r.v) for r in kept) == [(1, 2), (2, 9)]
    assert [one(spark, rt.problem_score(F.lit(500), F.lit(n))) for n in (0, 3, 20)] == [500, 350, 0]
    m = rt.mean_rating(spark.createDataFrame([(1500,), (1600,)], "r int"), "r").first()
    assert (m.rating, m.contests) == (1550.0, 2)
    scored = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.95), (2, 10, 0.4)], "a int, b int, s double")
    assert [r.a for r in nd.above(scored, "s", 0.9, "a").collect()] == [1]
    assert sorted((r.a, r.b, r.matched) for r in nd.one_to_one(scored, "a", "s", 0.5).collect()) == [(1, 11, True), (2, 10, False)]


def test_nearest_vectors_in_blocks(spark):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "id long, v array<double>")
    q = v.where("id % 20 = 0")
    few, many = ({(r.id, r.rank): (r.vid, round(r.score, 9)) for r in nd.cosine_top_k(q, v.withColumnRenamed("id", "vid"), "id", "vid", "v", 4, b).collect()} for b in (None, 7))
    assert few == many and len(few) == 12 and all(few[i, 1][1] == 1.0 for i in (0, 20, 40))


def test_texts(spark):
    assert [one(spark, an.same_stdout(F.lit(a), F.lit(b))) for a, b in (("1 2\n", "1.0 2"), ("a", "b"), ("1\n2", "1"))] == [True, False, False]
    statuses = F.create_map(F.lit("a"), F.lit("PASSED"), F.lit("b"), F.lit("FAILED"))
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [one(spark, at.resolved(statuses, names(*f), names(*p))) for f, p in ((["a"], []), (["a"], ["b"]), (["c"], []), ([], []))] == [True, False, False, True]
    files = names("a.py", "tests/b.py", "c.md", "test_d.py")
    assert one(spark, cg.non_test_sources(files)) == ["a.py"] and one(spark, cg.non_test_sources(files, names("tests/b.py"))) == ["tests/b.py"]
    traces = spark.createDataFrame([(1, [("a.py", "f")]), (1, [("a.py", "f")]), (1, [("a.py", "g")]), (2, [("a.py", "f")])], "i int, frames array<struct<file_path:string,func_name:string>>")
    assert cg.distinct_traces(traces, "i", "frames").count() == 3
    assert one(spark, at.test_statuses(F.lit("short test summary info\n" + "PASSED t.py::a\n" * 3 + "FAILED t.py::a\nPASSED t.py::b - x\nFAILED t.py::b\nPASSED t.py::b"))) == {"a": "FAILED", "b": "PASSED"}
