"""Line diffs, hunks in unified text, structured commits, callables by lateral join."""

import json
import random

from pyspark.sql import functions as F

from tessera.operators import callgraph as cg
from tessera.operators import diffs as df


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def applied(old, hunks):
    """old with its hunks carried out, checked against it on the way."""
    out, at = [], 0
    for h in hunks:
        start = h[1] - 1 if h[2] else h[1]
        out += old[at:start]
        assert [x[1:] for x in h[5] if x[0] in "- "] == old[start : start + h[2]] and len([x for x in h[5] if x[0] in "+ "]) == h[4]
        assert len(out) == (h[3] - 1 if h[4] else h[3])
        out += [x[1:] for x in h[5] if x[0] in "+ "]
        at = start + h[2]
    return out + old[at:]


def test_common_lines_are_as_many_as_can_be():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde\n"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(12))] for _ in range(2))
        found = df.common_lines(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_hunks_carry_one_text_into_the_other():
    rng = random.Random(5)
    for context in (0, 1, 3):
        for _ in range(150):
            a = [rng.choice(["", "x", "y", "z", "@d"]) + str(rng.randrange(4)) for _ in range(rng.randrange(1, 30))]
            b = [x for x in a if rng.random() > 0.15]
            for _ in range(rng.randrange(3)):
                b.insert(rng.randrange(len(b) + 1), f"new{rng.randrange(3)}")
            b = b or ["only"]
            got = list(df.hunks_of("\n".join(a), "\n".join(b), context))
            assert applied(a, got) == b and (not got) == (a == b)
            assert [h[0] for h in got] == list(range(len(got)))
    assert list(df.hunks_of(None, None)) == [] and [h[5] for h in df.hunks_of(None, "a")] == [["+a"]] and [h[5] for h in df.hunks_of("a", None)] == [["-a"]]


def test_hunks_by_lateral_join_and_their_lines(spark):
    a = [f"l{k}" for k in range(40)]
    b = [*a[:5], "    @cache", *a[5:20], *a[21:35], "x", "y", *a[36:]]
    pairs = spark.createDataFrame([(1, "\n".join(a), "\n".join(b)), (2, "same", "same"), (3, None, "q")], "k int, old string, new string")
    found = df.hunks(pairs, "old", "new")
    rows = sorted(found.collect(), key=lambda r: (r.k, r.hunk))
    assert [(r.k, r.hunk, list(r.old_changed), list(r.new_changed)) for r in rows] == [(1, 0, [], [6]), (1, 1, [21], []), (1, 2, [36], [36, 37]), (3, 0, [], [1])]
    assert (rows[0].old_start, rows[0].old_length, rows[0].new_start, rows[0].new_length) == (3, 6, 3, 7)
    assert (rows[3].old_start, rows[3].old_length, rows[3].new_start, rows[3].new_length) == (0, 0, 1, 1)
    text = found.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", df.hunk_text().alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    text = text.withColumn("text", F.concat(F.lit("diff --git a b\n--- a\n+++ b\n"), "text", F.lit("\n\\ No newline at end of file")))
    changed = {(r.k, r.hunk): (list(r.old_changed), list(r.new_changed), r.change) for r in df.changed_lines(df.diff_lines(text, ["k"], "text"), ["k"]).collect()}
    assert changed == {(1, 0): ([], [6], "add"), (1, 1): ([21], [], None), (1, 2): ([36], [36, 37], None), (3, 0): ([], [1], None)}
    spark.udtf.register("hunks", df.Hunks)
    pairs.createOrReplaceTempView("pairs_of_texts")
    assert spark.sql("select k, h.hunk from pairs_of_texts, lateral hunks(old, new, 0) h").count() == 4


def test_structured_commits(spark):
    def file(path, hunks, **more):
        return {"header": {"file": {"path": path}}, "hunks": hunks, **more}

    hunk = {"descriptor": {"old_range": {"start": 3, "length": 2}, "new_range": {"start": 3, "length": 2}, "section": "def f"}, "line_group": {"all_lines": [{"content": "a", "type": "context"}, {"content": "b", "type": "deleted"}, {"content": "c", "type": "added"}, {"content": "?", "type": "other"}]}}
    commit = {"file_diffs": [file("m.py", [hunk]), file("tests/test_m.py", [hunk]), file("r.md", [hunk]), file("e.py", []), file("n.py", [{"line_group": {"all_lines": []}}], minus_file={"path": "/dev/null"})]}
    rows = [(1, json.dumps(commit), None), (2, json.dumps(commit), ["tests/test_m.py"]), (3, "{bad", None), (4, "{}", None), (5, None, None)]
    d = spark.createDataFrame(rows, "k int, c string, r array<string>")
    got = {r.k: r.p for r in d.select("k", df.commit_patch(F.col("c"), F.col("r")).alias("p")).collect()}
    body = "@@ -3,2 +3,2 @@ def f\n a\n-b\n+c"
    assert got[1] == f"diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n{body}\ndiff --git /dev/null b/n.py\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +0,0 @@"
    assert got[2] == f"diff --git a/tests/test_m.py b/tests/test_m.py\n--- a/tests/test_m.py\n+++ b/tests/test_m.py\n{body}" and got[3] == got[4] == got[5] == ""


OLD = "class A:\n    @deco\n    @other(1)\n    def f(self):\n        def g():\n            return 1\n        return g()\n\n    async def h(self):\n        pass\n\n\nif True:\n    def k():\n        return 2\n"


def test_callables_with_decorators_and_their_changes(spark):
    d = spark.createDataFrame([(1, OLD), (2, "def broken("), (3, None)], "k int, code string")
    got = {r.qualified_name: (r.name, r.start_line, r.end_line, r.decorated_line) for r in cg.callables(d, ["k"], "code").collect()}
    assert got == {"A.f": ("f", 4, 7, 2), "A.f.<locals>.g": ("g", 5, 6, 5), "A.h": ("h", 9, 10, 9), "k": ("k", 14, 15, 14)}
    new = OLD.replace("return 1", "return 3").replace("@other(1)", "@other(2)").replace("async def h(self):\n        pass", "async def h2(self):\n        pass")
    n = cg.callables(spark.createDataFrame([(1, new)], "k int, code string"), ["k"], "code")
    o = cg.callables(d, ["k"], "code")
    assert [(r.qualified_name, r.start_line) for r in cg.modified(o, n, ["k"]).collect()] == [("A.f.<locals>.g", 5)]
    added, deleted = cg.added_and_deleted(o, n, ["k"])
    assert [r.qualified_name for r in added.collect()] == ["A.h2"] and [r.qualified_name for r in deleted.collect()] == ["A.h"]
