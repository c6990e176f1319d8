"""Interval joins by pairs and by tree, on hot keys too, against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranges as rg


def test_nodes_make_up_a_range(spark):
    rng = random.Random(1)
    spans = [(0, 0), (1, 1), (5, 4), (1, 999999), (0, 2**31 - 1), (7, 8), (-5, 3)] + [(a, a + rng.randrange(40)) for a in (rng.randrange(200) for _ in range(60))]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "k int, a long, b long")
    rows = {r.k: (r.t, r.up) for r in df.select("k", rg.tree_nodes(F.col("a"), F.col("b")).alias("t"), rg.ancestors(F.col("a")).alias("up")).collect()}
    for k, (a, b) in enumerate(spans):
        nodes = rows[k][0]
        covered = sorted((n.place << n.level, (n.place + 1) << n.level) for n in nodes)
        assert sum(y - x for x, y in covered) == max(0, b - max(a, 0) + 1) and len(nodes) <= 62
        assert not covered or (covered[0][0], covered[-1][1]) == (max(a, 0), b + 1)
        assert all(p[1] == q[0] for p, q in zip(covered, covered[1:], strict=False))
        assert all(n.place == max(a, 0) >> n.level for n in rows[k][1])


@pytest.mark.parametrize("few", [0, 10, 10**9])
def test_least_distance_and_first_range(spark, few):
    rng = random.Random(2)
    nodes = [(rng.choice("aab"), s, s + rng.choice([0, 1, 5, 300]), round(rng.random(), 4)) for s in (rng.randrange(500) for _ in range(60))] + [("c", 3, 4, 0.5), ("only", 1, 2, 0.1)]
    reads = [(k, rng.choice("aaabcd"), s, s + rng.choice([-2, 0, 3, 100, 999999])) for k, s in enumerate(rng.randrange(600) for _ in range(120))]
    reads += [(0, "b", 1, 999999)]  # a read of two files
    r = spark.createDataFrame(reads, "id int, f string, a long, b long")
    n = spark.createDataFrame([(*x, k) for k, x in enumerate(nodes)], "f string, x long, y long, d double, ord int")
    got = {x.id: x.distance for x in rg.overlap_min(r, n, ["f"], ("a", "b"), ("x", "y"), ["id"], "d", few=few).collect()}
    want = {}
    for i, f, a, b in reads:
        hits = [d for g, x, y, d in nodes if g == f and a <= y and b >= x and a <= b]
        want[i] = min([want.get(i, 9.0), *hits])
    assert got == {i: (-1.0 if d == 9.0 else d) for i, d in want.items()}
    p = rg.first_enclosing(r, n, "f", "a", "x", "y", "ord", ["id", "a"], few=few).collect()
    first = {}
    for i, f, a, _ in reads:
        hits = [k for k, (g, x, y, _) in enumerate(nodes) if g == f and x <= a <= y]
        if hits:
            first[i, a] = min([first.get((i, a), 10**9), *hits])
    assert {(x.id, x.a): x.ord for x in p} == first and all(x.x == nodes[x.ord][1] for x in p)


def test_one_path_of_100000_ranges(spark):
    """Reads of a path with 100000 ranges: rows grow with the logarithm, where pairs would be 10^9."""
    n = spark.range(100_000).select(F.lit("hot").alias("f"), (F.col("id") * 7 % 900_001).alias("x"), (F.col("id") * 7 % 900_001 + 5).alias("y"), (F.col("id") % 9973 / 9973).alias("d"))
    r = spark.range(10_000).select("id", F.lit("hot").alias("f"), (F.col("id") * 91 % 950_000).alias("a"), (F.col("id") * 91 % 950_000 + 2).alias("b"))
    got = {x.id: x.distance for x in rg.overlap_min(r, n, ["f"], ("a", "b"), ("x", "y"), ["id"], "d").collect()}
    starts = {}
    for k in range(100_000):
        starts.setdefault(k * 7 % 900_001, []).append(k % 9973 / 9973)
    for i in range(0, 10_000, 37):
        a = i * 91 % 950_000
        hits = [d for s in range(a - 5, a + 3) for d in starts.get(s, ())]
        assert got[i] == min(hits, default=-1.0)


def test_steps_read_files_of_a_graph(spark):
    steps = spark.createDataFrame([(1, 0, "m", [("a.py", 1, 9), ("b.py", 1, 1)]), (1, 1, "m", []), (1, 2, "m", None), (2, 0, "n", [("a.py", 5, 6)])], "t int, s int, inst string, reads array<struct<file_path:string,start_line:int,end_line:int>>")
    nodes = spark.createDataFrame([("m", "a.py", 8, 12, 0.4), ("m", "b.py", 1, 2, 0.2), ("n", "a.py", 7, 9, 0.0)], "inst string, file_path string, x int, y int, d double")
    got = {(r.t, r.s): r.distance for r in rg.step_distances(steps, ["t", "s"], "reads", ["inst"], nodes, ("x", "y"), "d").collect()}
    assert got == {(1, 0): 0.2, (1, 1): -1.0, (1, 2): -1.0, (2, 0): -1.0}
