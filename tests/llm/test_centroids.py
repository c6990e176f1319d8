import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, n int, cluster string, key int"


def brute(rows, k=40, rounds=5):
    """Plain Lloyd over all vectors in Python's integers."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, tuple(max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in e)))
    order = sorted(kept, key=lambda v: (v[0] is None, hashlib.sha256(f"2:{v[0]}".encode()).hexdigest() if v[0] is not None else "", ce.keys_of(ce.np.array([v[1]]))[0]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = [c for c, _ in assign()]
        for c in set(at):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = assign()
    inertia = Counter()
    for c, d in final:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), tuple(cents[c])) for (i, _), (c, d) in zip(kept, final, strict=True)]


def vectors(seed, n):
    rng = random.Random(seed)
    middles = [[rng.uniform(-0.4, 0.4) for _ in range(64)] for _ in range(6)]
    rows = [(i, [float(round(x + rng.uniform(-0.1, 0.1), 2)) for x in rng.choice(middles)]) for i in range(n)]
    hot = rows[0][1]
    return rows + [(n + i, hot) for i in range(n // 2)]


def as_rows(spark, rows):
    return spark.createDataFrame([(i, e, 1, "c", 2) for i, e in rows], SCHEMA).repartition(4)


def check(spark, rows, **kw):
    df = as_rows(spark, rows)
    same = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in df.collect()]  # as floats
    out = ce.centroid_clusters(df, **kw).collect()
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out)
    want = brute(same, kw.get("clusters", 40), kw.get("rounds", 5))
    assert got == sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in want)


def test_against_brute_force(spark):
    check(spark, vectors(1, 150))
    check(spark, vectors(2, 60), clusters=7, rounds=3)


def test_nulls_lengths_ties_repeats_and_few_vectors(spark):
    rng = random.Random(3)
    good = [[float(rng.randrange(-3, 4)) / 256 for _ in range(64)] for _ in range(9)]
    odd = [(50, None), (51, []), (52, good[0][:63]), (53, [*good[0], 0.5]), (54, [None, *good[0][1:]]), (55, [float("nan"), *good[0][1:]]), (56, [float("inf"), *good[0][1:]])]
    rows = [(k % 7 if k % 5 else None, g) for k, g in enumerate(good)] * 2 + odd
    check(spark, rows)
    check(spark, odd)
    check(spark, rows + [(90, [9e9] * 64), (91, [-9e9, *good[1][1:]]), (92, [9e9] * 64), (93, [300.0] * 64)], clusters=4)


def test_hot_vectors_are_dealt_to_several_tasks(spark, monkeypatch):
    from tessera.llm import store

    monkeypatch.setattr(store, "HOT", 8)
    check(spark, vectors(4, 120), clusters=5, rounds=2)


def test_sums_beyond_a_long():
    x, n = ce.np.array([[1 << 26, -5]]), ce.np.array([1 << 40])
    assert ce.weighted_sums(x, n) == [1 << 66, -5 << 40]


def test_empty_table_and_clashing_names(spark):
    assert ce.centroid_clusters(as_rows(spark, [])).count() == 0
    df = as_rows(spark, vectors(5, 20)).drop("cluster").withColumnRenamed("vec_id", "cluster")
    out = ce.centroid_clusters(df, id_col="cluster", clusters=2)
    assert out.columns[:2] == ["cluster_", "cluster"] and out.count() == 30
    assert out.select(F.countDistinct("cluster_")).first()[0] == 30


@pytest.mark.parametrize("kind", ["array<double>", "array<int>"])
def test_other_element_types(spark, kind):
    df = as_rows(spark, vectors(6, 12)).withColumn("embedding", F.col("embedding").cast(kind))
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = sorted((r.vec_id, r.cluster, r.distance) for r in ce.centroid_clusters(df, clusters=3).collect())
    assert got == sorted(r[:3] for r in brute(rows, 3))
