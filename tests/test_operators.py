import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import neardup as nd
from tessera.operators import passk, reports
from tessera.operators import reshape as rs
from tessera.operators import sequence as seq
from tessera.operators import tokens as tok
from tessera.sources import datasets as ds
from tessera.sources import sinks


def test_unbiased_pass_at_k(spark):
    from math import comb

    cases = [(n, c, k) for n in range(1, 7) for c in range(n + 1) for k in range(1, n + 1)]
    df = spark.createDataFrame(cases, "n int, c int, k int")
    for r in df.select("*", passk.unbiased_pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p")).collect():
        assert abs(r.p - (1 - comb(r.n - r.c, r.k) / comb(r.n, r.k))) < 1e-9


def test_stratified_allocation():
    assert reports.stratified_allocation({"a": 2, "b": 10, "c": 10}, 12) == {"a": 2, "b": 5, "c": 5}
    assert reports.stratified_allocation({"a": 1, "b": 1}, 9) == {"a": 1, "b": 1}
    assert sum(reports.stratified_allocation({"a": 5, "b": 5, "c": 5}, 7).values()) == 7


def test_prefix_segments_match_a_fold(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(40):
        open_, seg, k = None, -1, 0
        for k in range(rng.randrange(1, 7)):
            prompt = [*open_, rng.randrange(3)] if open_ is not None and rng.random() < 0.6 else [rng.randrange(2) for _ in range(rng.randrange(1, 4))]
            response = [rng.randrange(3) for _ in range(rng.randrange(1, 3))]
            if open_ is None or prompt[: len(open_)] != open_:
                seg += 1
            open_ = prompt + response
            rows.append((t, k, prompt, response))
            want[t, k] = seg
    df = spark.createDataFrame(rows, "t int, k int, p array<int>, r array<int>")
    got = seq.prefix_segments(df, ["t"], ["k"], "p", "r")
    assert {(r.t, r.k): r.segment for r in got.collect()} == want
    data = tok.merged_data(got, ["t"], ["k"], "p", "r").collect()
    assert len(data) == len({(t, s) for (t, _), s in want.items()}) and all(len(r.seq) == len(r.mask) for r in data)


def test_maximal_sequences_match_brute_force(spark):
    rng = random.Random(5)
    seqs = {(rng.randrange(2), tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6)))) for _ in range(60)}

    def sub(s, t):
        it = iter(t)
        return all(x in it for x in s)

    want = {(k, s) for k, s in seqs if not any(k == j and len(s) < len(t) and sub(s, t) for j, t in seqs)}
    df = spark.createDataFrame([(k, list(s)) for k, s in seqs], "k int, s array<int>")
    assert {(r.k, tuple(r.s)) for r in seq.maximal_sequences(df, "k", "s").collect()} == want


def test_ordered_greedy_removal_matches_the_loop(spark):
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
    gone = set()
    for i in range(25):
        if i not in gone:
            gone |= {b for a, b in pairs if a == i}
    df = spark.createDataFrame(sorted(pairs), "a int, b int")
    rows = spark.range(25).select(F.col("id").cast("int").alias("i"))
    assert {r.i for r in nd.greedy_kept(df, rows, "a", "b", "i").collect()} == set(range(25)) - gone


def test_alignment_of_tokens(spark):
    s = tok.token_spans(spark.createDataFrame([(1, ["ab", "c", "d"])], "k int, t array<string>"), ["k"], "t")
    t = tok.token_spans(spark.createDataFrame([(1, ["a", "bcd"])], "k int, t array<string>"), ["k"], "t").withColumn("logprob", F.when(F.col("idx") == 0, -1.0).otherwise(-3.0))
    assert {r.idx: r.logprob for r in tok.aligned_logprobs(s, t, ["k"]).collect()} == {0: -2.0, 1: -1.0, 2: -1.0}


def test_splits_and_envelope(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    r = rs.ratio_split(df, "i", 8, 10, 1)
    assert r.where("train").count() == 80 and r.count() == 100
    copies = rs.evaluation_copies(df.limit(3), 4)
    assert copies.groupBy("uid").count().where("count = 4").count() == 3
    with pytest.raises(ValueError):
        rs.repeated(df, 0)
    e = rs.training_envelope(df, F.col("i").cast("string")).first()
    assert e.prompt[0].role == "user" and e.reward_model.ground_truth == "0" and e.extra_info.i == 0
    nested = spark.createDataFrame([((1, [1, 2]),)], "a struct<x:int,y:array<int>>")
    assert rs.flat_fields(nested).columns == ["a/x", "a/y", "a/y/list_len"]


def test_registry_and_readers(spark, tmp_path):
    reg = ds.Registry(spark, str(tmp_path / "reg"))
    df = spark.createDataFrame([(1, "q")], "i int, question string")
    reg.register(df, "set", "train", F.col("question"))
    assert reg.names() == ["set"] and reg.splits("set") == ["train"] and reg.load("set", "test") is None
    assert reg.load("set", "train").first().question == "q" and reg.load("set", "train", True).first().extra_info.i == 1
    assert reg.drop("set", "train") and not reg.drop("set") and reg.names() == []
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert ds.tolerant_lines(spark, str(p), "a int").where("a is not null").count() == 2
    with pytest.raises(ValueError):
        ds.load(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        ds.load(spark, str(tmp_path / "none.json"))
    for name, text in (("good", '{"instance_id": "x"}'), ("list", "[1]"), ("bad", "{"), ("lacks", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    scanned = ds.json_files(spark, str(tmp_path), ["instance_id"])
    good, bad = ds.good_and_bad(scanned)
    assert good.count() == 1 and {r.reason for r in bad.collect()} == {"malformed", "not an object", "no instance_id"}
    meta = sinks.write_training(spark.createDataFrame([(1,), (1,), (2,)], "t int"), "t", str(tmp_path / "sft")).first()
    assert (meta.samples, meta.trajectories, meta.avg_steps) == (3, 2, 1.5)
