"""Plans whose tasks must not hold a whole group, and results that hid behind equal values."""

import duckdb
from pyspark.sql import functions as F

from tessera.operators import reshape as rs
from tessera.operators import tokens as tok
from tessera.plans import catalog


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_a_reward_of_zero_keeps_its_place(spark, tmp_path):
    spark.createDataFrame([(k, 0.0 if k % 2 else 2.5) for k in range(24)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.event_id, r.at, r.total) for r in catalog.queries()["token_level_reward"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(c.sql(catalog.oracle_sql()["token_level_reward"]).fetchall())


def test_batches_are_padded_without_a_window_over_a_batch(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, "a", [1, 2, 3]), (3, None, [4]), (4, None, [4, 5]), (5, "b", [])], "k int, g string, ids array<int>")
    got = tok.batch_padded(df, ["g"], "ids")
    assert got.columns == ["k", "g", "ids", "padded"] and "Window" not in plan(got)
    assert {r.k: r.padded for r in got.collect()} == {1: [0, 0, 1], 2: [1, 2, 3], 3: [0, 4], 4: [4, 5], 5: []}
    rows = tok.batch_padded(df.withColumn("n", F.size("ids")), ["g", "n"], "ids").collect()
    assert all(r.padded == r.ids for r in rows) and len(rows) == 5


def test_sets_meet_distinct(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "v string")
    got = rs.in_both(a, a.where("v is null or v = 'x'"))
    assert sorted(str(r.v) for r in got.collect()) == ["None", "x"]
    assert plan(got).split("Join")[1].count("keys=[v") >= 2  # each side is grouped below the join


def test_episode_lengths_deals_steps_by_count(spark, monkeypatch):
    from tessera.operators import summaries as su

    monkeypatch.setattr(su, "TASK_ROWS", 10, raising=False)
    steps = spark.range(100).select((F.col("id") % 20).alias("e"), (F.col("id") % 3).alias("t"), F.lit(1).alias("p"), F.col("id").alias("r"))
    got = su.episode_lengths(steps, "e", "t", "p", "r", spark.range(5, 25).select(F.col("id").alias("e")))
    assert plan(got).count("REPARTITION_BY_NUM") == 2 and ", 10), REPARTITION_BY_NUM" in plan(got)
    rows = {r.e: r for r in got.collect()}
    assert sorted(rows) == list(range(5, 25)) and rows[5].steps_used == 5 and rows[5].num_trajectories == 3 and rows[5].mean_response_len == 45 and rows[24].empty == 1


def test_mini_batches_send_few_messages_to_the_state(monkeypatch):
    from pyspark.sql import Row

    from tessera.streaming import held

    class State:
        def __init__(self):
            self.kept, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.kept) if isinstance(self.kept, list) else self.kept

        def exists(self):
            return bool(self.kept)

        def appendValue(self, v):
            self.calls += 1
            self.kept.append(v)

        def appendList(self, v):
            self.calls += 1
            self.kept += list(v)

        def update(self, v):
            self.kept = v

        def clear(self):
            self.kept = []

    class Handle:
        def getListState(self, *_):
            return State()

        getValueState = getListState

    h = held.Held("a long", ["a"], None, 4, None)
    h.init(Handle())
    out = [r for part in (range(0, 1001), range(1001, 2003)) for r in h.handleInputRows(None, (Row(a=k, __weight=0) for k in part), None)]
    assert [(r.a, r.release) for r in out] == [(k, k // 4) for k in range(2000)] and h.rows.kept == [(2000,), (2001,), (2002,)]
    assert h.rows.calls < 10


def test_callables_are_parsed_by_as_many_tasks_as_the_session_has(spark):
    from tessera.operators import callgraph as cg

    df = spark.createDataFrame([(1, "def f():\n    return 1\n"), (2, None), (3, "def (")], "k int, code string").coalesce(1)
    got = cg.callables(df, ["k"], "code")
    assert "REPARTITION_BY_NUM" in plan(got)
    by_udtf = df.lateralJoin(cg.Callables(F.col("code").outer())).drop("code")
    assert got.columns == by_udtf.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in by_udtf.collect()] != []


def test_many_middling_keys_meet_as_pairs_and_nodes_stop_at_the_widest_range(spark, monkeypatch):
    from tessera.operators import ranges as rg

    r = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    r = r.union(r.where("k = 3"))
    monkeypatch.setattr(rg, "MOST_SENT", 5)
    assert [x.k for x in rg.hot_keys(r, ["k"], 9).collect()] == [3] and rg.hot_keys(r, ["k"], 30) is None
    assert rg.last_level(r, "a", "b") == 3 and len(spark.range(1).select(rg.ancestors(F.col("id"), 3)).first()[0]) == 4
