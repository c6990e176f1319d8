"""The trace store and the rows held in state, over batches, kills and restarts."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import held
from tessera.streaming import traces as st
from tessera.streaming.trace_store import TraceStore, flushed, ingested

SCHEMA = "id int, v double, created double, updated double, sessions array<string>"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def values(store):
    return {r.id: (r.v, r.created) for r in store.read().collect()}


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "s"), ["id"], "updated", "created", buckets=16, most_runs=3)
    assert store.read() is None and store.lookup(spark.range(1)) is None
    rows = [(k, float(k), 1.0, 1.0) for k in range(400)]
    assert len(store.append(spark.createDataFrame(rows, "id int, v double, created double, updated double"), 0)) == 16
    want = {k: (float(k), 1.0) for k in range(400)}
    for epoch in range(1, 9):
        before = files(tmp_path / "s")
        batch = [(7, 100.0 + epoch, 50.0, 1.0 + epoch), (400 + epoch, 0.0, 3.0, 3.0)]
        touched = store.append(spark.createDataFrame(batch, "id int, v double, created double, updated double"), epoch)
        want |= {7: (100.0 + epoch, 1.0), 400 + epoch: (0.0, 3.0)}
        assert 1 <= len(touched) <= 2
        after = files(tmp_path / "s")
        for path in before.keys() ^ after.keys():
            assert int(path.split("bucket=")[1].split("/")[0]) in touched  # no other bucket gets or loses a file
        assert all(after[p] == before[p] for p in before.keys() & after.keys())
        assert values(store) == want
    assert max(len(r) for r in store.manifest()["runs"].values()) <= 3
    seven = str(spark.createDataFrame([(7,)], "id int").select(store._bucket()).first()[0])
    assert len(store.manifest()["runs"][seven]) <= 3 and len(files(tmp_path / "s")) < 16 + 2 * 9
    assert [(r.id, r.v) for r in store.lookup(spark.createDataFrame([(7,), (9999,)], "id int")).collect()] == [(7, 108.0)]


def test_equal_times_repeats_and_older_rows(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path / "s"), ["id"], "updated", "created", buckets=2, most_runs=9)
    schema = "id int, v double, created double, updated double"
    for epoch, row in ((0, (1, 1.0, 5.0, 5.0)), (1, (1, 2.0, 9.0, 5.0)), (2, (1, 3.0, 2.0, 4.0)), (2, (1, 9.0, 0.0, 9.0)), (1, (1, 9.0, 0.0, 9.0))):
        store.append(spark.createDataFrame([row], schema), epoch, "a")
    assert values(store) == {1: (2.0, 2.0)}  # of equal times the later batch, of all the earliest creation; known batches change nothing
    store.append(spark.createDataFrame([(2, 1.0, 1.0, 1.0)], schema), 0, "b")  # another stream has batches of its own
    assert set(values(store)) == {1, 2}


def test_ingestion_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    store = TraceStore(spark, str(tmp_path / "s"), ["id"], "updated", "created", buckets=4, most_runs=2)

    def run():
        return ingested(st.file_stream(spark, src, SCHEMA, 1), store, ck, "sessions", str(tmp_path / "refused"))

    for k in range(3):
        put(spark, src, [(k, 1.0, 1.0, 1.0, ["s"]), (10, float(k), 1.0 + k, 1.0 + k, ["s", "t"]), (20 + k, 0.0, 0.0, 0.0, None if k else [])], SCHEMA)
    commit, calls = store._commit, []

    def dies_once(state):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed between the run and its manifest")
        commit(state)

    monkeypatch.setattr(store, "_commit", dies_once)
    q = run()
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination()
    assert set(values(store)) <= {0, 1, 2, 10} and len(values(store)) == 2
    q = run()
    flushed(q)
    q.awaitTermination()
    assert values(store) == {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (1.0, 1.0), 10: (2.0, 1.0)}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "refused")).collect()) == [20, 21, 22]
    assert not [v for v in store.versions() if v < store.versions()[-1] - 9]


def test_a_second_writer_fails(spark, tmp_path):
    a = TraceStore(spark, str(tmp_path / "s"), ["id"], "updated", "created")
    state = a.manifest()
    a._commit(dict(state))
    with pytest.raises(RuntimeError, match="another writer"):
        a._commit(dict(state))


def drain(spark, out, tmp_path, fail_at=None):
    """Runs a stream to its end; the sink keeps each batch under its number, and dies before one if told to."""

    def keep(batch, epoch):
        if epoch == fail_at:
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={epoch}"))

    q = out.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    if fail_at is not None:
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination()
    else:
        q.awaitTermination()


def result(spark, tmp_path):
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_rows_wait_until_enough_over_kills(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "run string, task long, part boolean"

    def stream():
        return held.until_enough(st.file_stream(spark, src, schema, 1), "run", F.col("part"), 3)

    at = 0
    for n, partial in ((4, 2), (3, 1), (5, 0), (2, 2), (3, 3)):
        put(spark, src, [(r, at + k, k < partial) for r in ("a", "b") for k in range(n) if r == "a" or partial < 3], schema)
        at += n
    drain(spark, stream(), tmp_path, fail_at=1)
    drain(spark, stream(), tmp_path, fail_at=3)
    drain(spark, stream(), tmp_path)
    got = sorted((r.run, r.release, r.task) for r in result(spark, tmp_path))
    first = [("a", 0, t) for t in range(7)] + [("b", 0, t) for t in range(7)]
    second = [("a", 1, t) for t in range(7, 17)]  # b has only two partial ones since
    assert got == sorted(first + second)
    assert len(got) == len(set(got))


def test_chunks_of_one_size_over_restarts(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k int, v long, note string"

    def stream():
        return held.rechunked(st.file_stream(spark, src, schema), "k", 4)

    for at, n in ((0, 3), (3, 7), (10, 1), (11, 6)):
        put(spark, src, [(k, at + x, None) for k in (1, 2) for x in range(n)], schema)
        drain(spark, stream(), tmp_path)
    got = result(spark, tmp_path)
    for k in (1, 2):
        mine = sorted((r.release, r.v) for r in got if r.k == k)
        assert [x for x, _ in mine] == [c for c in range(4) for _ in range(4)]
        assert len({v for _, v in mine}) == 16 and {v for _, v in mine} <= set(range(17))


def test_completion_order_with_late_and_repeated_results(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "run int, task string, done double"

    def stream():
        return held.in_completion_order(st.file_stream(spark, src, schema), "run", "task", "done", 10.0)

    batches = [
        [(1, "b", 5.0), (1, "a", 3.0), (1, "c", 12.0), (2, "z", 1.0)],  # 12 - 10: nothing but what is before 2
        [(1, "d", 14.0), (1, "a", 3.0), (1, "e", 4.0)],  # a comes twice; up to 4
        [(1, "f", 25.0), (1, "late", 3.5), (1, "b", 5.0), (1, "f", 25.0)],  # up to 15; one missed its turn
        [(1, "end", 99.0), (2, "z", 1.0)],
    ]
    for k, rows in enumerate(batches):
        put(spark, src, rows, schema)
        drain(spark, stream(), tmp_path, fail_at=2 if k == 2 else None)
        if k == 2:
            drain(spark, stream(), tmp_path)
    got = sorted((r.run, r.place, r.task, r.late) for r in result(spark, tmp_path))
    assert got == [(1, 1, "a", False), (1, 2, "e", False), (1, 3, "late", True), (1, 4, "b", False), (1, 5, "c", False), (1, 6, "d", False), (1, 7, "f", False)]


def test_patience_lets_the_rest_go(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k int, v long"
    put(spark, src, [(1, 1), (1, 2), (1, 3)], schema)
    out = held.rechunked(st.file_stream(spark, src, schema), "k", 2, patience=1)
    q = out.writeStream.format("memory").queryName("patient").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(40):
            q.awaitTermination(0.5)
            if spark.table("patient").count() == 3:
                break
    finally:
        q.stop()
    assert sorted(r.release for r in spark.table("patient").collect()) == [0, 0, 1]


def test_groups_leave_when_full(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "id int, v double"
    put(spark, src, [(1, 1.0), (2, 1.0)], schema)
    put(spark, src, [(1, 5.0), (3, 1.0)], schema)
    groups = st.full_groups(st.file_stream(spark, src, schema), "id", "v", 2)
    q = groups.writeStream.format("memory").queryName("full").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.id, sorted(r["values"])) for r in spark.table("full").collect()] == [(1, [1.0, 5.0])]
