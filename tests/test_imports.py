"""Folders of experiments, and files that are numbered, zipped and looked up by line."""

import json

import pytest

from tessera.sources import datasets as ds
from tessera.sources import imports as im


def write(folder, **files):
    folder.mkdir()
    for name, lines in files.items():
        (folder / name.replace("__", ".")).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(folder)


def said(*roles):
    return [{"role": r, "content": "x"} for r in roles]


def test_kinds_of_folders(spark, tmp_path):
    cases = [({"a_n1__jsonl": [], "x__pos__jsonl": []}, "eval"), ({"x__neg__jsonl": [], "1__jsonl": []}, "collection"), ({"12__jsonl": [], "notes__jsonl": []}, "rollout"), ({"notes__jsonl": [], "x1__jsonl": []}, None)]
    for k, (files, kind) in enumerate(cases):
        folder = write(tmp_path / f"f{k}", **files)
        assert im.experiment_type(spark, folder) == kind
        names = spark.createDataFrame([(f"{folder}/{n}",) for n in im.file_names(spark, folder)], "path string")
        assert ds.folder_type(names).first().type == kind
    with pytest.raises(ValueError, match="no trajectories"):
        im.imported(spark, folder)


def test_a_mixed_folder_of_rollouts(spark, tmp_path):
    folder = write(
        tmp_path / "r", **{"2__jsonl": [said("user", "assistant", "assistant"), "", "{bad", {"messages": said("assistant")}, {"other": 1}, [], "[1, \"a\"]"], "10__jsonl": ['[{"role": "assistant", "content": "a\tb"}]'], "notes__jsonl": [said("user")]}
    )
    got = {r.instance_id: (r.n_steps, r.role, r.reward, r.sample_idx) for r in im.imported(spark, folder).collect()}
    assert got == {"rollout_2_0": (2, "primary", None, 0), "rollout_2_1": (1, "primary", None, 0), "rollout_2_3": (0, "primary", None, 0), "rollout_2_4": (0, "primary", None, 0), "rollout_10_0": (1, "primary", None, 0)}
    s = im.import_summary(im.imported(spark, folder)).first()
    assert (s["mode"], s.total, s.files) == ("rollout", 5, 2)


def test_a_collection_with_both_sides(spark, tmp_path):
    folder = write(
        tmp_path / "c", a__pos__jsonl=[{"instance_id": "i", "messages": said("assistant"), "termination_reason": "DONE"}, [1], "{"], b__pos__jsonl=[{}], a__neg__jsonl=[{"instance_id": "i", "messages": said("user")}], **{"1__jsonl": [said("user")]}
    )
    got = sorted((r.role, r.instance_id, r.reward, r.n_steps, r.termination_reason, json.loads(r.messages)) for r in im.imported(spark, folder).collect())
    assert got == [("chosen", "", 1.0, 0, "", []), ("chosen", "i", 1.0, 1, "DONE", said("assistant")), ("rejected", "i", 0.0, 0, "", said("user"))]
    s = im.import_summary(im.collected(spark, folder)).first()
    assert (s["mode"], s.pos, s.neg, s.instances) == ("dpo", 2, 1, 2)


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    folder = write(tmp_path / "s", **{f"{k}__jsonl": ["{bad" if i % 10 == 3 else [{"n": i}] for i in range(400 * k)] for k in (1, 2, 3)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = im.good_lines(spark, folder, im.KINDS["rollout"]).selectExpr("file", "line", "variant_get(value, '$[0].n', 'int') as n").collect()
        files = spark.read.text(f"{folder}/1.jsonl")
        assert files.rdd.getNumPartitions() > 1
        zipped = ds.zipped(files, spark.read.text(f"{folder}/2.jsonl").withColumnRenamed("value", "other"))
        assert zipped.count() == 400 and zipped.where("value <> other").count() == 0
        found = ds.looked_up_at(files, spark.createDataFrame([(7,), (7,), (399,), (400,)], "line long"))
        assert sorted(json.loads(r.value)[0]["n"] for r in found.collect()) == [7, 7, 399]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for k in (1, 2, 3):
        mine = sorted((r.line, r.n) for r in rows if r.file == f"{k}.jsonl")
        assert mine == list(enumerate(i for i in range(400 * k) if i % 10 != 3))
