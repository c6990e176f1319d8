"""Fault traces out of test output: marker blocks in logs or JSON lines, as one table of frames, and which of them count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import is_test_path, sandbox_path
from .callgraph import FOREIGN
from .ranges import FEW, first_enclosing

#: The marks round a trace in a log, and methods that run for every test.
BEGIN, END = r"<<<FAULT_TRACE_BEGIN:[^:]+:[^:]+:\d+>>>$", "<<<FAULT_TRACE_END>>>"
FIXTURES = ("setUp", "tearDown", "setUpClass", "tearDownClass", "asyncSetUp", "asyncTearDown")
_FRAMES = "struct<frames:array<struct<file:string,line:int,name:string,code:string>>>"
COLUMNS = ("trace", "frame", "file_path", "line_no", "func_name", "line_content")


def marker_frames(logs: DataFrame, key: Sequence[str], text: str, repo: str = "/testbed") -> DataFrame:
    """key and COLUMNS of the marker blocks of logs.

    Lines pass a machine with two states, which two running aggregates over a log's lines are: a begin opens a trace (and
    gives up one that was open), an end closes it. Traces that are never closed, and lines that are no frame, are left out.
    """
    lines = logs.select(*key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    opens, closes = F.col("line").rlike(BEGIN), F.contains("line", F.lit(END))
    so_far = Window.partitionBy(*key).orderBy("pos")
    state = lines.withColumns({"trace": F.count_if(opens).over(so_far) - 1, "mark": F.last(F.when(opens, 1).when(closes, 0), ignorenulls=True).over(so_far), "closes": closes, "opens": opens})
    whole = Window.partitionBy(*key, "trace")
    inside = state.where("trace >= 0").withColumn("closed", F.max("closes").over(whole)).where("closed and mark = 1 and not opens")
    parts = F.split(F.btrim("line", F.lit(" \t\r")), ":", 4)
    rows = inside.select(*key, "trace", F.col("pos").alias("frame"), parts.alias("p")).where((F.size("p") == 4) & F.col("p")[1].try_cast("int").isNotNull())
    return _own(rows.select(*key, "trace", "frame", F.col("p")[0].alias("file"), F.col("p")[1].try_cast("int").alias("line_no"), F.col("p")[2].alias("func_name"), F.col("p")[3].alias("line_content")), key, repo)


def json_frames(logs: DataFrame, key: Sequence[str], text: str, repo: str = "/testbed") -> DataFrame:
    """The same out of JSON lines with ``frames``; bad lines are left out, and keep their number."""
    lines = logs.select(*key, F.posexplode(F.split(text, "\n")).alias("trace", "line")).select(*key, F.col("trace").cast("long"), F.from_json("line", _FRAMES)["frames"].alias("f"))
    rows = lines.select(*key, "trace", F.posexplode("f").alias("frame", "x"))
    return _own(rows.select(*key, "trace", "frame", F.col("x.file").alias("file"), F.col("x.line").alias("line_no"), F.col("x.name").alias("func_name"), F.col("x.code").alias("line_content")), key, repo)


def _own(rows: DataFrame, key: Sequence[str], repo: str) -> DataFrame:
    """Frames of the repository's own files, by their path in it."""
    path = sandbox_path(F.col("file"), (repo.rstrip("/") + "/",))
    return rows.withColumn("file_path", path).where(~F.col("file_path").rlike(FOREIGN)).select(*key, *COLUMNS)


def with_patched(frames: DataFrame, key: Sequence[str], patched: DataFrame, few: int = FEW, per: Sequence[str] = ()) -> DataFrame:
    """frames with is_patched, and qualified_name of the first patched callable that holds the line (else the frame's own name);
    traces without a patched frame go. patched: key, file_path, start_line, end_line, qualified_name, in the order of ``ord``; per: columns that tell traces of a key apart, besides their number."""
    place = F.struct(*key, "file_path")
    trace = [*key, *per, "trace"]
    ids = [*trace, "frame"]
    points = frames.select(*ids, place.alias("place"), "line_no")
    first = first_enclosing(points, patched.withColumn("place", place), "place", "line_no", "start_line", "end_line", "ord", ids, few, carry=["qualified_name"])
    named = first.select(*ids, "qualified_name")
    out = frames.join(named, ids, "left").withColumn("is_patched", F.col("qualified_name").isNotNull())
    out = out.withColumn("qualified_name", F.coalesce("qualified_name", "func_name"))
    return out.withColumn("__any", F.max("is_patched").over(Window.partitionBy(*trace))).where("__any").drop("__any")


def from_wanted_tests(frames: DataFrame, key: Sequence[str], wanted: DataFrame, test: str, fixtures: Sequence[str] = FIXTURES, per: Sequence[str] = ()) -> DataFrame:
    """Traces that a wanted test of their key began, or a fixture, which runs for them too; a key without wanted tests keeps none."""
    bare: Column = F.regexp_replace(F.element_at(F.split("func_name", r"\."), -1), r"\[.*\]$", "")
    trace = [*key, *per, "trace"]
    tests = frames.where(is_test_path(F.col("file_path"))).select(*trace, bare.alias("__bare"))
    names = wanted.select(*key, F.col(test).alias("__bare")).distinct()
    begun = tests.join(names, [*key, "__bare"], "left_semi").select(*trace)
    fixed = tests.where(F.col("__bare").isin(*fixtures)).join(names, [*key], "left_semi").select(*trace)
    return frames.join(begun.union(fixed).distinct(), trace, "left_semi")
