"""Call graphs from stack traces: frames out of logs, hop distances, localisation cases, callables out of source."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalise import is_test_path, sandbox_path
from .sequence import minimal_hops, next_marker_distance, normalised_hops

FRAME = "struct<file_path:string,func_name:string,line_no:int>"
#: Parts of paths that are not the repository's own.
FOREIGN = r"site-packages|\.venv"


def text_frames(log: Column) -> Column:
    """Frames (outer to inner) of Python tracebacks in a log; files outside the repository are left out."""
    raw = F.regexp_extract_all(log, F.lit(r'(File "[^"]+", line \d+, in \S+)'), F.lit(1))
    frames = F.transform(
        raw,
        lambda x: F.struct(
            sandbox_path(F.regexp_extract(x, r'File "([^"]+)"', 1)).alias("file_path"), F.regexp_extract(x, r", in (\S+)$", 1).alias("func_name"), F.regexp_extract(x, r"line (\d+),", 1).cast("int").alias("line_no")
        ),
    )
    return F.filter(frames, lambda f: ~f["file_path"].rlike(FOREIGN))


def json_frames(text: Column) -> Column:
    """Traces of JSON lines, each an array of frames; bad lines are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    return F.filter(F.transform(lines, lambda x: F.from_json(x, f"array<{FRAME}>")), lambda t: t.isNotNull() & (F.size(t) > 0))


def trace_hops(frames: DataFrame, trace: Sequence[str], order: Sequence[str], patched: Column, instance: str, node: str) -> DataFrame:
    """Per instance and node: hop_distance and normalized_distance over all traces (frames outer to inner)."""
    hops = minimal_hops(next_marker_distance(frames, trace, order, patched), instance, node)
    return normalised_hops(hops, instance, "hop_distance", is_test_path(F.element_at(F.split(F.col(node), "::"), 1)))


def distinct_traces(df: DataFrame, instance: str, frames: str) -> DataFrame:
    """Traces that differ in files or functions."""
    key = F.transform(frames, lambda f: F.concat_ws("::", f["file_path"], f["func_name"]))
    return df.withColumn("trace_key", key).dropDuplicates([instance, "trace_key"])


def observed_tests(df: DataFrame, frames: str, wanted: Column, fixtures: Sequence[str] = ()) -> DataFrame:
    """Traces with a test-file frame whose bare name is wanted, or one of the fixtures; nothing wanted keeps none."""
    bare = lambda f: F.regexp_replace(F.element_at(F.split(f["func_name"], r"\."), -1), r"\[.*\]$", "")
    names = F.when(F.size(wanted) > 0, F.concat(wanted, F.array(*map(F.lit, fixtures)).cast("array<string>")))
    return df.where(F.exists(frames, lambda f: is_test_path(f["file_path"]) & F.array_contains(names, bare(f))))


def non_test_sources(files: Column, allowed: Column | None = None) -> Column:
    """Python files of a diff: those allowed, or without a list those that are no tests."""
    return F.filter(files, lambda p: p.endswith(".py") & (F.array_contains(allowed, p) if allowed is not None else ~is_test_path(p)))


def set_report(observed: Column, expected: Column) -> Column:
    """Sizes of what both have and of what one lacks."""
    return F.struct(F.size(F.array_intersect(observed, expected)).alias("both"), F.size(F.array_except(expected, observed)).alias("unobserved"), F.size(F.array_except(observed, expected)).alias("extra"))


def static_category(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, joined; none if none does."""
    return F.coalesce(F.nullif(F.concat_ws("+", *(F.when(c, F.lit(n)) for n, c in flags.items())), F.lit("")), F.lit("none"))


CALLABLE = "name string, qualified_name string, start_line int, end_line int, decorated_line int, source string, own_source string"


def callables_of(source: str | None) -> Iterator[tuple]:
    """Rows of CALLABLE of a module, none if it doesn't parse. Lines are from the def on; decorated_line is the first
    decorator's, or else the def's; own_source leaves out the lines of callables inside."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = (source or "").splitlines()
    stack = [(tree, "")]
    while stack:
        node, prefix = stack.pop()
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                inside = {k for c in ast.walk(n) if c is not n and isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef) for k in range(c.lineno, c.end_lineno + 1)}
                span = range(n.lineno, n.end_lineno + 1)
                decorated = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                yield n.name, prefix + n.name, n.lineno, n.end_lineno, decorated, "\n".join(lines[k - 1] for k in span), "\n".join(lines[k - 1] for k in span if k not in inside)
                stack.append((n, f"{prefix}{n.name}.<locals>."))
            else:
                stack.append((n, f"{prefix}{n.name}." if isinstance(n, ast.ClassDef) else prefix))


@F.udtf(returnType=CALLABLE, useArrow=True)
class Callables:
    """Table function source -> CALLABLE, for lateral joins and, registered, for SQL."""

    def eval(self, source: str):  # noqa: ANN201
        yield from callables_of(source)


#: Modules parsed at once.
PARSED = 256


def callables(df: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """key and CALLABLE: a row for each callable of each source."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    modules = df.select(*key, F.col(source).cast("string").alias("__source")).repartition(width, *key)  # parsing takes far longer than a small file's few tasks suggest
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [*key, *(c.split()[0] for c in CALLABLE.split(", "))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for a in range(0, whole.num_rows, PARSED):
                batch = whole.slice(a, PARSED)
                found = [(i, *c) for i, s in enumerate(batch.column(len(key)).to_pylist()) for c in callables_of(s)]
                at, *columns = zip(*found, strict=True) if found else [()] * (len(types) + 1)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(key))), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return modules.mapInArrow(run, StructType([*df.select(*key).schema.fields, *StructType.fromDDL(CALLABLE).fields]))


def modified(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Callables in both whose own source differs, as they are in old; of several with one name the last counts."""
    on = [*key, "qualified_name"]
    last = lambda df, *more: df.groupBy(*on).agg(*(F.max_by(c, "start_line").alias(c) for c in ("own_source", *more)))
    n = last(new).withColumnRenamed("own_source", "new_source")
    return last(old, "name", "start_line", "end_line", "decorated_line", "source").join(n, on).where("own_source <> new_source").drop("new_source")


def added_and_deleted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    on = [*key, "qualified_name"]
    return new.join(old.select(*on), on, "left_anti"), old.join(new.select(*on), on, "left_anti")
