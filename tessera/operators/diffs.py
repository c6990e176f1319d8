"""Line diffs: hunks out of pairs of texts, line numbers and kinds out of unified text, unified text out of structured commits."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalise import is_test_path

CONTEXT = 3
HUNK = "hunk int, old_start int, old_length int, new_start int, new_length int, lines array<string>, old_changed array<int>, new_changed array<int>"
_RANGE = "struct<start:int,length:int>"
_COMMIT = (
    "struct<file_diffs:array<struct<header:struct<file:struct<path:string>>,minus_file:struct<path:string>,plus_file:struct<path:string>,"
    f"hunks:array<struct<descriptor:struct<old_range:{_RANGE},new_range:{_RANGE},section:string>,line_group:struct<all_lines:array<struct<content:string,type:string>>>>>>>>"
)


def common_lines(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order.

    Equal ends match as they are. Between them every pair of equal lines is met once, and the least end in b of a
    common subsequence of each length is kept; time grows with the number of such pairs.
    """
    start, ends = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while ends < min(len(a), len(b)) - start and a[-1 - ends] == b[-1 - ends]:
        ends += 1
    places = defaultdict(list)
    for j in range(len(b) - ends - 1, start - 1, -1):
        places[b[j]].append(j)
    least: list[int] = []
    chains: list[tuple] = []  # (i, j, chain before)
    for i in range(start, len(a) - ends):
        for j in places.get(a[i], ()):
            k = bisect_left(least, j)
            chain = (i, j, chains[k - 1] if k else None)
            if k == len(least):
                least.append(j)
                chains.append(chain)
            elif j < least[k]:
                least[k], chains[k] = j, chain
    middle = []
    at = chains[-1] if chains else None
    while at:
        middle.append(at[:2])
        at = at[2]
    return [(k, k) for k in range(start)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(ends, 0, -1)]


def hunks_of(old: str | None, new: str | None, context: int = CONTEXT) -> Iterator[tuple]:
    """Rows of HUNK. A null text has no lines; a length of 0 has the number of the line before as its start."""
    a, b = ((x.split("\n") if x is not None else []) for x in (old, new))
    rows: list[tuple[str, int, int]] = []  # sign, place in old, place in new
    i = j = 0
    for x, y in [*common_lines(a, b), (len(a), len(b))]:
        rows += [("-", k, j) for k in range(i, x)] + [("+", x, k) for k in range(j, y)]
        if x < len(a) or y < len(b):
            rows.append((" ", x, y))
        i, j = x + 1, y + 1
    changed = [k for k, r in enumerate(rows) if r[0] != " "]
    groups: list[list[int]] = []
    for k in changed:
        if groups and k - groups[-1][1] - 1 <= 2 * context:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    for n, (first, last) in enumerate(groups):
        part = rows[max(0, first - context) : last + context + 1]
        olds, news = ([r for r in part if r[0] in signs] for signs in ("- ", "+ "))
        starts = [part[0][1 + s] + (1 if side else 0) for s, side in enumerate((olds, news))]
        lines = [s + (b[y] if s == "+" else a[x]) for s, x, y in part]
        yield n, starts[0], len(olds), starts[1], len(news), lines, [x + 1 for s, x, _ in part if s == "-"], [y + 1 for s, _, y in part if s == "+"]


@F.udtf(returnType=HUNK, useArrow=True)
class Hunks:
    """Table function (old text, new text, context) -> HUNK, for lateral joins and, registered, for SQL."""

    def eval(self, old: str, new: str, context: int):  # noqa: ANN201
        yield from hunks_of(old, new, context)


def hunks(pairs: DataFrame, old: str, new: str, context: int = CONTEXT) -> DataFrame:
    """A row for each hunk between two texts of a row, beside that row's columns."""
    return pairs.lateralJoin(Hunks(F.col(old).outer(), F.col(new).outer(), F.lit(context)))


def hunk_text() -> Column:
    """The unified text of a row of HUNK."""
    return F.concat(F.format_string("@@ -%d,%d +%d,%d @@\n", "old_start", "old_length", "new_start", "new_length"), F.array_join("lines", "\n"))


def diff_lines(diffs: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """key, hunk, sign, content, old_line, new_line of unified text: one row a line of a hunk, numbered by running counts.

    Only lines after a hunk's header count; a line's own number is null on the side that lacks it.
    """
    lines = diffs.select(*key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    order = Window.partitionBy(*key).orderBy("pos")
    header = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    lines = lines.withColumn("head", F.startswith("line", F.lit("@@"))).withColumn("hunk", F.count_if("head").over(order) - 1).where("hunk >= 0")
    first = Window.partitionBy(*key, "hunk").orderBy("pos")
    start = [F.first(F.regexp_extract("line", header, k)).over(first).try_cast("int") for k in (1, 2)]
    sign = F.left("line", F.lit(1))
    counted = lambda signs: F.count_if(~F.col("head") & sign.isin(*signs)).over(first)
    numbered = lines.select(*key, "hunk", "head", sign.alias("sign"), F.substr("line", F.lit(2)).alias("content"), (start[0] + counted("- ") - 1).alias("old_line"), (start[1] + counted("+ ") - 1).alias("new_line"))
    kept = numbered.where(~F.col("head") & F.col("sign").isin("+", "-", " "))
    return kept.select(*key, "hunk", "sign", "content", F.when(F.col("sign") != "+", F.col("old_line")).alias("old_line"), F.when(F.col("sign") != "-", F.col("new_line")).alias("new_line"))


def changed_lines(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, hunk, old_changed, new_changed, change: numbers of changed lines, and swap, add or remove where decorators alone change."""
    minus, plus = F.col("sign") == "-", F.col("sign") == "+"
    decorated = F.startswith(F.ltrim("content"), F.lit("@"))
    plain = F.count_if((minus | plus) & ~decorated)
    change = F.when(plain > 0, None).when((F.count_if(minus) > 0) & (F.count_if(plus) > 0), "swap").when(F.count_if(plus) > 0, "add").when(F.count_if(minus) > 0, "remove")
    numbers = lambda side, c: F.array_sort(F.collect_list(F.when(side, F.col(c)))).alias
    return lines.groupBy(*key, "hunk").agg(numbers(minus, "old_line")("old_changed"), numbers(plus, "new_line")("new_changed"), change.alias("change"))


def commit_patch(commit: Column, relevant: Column | None = None) -> Column:
    """Unified text of a structured commit (JSON), of its Python files that are relevant, or without such a list no tests; empty for bad JSON."""
    signs = F.create_map(F.lit("context"), F.lit(" "), F.lit("deleted"), F.lit("-"), F.lit("added"), F.lit("+"))
    path = lambda f: f["header"]["file"]["path"]

    def of_hunk(h: Column) -> Column:
        r = lambda side, part: F.coalesce(h["descriptor"][side][part], F.lit(0)).cast("string")
        section = F.nullif(h["descriptor"]["section"], F.lit(""))
        head = F.concat(F.lit("@@ -"), r("old_range", "start"), F.lit(","), r("old_range", "length"), F.lit(" +"), r("new_range", "start"), F.lit(","), r("new_range", "length"), F.lit(" @@"), F.coalesce(F.concat(F.lit(" "), section), F.lit("")))
        known = F.filter(h["line_group"]["all_lines"], lambda x: F.map_contains_key(signs, F.coalesce(x["type"], F.lit("context"))))
        body = F.transform(known, lambda x: F.concat(F.try_element_at(signs, F.coalesce(x["type"], F.lit("context"))), F.coalesce(x["content"], F.lit(""))))
        return F.concat(F.array(head), F.coalesce(body, F.array().cast("array<string>")))

    def of_file(f: Column) -> Column:
        minus, plus = F.coalesce(f["minus_file"]["path"], F.concat(F.lit("a/"), path(f))), F.coalesce(f["plus_file"]["path"], F.concat(F.lit("b/"), path(f)))
        head = F.array(F.concat(F.lit("diff --git "), minus, F.lit(" "), plus), F.concat(F.lit("--- "), minus), F.concat(F.lit("+++ "), plus))
        return F.array_join(F.concat(head, F.flatten(F.transform(f["hunks"], of_hunk))), "\n")

    wanted = lambda f: F.when(relevant.isNotNull(), F.array_contains(relevant, path(f))).otherwise(~is_test_path(path(f))) if relevant is not None else ~is_test_path(path(f))
    files = F.filter(F.from_json(commit, _COMMIT)["file_diffs"], lambda f: F.endswith(path(f), F.lit(".py")) & (F.size(f["hunks"]) > 0) & wanted(f))
    return F.coalesce(F.array_join(F.transform(files, of_file), "\n"), F.lit(""))
