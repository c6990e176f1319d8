"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared by their words. A line goes if an earlier line (smaller document id,
then smaller line number) has the same words or, for lines of ``min_words`` words or more (by default
``MIN_WORDS``: one word of five is a similarity of 0.8), is within one word edit (a word put in, left out or replaced). A deletion variant is the
line without one word: two lines are within one edit if a variant of one equals the
other, or if their variants without the word at one place are equal.

1. Equal lines meet by two 64-bit hashes of their words.
2. Lines within one edit share their first or last half (of either length), so only lines that
   share a half with a different line go on. This loses none.
3. These emit all variants as hashed keys: a key sums hashes of neighbouring words, so leaving
   a word out changes three terms. Equal keys join through the earliest line of each key (not
   as pairs), and every join is verified on the words.

Joins whose one side has at most one row a half or a line hash that side, so the many rows of the other are not sorted;
the join with the earliest of each variant stays sorted, as its keys grow with the words and a sort can spill.

Defined cases: lines without words stay and null texts stay null; empty texts have no lines; rows
with one id count as one document that holds one text; rows with a null id are documents after all others, one for
each text, and keep their null; ties go by id and line; an empty table gives an empty result; other columns are passed through by ``without_repeated_lines`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_name, id_again, id_and_text, id_of, named, written

MIN_WORDS = 5
_ID = ["h1", "h2"]


def _words(line: Column) -> Column:
    # translate looks at one code point after another, so only lines with such a blank pay for it
    spaced = F.when(line.rlike("[\t\x0b\x0c\r\n]"), F.translate(line, "\t\x0b\x0c\r\n", "     ")).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """doc, line, n, h1, h2 and the half keys (null under min_words) of every line with words."""
    src = id_and_text(docs, id_col, text_col).select(F.col("id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    # by the text and not by n: a filter on n is pushed below the words and cuts every line a second time
    src = src.where(F.col("text").rlike("[^ \t\x0b\x0c\r\n]")).select("doc", "line", _words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    a, b = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") + 1) / 2).cast("int")

    def first(k: Column) -> Column:
        return F.xxhash64(F.lit("first"), F.slice("w", F.lit(1), k))

    def last(k: Column) -> Column:
        return F.xxhash64(F.lit("last"), F.slice("w", F.col("n") - k + 1, k))

    # an even length shares one first half and two last halves with its neighbours, an odd one the other way round
    halves = F.when(F.col("n") % 2 == 0, F.array(first(a), last(a), last(a + 1))).otherwise(F.array(first(a), first(b), last(b)))
    return src.select("doc", "line", "n", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), F.when(F.col("n") >= min_words, halves).alias("halves"))


def _pair(x: Column, y: Column, salt: int) -> Column:
    """40 bits for two neighbouring words, so that sums stay in 64 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), x, y), 24)


def _pair_of(salt: int) -> Callable[[Column, Column], Column]:
    return lambda x, y: _pair(x, y, salt)


def _variants(words: DataFrame) -> DataFrame:
    """h1, h2, doc, line, place (-1: the whole line), m (words), v1, v2 of each line and its deletion variants."""
    w = words.withColumn("p", F.concat(F.array(F.lit("\n")), "w", F.array(F.lit("\n")))).withColumn("n", F.size("w"))
    for s in (1, 2):
        sums = F.zip_with(F.slice("p", F.lit(1), F.col("n") + 1), F.slice("p", F.lit(2), F.col("n") + 1), _pair_of(s))
        w = w.withColumn(f"g{s}", sums)
        w = w.withColumn(f"t{s}", F.aggregate(f"g{s}", F.lit(0).cast("long"), lambda acc, x: acc + x))

    def without(s: int, i: Column) -> Column:
        g = F.col(f"g{s}")
        return F.col(f"t{s}") - F.element_at(g, i + 1) - F.element_at(g, i + 2) + _pair(F.element_at("p", i + 1), F.element_at("p", i + 3), s)

    left_out = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("place"), (F.col("n") - 1).alias("m"), without(1, i).alias("v1"), without(2, i).alias("v2")))
    whole = F.array(F.struct(F.lit(-1).alias("place"), F.col("n").alias("m"), F.col("t1").alias("v1"), F.col("t2").alias("v2")))
    return w.select(*_ID, "doc", "line", F.explode(F.concat(whole, left_out)).alias("v")).select(*_ID, "doc", "line", "v.*")


def _within_one_edit(u: Column, v: Column) -> Column:
    """u and v are word arrays."""
    n, m = F.size(u), F.size(v)
    differ = F.array_position(F.zip_with(u, v, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    p = F.when(differ == 0, F.least(n, m)).otherwise(differ - 1)  # words in front that agree

    def rest(x: Column, skip: Column) -> Column:
        return F.slice(x, p + skip + 1, F.size(x))

    one, none = F.lit(1), F.lit(0)
    return (
        F.when(n == m, rest(u, one) == rest(v, one)).when(n == m + 1, rest(u, one) == rest(v, none)).when(m == n + 1, rest(u, none) == rest(v, one)).otherwise(False)
    )


def _near(lines: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h1, h2 of lines that have an earlier line within one edit."""
    keyed = lines.where("halves is not null").select(*_ID, F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    some = keyed.join(shared.hint("shuffle_hash"), "half", "left_semi").select(*_ID).distinct()
    first = lines.join(some.hint("shuffle_hash"), _ID, "left_semi").groupBy(*_ID).agg(F.min(F.struct("doc", "line")).alias("e")).select(*_ID, "e.*")
    by_doc = first.groupBy("doc").agg(F.collect_list(F.struct("line", *_ID)).alias("some"))
    text = id_and_text(docs, id_col, text_col).toDF("doc", "t")
    text = text.join(by_doc.hint("shuffle_hash"), "doc").withColumn("all", F.split("t", "\n"))
    picked = F.transform("some", lambda x: F.struct(x["line"].alias("line"), x["h1"].alias("h1"), x["h2"].alias("h2"), _words(F.get("all", x["line"])).alias("w")))
    words = text.select("doc", F.explode(picked).alias("x")).select("doc", "x.*").where("xxhash64(w) = h1").dropDuplicates(_ID)
    words = written(words, "lines")
    variants = written(_variants(words), "lines")
    key = ["m", "v1", "v2"]
    order = F.struct("doc", "line", *_ID)
    # lines that differ in the word at one place: all with the earliest of the key
    left_out = variants.where("place >= 0")
    groups = left_out.groupBy(*key, "place").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min(order).alias("e")).where("a <> b").select(*key, "place", "e")
    replaced = left_out.join(groups, [*key, "place"]).select(*_ID, "e").where("e.h1 <> h1 or e.h2 <> h2")
    # a line that is another's variant: both ways, again with the earliest
    whole = variants.where("place < 0").select(*key, F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.struct("doc", "line", *_ID).alias("w"))
    met = left_out.select(*key, *_ID, order.alias("o")).join(whole.hint("shuffle_hash"), key)
    longer = met.where("w < o").select(*_ID, F.col("w").alias("e"))
    shorter = met.where("o < w").groupBy("k1", "k2").agg(F.min("o").alias("e")).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "e")
    pairs = replaced.union(longer).union(shorter).select(*_ID, F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()
    mine = words.select(*_ID, F.col("w").alias("u"))
    other = words.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("w").alias("v"))
    return pairs.join(mine, _ID).join(other, ["e1", "e2"]).where(_within_one_edit(F.col("u"), F.col("v"))).select(*_ID).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, line, gone of every line with words."""
    lines = written(_lines(docs, id_col, text_col, min_words), "lines")
    near = written(_near(lines, docs, id_col, text_col), "lines")
    copied = lines.groupBy(*_ID).agg(F.min(F.struct("doc", "line")).alias("e"), F.count("*").alias("c")).where("c > 1").select(*_ID, "e")
    known = copied.join(near.withColumn("near", F.lit(True)), _ID, "full")
    gone = F.coalesce(F.col("near") | (F.col("e.doc") != F.col("doc")) | (F.col("e.line") != F.col("line")), F.col("near"), F.lit(False))
    return lines.select("doc", "line", *_ID).join(known.hint("shuffle_hash"), _ID, "left").select("doc", "line", gone.alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id_col, n_lines (with words), n_removed, removed (line numbers from 0, in order) of every document."""
    marks = repeated_lines(docs, id_col, text_col, min_words).distinct().groupBy("doc").agg(
        F.count("*").alias("n_lines"), F.count_if("gone").alias("n_removed"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed")
    )
    out = id_and_text(docs, id_col, text_col).select("id").join(marks, F.col("id") == F.col("doc"), "left")
    return out.select(id_again("id").alias(free_name(id_col, ["n_lines", "n_removed", "removed"])), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated lines taken out of their texts; all columns and rows stay."""
    of, found = free_name("of", docs.columns), free_name("gone", docs.columns)
    gone = repeated_lines(docs, id_col, text_col, min_words).where("gone").groupBy(F.col("doc").alias(of)).agg(F.collect_set("line").alias(found))
    text = F.array_join(F.filter(F.split(named(text_col), "\n"), lambda x, i: ~F.array_contains(found, i)), "\n")
    joined = docs.join(gone.hint("shuffle_hash"), id_of(id_col, text_col) == F.col(of), "left")
    return joined.select(*(F.when(F.col(found).isNull(), named(c)).otherwise(text).alias(c) if c == text_col else named(c) for c in docs.columns))
