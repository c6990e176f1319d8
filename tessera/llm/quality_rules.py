"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on text statistics. The number of
vote patterns is bounded (3 ** rules), so their counts over the whole corpus are one
small aggregate; expectation-maximisation on those counts estimates each rule's
shares of votes by class and the share of good documents, and every document gets the posterior
probability of its pattern.

Defined cases: a null text counts as empty; an empty text has zero statistics and
fails the base test; repeated rows are scored each for itself, and so are rows with a null id, which
stays null; an empty table gives an empty result; other columns, whatever their names, are not
read by ``quality_rules`` and come through ``accepted`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textnum as tn
from .store import free_name, named, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RULES = ("length", "symbols", "letters", "lines", "repeats", "word_length", "upper")
THRESHOLD = 0.5
#: Documents of each class that the expected shares stand for (a few, whatever the corpus holds), and
#: these shares of bad votes, abstentions and good votes on good and on bad documents.
PSEUDO = 20.0
PRIOR_GOOD, PRIOR_BAD = (0.004, 0.03, 0.966), (0.25, 0.05, 0.7)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True  # ASCII letters and the first byte of longer characters
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def text_statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A column for each of STATS, a row for each text."""
    n = len(off) - 1
    words = tn.Words(buf, off)
    pre = tn.prefix_hash(buf)
    n_words = np.diff(words.first)
    chars = tn.sums(words.full & ((buf & 0xC0) != 0x80), off)
    symbols = tn.sums(_SYMBOL[buf], off)
    upper, letters = tn.sums(_UPPER[buf], off), tn.sums(_LETTER[buf], off)
    # lines that hold a word
    cut = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([off[:-1], cut + 1]))
    at = np.searchsorted(cut, start)
    end = np.append(cut, len(buf))[at]
    doc = np.searchsorted(off, start, "right") - 1
    ok = (start < len(buf)) & (doc < n)
    start, end, doc = start[ok], end[ok], doc[ok]
    end = np.minimum(end, off[doc + 1])
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has], end[has], doc[has]
    lines = np.bincount(doc, minlength=n)[:n]
    key = tn.fold([tn.span_hash(pre, start, end), doc.astype(np.uint64)])
    first = np.unique(key, return_index=True)[1]
    dup = lines - np.bincount(doc[first], minlength=n)[:n]
    # windows of WINDOW words found twice in one text
    repeat = np.zeros(n, np.int64)
    if len(words.start) >= WINDOW:
        h = tn.span_hash(pre, words.start, words.end)
        wdoc = words.doc()
        m = len(h) - WINDOW + 1
        whole = wdoc[:m] == wdoc[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        keys = tn.fold([wdoc[:m].astype(np.uint64)] + [h[k : m + k] for k in range(WINDOW)])[at]
        hit = at[tn.repeated_keys(keys)]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        repeat = np.bincount(wdoc[np.cumsum(cover[:-1]) > 0], minlength=n)[:n]
    return np.stack([n_words, chars, symbols, dup, repeat, lines, upper, letters], 1).astype(np.int64)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and STATS of every whole text."""
    stats = _measured(docs.select(named(id_col).alias("__id"), named(text_col).cast("string").alias("__text")))
    return stats.withColumnRenamed("__id", free_name(id_col, [*STATS, *(f"vote_{r}" for r in RULES), "base_failed", "posterior", "kept"]))


def _measured(src: DataFrame) -> DataFrame:
    """src with STATS in place of its last column, the text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = [text_statistics(buf, off) for _, _, buf, off in tn.slices(batch.column(batch.num_columns - 1))]
            stats = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(stats[:, k]) for k in range(len(STATS)))], names=names)

    names = [*src.columns[:-1], *STATS]
    schema = StructType([*src.schema.fields[:-1], *(StructField(s, LongType()) for s in STATS)])
    return src.mapInArrow(run, schema)


def votes() -> dict[str, Column]:
    """Each rule's vote from STATS: 1 good, -1 bad, 0 abstains."""
    c = F.col
    w = F.greatest(c("n_words"), F.lit(1))
    ch = F.greatest(c("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(c("n_words") < MIN_WORDS, c("n_words") >= 40),
        "symbols": vote(c("n_symbols") * 20 > c("word_chars"), c("n_symbols") * 200 <= c("word_chars")),
        "letters": vote(c("n_letters") * 100 < ch * 80, c("n_letters") * 100 >= ch * 90),
        "lines": vote(c("n_dup_lines") * 10 > c("n_lines") * 3, c("n_dup_lines") == 0),
        "repeats": vote(c("n_repeat_words") * 100 > w * MAX_REPEAT_PERCENT, c("n_repeat_words") * 100 <= w * 5),
        "word_length": vote((ch < w * 2) | (ch > w * 15), (ch >= w * 3) & (ch <= w * 10)),
        "upper": vote(c("n_upper") * 10 > ch * 3, c("n_upper") * 10 <= ch),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray]:
    """(share of votes bad, none, good by rule and class (good, bad); share of good documents; posterior of each pattern).

    Documents with a bad vote start as probably bad, and ``PSEUDO`` documents of each class vote as
    PRIOR_GOOD and PRIOR_BAD say, which names the classes and smooths shares of small tables. Everything
    else comes from the counts: a rule whose bad votes the others contradict loses its weight.
    """
    bad_vote = (patterns == -1).any(1)
    posterior = np.where(bad_vote, 0.1, 0.9)
    which = patterns + 1
    shares, prior = np.zeros((patterns.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        logs = []
        for c, (weight, mean) in enumerate(((counts * posterior, PRIOR_GOOD), (counts * (1 - posterior), PRIOR_BAD))):
            for k in range(patterns.shape[1]):
                shares[k, c] = (np.bincount(which[:, k], weights=weight, minlength=3) + PSEUDO * np.array(mean)) / (weight.sum() + PSEUDO)
            logs.append(np.log(shares[np.arange(patterns.shape[1]), c, which]).sum(1))
        prior = float((counts @ posterior + 1) / (counts.sum() + 2))
        new = 1 / (1 + np.exp(np.clip(np.log1p(-prior) + logs[1] - np.log(prior) - logs[0], -700, 700)))
        done, posterior = np.abs(new - posterior).max(initial=0) < 1e-9, new
        if done:
            break
    return shares, prior, posterior


def judged(stats: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """stats with vote_<rule>, base_failed, posterior and kept."""
    v = votes()
    code = sum(((v[r] + 1) * 3**k for k, r in enumerate(RULES)), F.lit(0))
    seen = stats.groupBy(code.alias("code")).count().collect()  # at most 3 ** len(RULES) rows
    codes = np.array([r["code"] for r in seen], np.int64)
    table = np.zeros(3 ** len(RULES))
    if len(codes):
        patterns = np.stack([codes // 3**k % 3 - 1 for k in range(len(RULES))], 1)
        table[codes] = expectation_maximisation(patterns, np.array([r["count"] for r in seen], float))[2]
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lookup = F.element_at(F.array(*(F.lit(float(x)) for x in table)), code + 1)
    return (
        stats.withColumns({f"vote_{r}": v[r] for r in RULES})
        .withColumn("base_failed", base)
        .withColumn("posterior", lookup)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The verdict on every document; see the module for its columns and defined cases."""
    return judged(written(statistics(docs, id_col, text_col), "quality"), threshold)


def accepted(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the rules reject: rows travel with their statistics, so nothing is joined."""
    row = F.struct(*(named(c) for c in docs.columns)).alias("row")
    stats = written(_measured(docs.select(row, named(text_col).cast("string").alias("__text"))), "quality")
    return judged(stats, threshold).where("kept").select("row.*")
