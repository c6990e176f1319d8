"""Text normalisation and overlap scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def collapsed(s: Column) -> Column:
    """Lower case, trimmed, white space as single spaces."""
    return F.regexp_replace(F.btrim(F.lower(s)), r"\s+", " ")


def answer_words(s: Column) -> Column:
    """Lower case, without punctuation and articles, single spaces."""
    words = F.split(F.regexp_replace(F.translate(F.lower(s), PUNCTUATION, ""), r"\s+", " "), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", "a", "an", "the")), " ")


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda x: x != "")


def common_tokens(p: Column, g: Column) -> Column:
    """Size of the multiset both share: one pass over the tokens of both in order, counting a token on each side until the next."""
    marked = F.array_sort(F.concat(F.transform(p, lambda x: F.struct(x.alias("x"), F.lit(1).alias("side"))), F.transform(g, lambda x: F.struct(x.alias("x"), F.lit(0).alias("side")))))
    state = lambda token, a, b, total: F.struct(token.alias("x"), a.alias("a"), b.alias("b"), total.alias("total"))
    zero = F.lit(0)

    def step(s: Column, e: Column) -> Column:
        again = F.coalesce(s["x"] == e["x"], F.lit(False))
        kept = lambda side: F.when(again, s[side]).otherwise(zero)
        return state(e["x"], kept("a") + e["side"], kept("b") + 1 - e["side"], F.when(again, s["total"]).otherwise(s["total"] + F.least(s["a"], s["b"])))

    return F.aggregate(marked, state(F.lit(None).cast("string"), zero, zero, zero), step, lambda s: s["total"] + F.least(s["a"], s["b"]))


def let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """fn over a struct of values that are computed once; a lambda would compute them for each element."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), fn), F.lit(0))


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of normalised token multisets; yes, no and noanswer only agree with themselves; nothing in common is 0."""

    def score(s: Column) -> Column:
        same, special = common_tokens(s["a"], s["b"]), F.lit(False)
        for x in ("p", "g"):
            special = special | (s[x].isin("yes", "no", "noanswer") & (s["p"] != s["g"]))
        return F.when(special | (same == 0), 0.0).otherwise(2.0 * same / (F.size(s["a"]) + F.size(s["b"])))

    return let(lambda s: let(score, p=s["p"], g=s["g"], a=tokens(s["p"]), b=tokens(s["g"])), p=answer_words(prediction), g=answer_words(truth))


def exact_match(prediction: Column, truth: Column) -> Column:
    return answer_words(prediction) == answer_words(truth)


def set_f1(prediction: Column, truth: Column) -> Column:
    """F1 of lower-case token sets."""
    a, b = (F.array_distinct(tokens(collapsed(x))) for x in (prediction, truth))
    same = F.size(F.array_intersect(a, b))
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(a) + F.size(b)))


def best_f1(prediction: Column, truths: Column) -> Column:
    """Best over several truths; an exact match is 1."""
    return F.aggregate(F.transform(truths, lambda t: F.when(exact_match(prediction, t), F.lit(1.0)).otherwise(token_f1(prediction, t))), F.lit(0.0), lambda acc, x: F.greatest(acc, x))


def shortened(s: Column, n: int) -> Column:
    """At most n characters, the last three as dots if cut."""
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n - 3)), F.lit("..."))).otherwise(s)


def middle_cut(s: Column, keep: int) -> Column:
    """The first and last ``keep`` words, dots for those between."""
    w = F.split(s, " ")
    return F.when(F.size(w) <= 2 * keep, s).otherwise(F.concat_ws(" ", F.slice(w, 1, keep), F.lit("..."), F.slice(w, -keep, keep)))


def fingerprint(statement: Column, length: int = 250) -> Column:
    """A problem statement without its tag, bold labels and extra white space."""
    s = F.regexp_replace(F.regexp_replace(statement, r"\[/?ISSUE\]", ""), r"\*\*[^*\n]*\*\*:?", "")
    return F.left(F.btrim(F.regexp_replace(s, r"\s+", " ")), F.lit(length))


def is_test_path(path: Column) -> Column:
    """A part is tests, test or testing, starts with test_ or ends in _test.py."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.exists(parts, lambda p: p.isin("tests", "test", "testing") | p.startswith("test_") | p.endswith("_test.py"))


def sandbox_path(path: Column, prefixes: tuple[str, ...] = ("/testbed/", "/workspace/", "/repo/", "./")) -> Column:
    """The path without the first of the prefixes that it has."""
    import re

    return F.regexp_replace(path, "^(?:" + "|".join(re.escape(p) for p in prefixes) + ")", "")
