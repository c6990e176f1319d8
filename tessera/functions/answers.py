"""Answers in model output: boxes, fences, exact arithmetic, and the rewards made of them."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .algebra import same_function

#: The rewards.
CORRECT, WRONG, TOOL_BONUS = 1.0, 0.0, 0.5
#: Units that answers may carry, names of large numbers, and the tokens round a boxed answer.
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard")
LARGE = {"trillion": 12, "billion": 9, "million": 6}
BOX_TOKENS = re.compile(r"<\|begin_of_box\|>(.*?)<\|end_of_box\|>", re.DOTALL)
_UNIT = re.compile("(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?:es)?s? *(?:\^\{?[0-9]+\}?)?")
_GROUP = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})+)\}"  # with braces of its own, two deep
_FRACTION = re.compile(r"\\[dt]?frac" + _GROUP * 2)


def boxed(text: str | None) -> str | None:
    """Content of the last box whose braces balance; None without one."""
    if text is None:
        return None
    for tag in ("\\boxed", "\\fbox"):
        at = text.rfind(tag)
        if at >= 0:
            open_ = text.find("{", at)
            depth = 0
            for k in range(open_, len(text)) if open_ >= 0 else ():
                depth += {"{": 1, "}": -1}.get(text[k], 0)
                if depth == 0:
                    return text[open_ + 1 : k]
            return None
    return None


def plain(answer: str) -> str:
    """LaTeX decoration, units, names of large numbers, thousands commas, a variable's name in front and spaces taken off; mixed numbers summed."""
    s = answer.strip().replace("\\$", "").replace("$", "")
    for word in (" or ", " and "):
        s = s.replace(word, " , ")
    for word, power in LARGE.items():
        s = re.sub(rf"\s*{word}s?\b", f"*10^{power}", s)
    s = _UNIT.sub("", re.sub(r"\\(?:text|mathrm|textbf|mbox)\{([^{}]*)\}", r" \1", s))
    s = re.sub(r"\\sqrt\s*([0-9a-zA-Z])", r"\\sqrt{\1}", s)
    s = re.sub(r"^\s*[a-zA-Z]{1,2}\s*=(?!=)", "", s)
    s = re.sub(r"(?<![\w.)}])(\d+)\s*(?=\\[dt]?frac)", r"\1+", s)
    s = re.sub(r"(?<![\w./])(\d+) +(\d+)\s*/\s*(\d+)", r"\1+\2/\3", s)
    for x in ("\\left", "\\right", "\\!", "\\,", "\\;", "\\ ", "^{\\circ}", "^\\circ", "\\%", "%", "\\$"):
        s = s.replace(x, "")
    s = re.sub(r"\\(?:text|mathrm|textbf|mbox)\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\[dt]?frac(\d)(\d)", r"\\frac{\1}{\2}", s)
    while (t := _FRACTION.sub(r"(\1)/(\2)", s)) != s:
        s = t
    s = re.sub(r"(?<=\d),(?=\d{3}\b)", "", s).replace("\\cdot", "*").replace("\\times", "*").replace("\\pi", "pi")
    s = re.sub(r"(?<![\d.])\.(?=\d)", "0.", s)
    return re.sub(r"\s+", "", s).lower().rstrip(".")


def exact_value(expression: str) -> Fraction | None:
    """Value of an arithmetic expression in exact fractions; None if it is anything else."""

    def walk(n: ast.AST) -> Fraction:
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return Fraction(str(n.value))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd | ast.USub):
            return walk(n.operand) * (1 if isinstance(n.op, ast.UAdd) else -1)
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            if isinstance(n.op, ast.Add):
                return a + b
            if isinstance(n.op, ast.Sub):
                return a - b
            if isinstance(n.op, ast.Mult):
                return a * b
            if isinstance(n.op, ast.Div):
                return a / b
            if isinstance(n.op, ast.Pow) and b.denominator == 1 and abs(b) * max(a.numerator.bit_length(), a.denominator.bit_length()) < 1 << 16:
                return a ** int(b)
        raise ValueError

    try:
        return walk(ast.parse(expression.replace("^", "**"), mode="eval"))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def parts_of(answer: str) -> list[str]:
    """Elements of a tuple or interval; else the answer alone."""
    if len(answer) > 1 and answer[0] in "([" and answer[-1] in ")]" and "," in answer:
        return [answer[0], *answer[1:-1].split(","), answer[-1]]
    return [answer]


def same_answer(a: str, b: str) -> bool:
    """Equal as normalised text, or part by part as values."""
    x, y = plain(a), plain(b)
    if x == y:
        return bool(x)
    if not x or not y:
        return False
    p, q = parts_of(x), parts_of(y)
    return len(p) == len(q) and all(same_part(u, v) for u, v in zip(p, q, strict=True))


def same_part(u: str, v: str) -> bool:
    """One part of two normalised answers.

    Two plain fractions must be written alike, since an unreduced one is no answer; a whole number equals only what is
    written as one too; all else is equal if it is the same function of at most two letters.
    """
    if u == v:
        return True
    if _PLAIN_FRACTION.fullmatch(u) and _PLAIN_FRACTION.fullmatch(v):
        return u.replace("(", "").replace(")", "") == v.replace("(", "").replace(")", "")
    whole = [_whole(x) for x in (u, v)]
    if None not in whole:
        return whole[0] == whole[1]
    if whole != [None, None]:
        return False
    u, v = (_SHORT_POWER.sub(r"^\1", x) for x in (u, v))
    letters = set(re.sub("sqrt|frac", "", u + v)) & set("abcdefghijklmnopqrstuvwxyz")
    if len(letters) > 2 or any(_HARD_POWER.search(x) for x in (u, v)):
        return False
    return bool(same_function(u, v))


_PLAIN_FRACTION = re.compile(r"-?\(?-?\d+\)?/\(?\d+\)?")
_SHORT_POWER = re.compile(r"\^\{([0-9a-z])\}")
#: Powers that are not compared: of more than one sign, or of a power.
_HARD_POWER = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]")


def _whole(x: str) -> int | None:
    """The whole number that x is written as, if it is; 2.0 is."""
    if re.fullmatch(r"[-+]?\d+(?:\.0*)?|[-+]?\.0+", x):
        return int(Fraction(x.rstrip(".")))
    return None


def final_answer(text: str | None) -> str | None:
    """Between the last pair of box tokens if there is one; else the last box."""
    found = BOX_TOKENS.findall(text or "")
    return found[-1].strip() if found else boxed(text)


@dataclass(frozen=True)
class MathRewards:
    """What each outcome is worth; ``needs_thought``: an answer without the end of a thinking part has no form."""

    correct: float = CORRECT
    wrong: float = WRONG
    no_form: float = WRONG
    no_truth: float = WRONG
    tool_bonus: float = TOOL_BONUS
    needs_thought: bool = False


def math_outcome(action: str | None, truths: list[str] | None, rewards: MathRewards = MathRewards()) -> str:
    """correct, wrong, no_form (no text, no thought where one is needed, no answer) or no_truth; the first that holds counts, form first."""
    if not action or (rewards.needs_thought and "</think>" not in action):
        return "no_form"
    answer = final_answer(action.split("</think>")[1] if "</think>" in action else action)
    if answer is None:
        return "no_form"
    known = [k for k in (boxed(t) if "\\boxed" in t else t for t in truths or [] if t is not None) if k is not None]
    if not known:
        return "no_truth"
    return "correct" if any(same_answer(answer, k) for k in known) else "wrong"


def math_reward_one(action: str | None, truths: list[str] | None, tool_call: bool, rewards: MathRewards = MathRewards()) -> float:
    """Reward of the answer after the thinking part; several truths may hold."""
    outcome = math_outcome(action, truths, rewards)
    return getattr(rewards, outcome) + (rewards.tool_bonus if tool_call and outcome == "correct" else 0)


def _boxed(s: pd.Series) -> pd.Series:
    return s.map(final_answer)


def extract_boxed(text: Column) -> Column:
    return F.pandas_udf(_boxed, T.StringType())(text)


def math_reward(action: Column, truths: Column, tool_call: Column, rewards: MathRewards = MathRewards()) -> Column:
    def run(action: pd.Series, truths: pd.Series, tool_call: pd.Series) -> pd.Series:
        return pd.Series([math_reward_one(a, None if t is None else list(t), bool(c), rewards) for a, t, c in zip(action, truths, tool_call, strict=True)], dtype=float)

    return F.pandas_udf(run, T.DoubleType())(action, truths, tool_call)


def math_kind(action: Column, truths: Column, rewards: MathRewards = MathRewards()) -> Column:
    """The outcome's name: correct, wrong, no_form or no_truth."""

    def run(action: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series([math_outcome(a, None if t is None else list(t), rewards) for a, t in zip(action, truths, strict=True)], dtype=object)

    return F.pandas_udf(run, T.StringType())(action, truths)


def equal_answers(given: Column, truth: Column) -> Column:
    """Whether two answers count as equal; null where one is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else same_answer(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, T.BooleanType())(given, truth)


def countdown_one(action: str | None, numbers: list[int] | None, target: int | None) -> float:
    """1 if the last answer uses every number once and gives the target."""
    if not action or numbers is None or target is None:
        return WRONG
    found = re.findall(r"<answer>(.*?)</answer>", action, re.DOTALL)
    if not found:
        return WRONG
    expression = found[-1].strip().split("=")[0]
    if sorted(map(int, re.findall(r"\d+", expression))) != sorted(map(int, numbers)) or not re.fullmatch(r"[\d+\-*/().\s]+", expression):
        return WRONG
    value = exact_value(expression.strip())
    return CORRECT if value is not None and abs(value - target) < Fraction(1, 100000) else WRONG


def _countdown(action: pd.Series, numbers: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([countdown_one(a, None if n is None else list(n), None if pd.isna(t) else int(t)) for a, n, t in zip(action, numbers, target, strict=True)], dtype=float)


def countdown_reward(action: Column, numbers: Column, target: Column) -> Column:
    return F.pandas_udf(_countdown, T.DoubleType())(action, numbers, target)


def symbolic_allowed(expression: Column) -> Column:
    """At most two different letters beside sqrt and frac, and no power that is hard to compare."""
    letters = F.array_distinct(F.regexp_extract_all(F.regexp_replace(expression, "sqrt|frac", ""), F.lit("([a-zA-Z])"), F.lit(1)))
    return (F.size(letters) <= 2) & ~expression.rlike(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]")


def last_code_block(text: Column) -> Column:
    """The last fenced block, trimmed; null without one."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), F.lit(1))
    return F.btrim(F.try_element_at(blocks, F.lit(-1)), F.lit(" \n\t\r"))


def without_main(code: Column) -> Column:
    """Code without its main guard and the guard's indented body."""
    lines = F.split(code, "\n")
    state = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside")),
        lambda s, x: F.when(x.rlike(r"^if\s+__name__\s*==\s*['\"]__main__['\"]"), F.struct(s["kept"].alias("kept"), F.lit(True).alias("inside")))
        .when(s["inside"] & (x.rlike(r"^\s+\S") | (F.btrim(x) == "")), s)
        .otherwise(F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), F.lit(False).alias("inside"))),
    )
    return F.array_join(state["kept"], "\n")


def same_stdout_one(a: str | None, b: str | None) -> bool:
    """Line by line, as text or as decimals."""
    x, y = ((s or "").strip().split("\n") for s in (a, b))
    if len(x) != len(y):
        return False
    for u, v in zip(x, y, strict=True):
        if u.strip() != v.strip():
            try:
                if [Fraction(t) for t in u.split()] != [Fraction(t) for t in v.split()]:
                    return False
            except (ValueError, ZeroDivisionError):
                return False
    return True


def _stdout(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_stdout_one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def same_stdout(a: Column, b: Column) -> Column:
    return F.pandas_udf(_stdout, T.BooleanType())(a, b)
