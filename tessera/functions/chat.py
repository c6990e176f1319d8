"""Chats as the text that models of several families read, and completions back to their parts.

A family is a grammar: for each role the pieces of a message, each a literal or a field, under a condition, and whether it is
trained on. It compiles to one column expression over an array of messages, which gives the pieces in order, so text
and masks come from the same place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .agent_text import fenced_tool_calls, tool_calls
from .search import bound

#: A message: calls have names and arguments as JSON text. The fields that a source lacks are null.
MESSAGE = "struct<role:string,content:string,reasoning:string,calls:array<struct<name:string,arguments:string>>>"


@dataclass(frozen=True)
class Piece:
    """A literal with fields in braces, there if all the conditions hold (names of fields that say something; with ! nothing; keep: reasoning is kept)."""

    text: str
    when: tuple[str, ...] = ()
    trained: bool = False


@dataclass(frozen=True)
class Family:
    begin: str
    default_system: str | None
    roles: dict[str, tuple[Piece, ...]]
    open_turn: str
    ends: tuple[str, ...]  # what closes a completion
    call: str  # of one call
    calls: str  # round all calls
    fenced: bool = False  # calls are read in fenced form
    always_thinks: bool = False


def _assistant(head: str, *pieces: tuple[str, tuple[str, ...]], end: str) -> tuple[Piece, ...]:
    return (Piece(head), *(Piece(t, w, True) for t, w in pieces), Piece(end, (), True))


#: The marks of the families.
_IM, _END = "<|im_start|>", "<|im_end|>\n"
_U, _A, _EOS, _BOS = "<｜User｜>", "<｜Assistant｜>", "<｜end▁of▁sentence｜>", "<｜begin▁of▁sentence｜>"
_CALLS, _CALLED, _CALL, _SEP, _DONE = "<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>", "<｜tool▁call▁begin｜>", "<｜tool▁sep｜>", "<｜tool▁call▁end｜>"
_HEAD, _EOT = "<|start_header_id|>%s<|end_header_id|>\n\n", "<|eot_id|>"

FAMILIES = {
    "chatml": Family(
        begin="", default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.",
        roles={
            "system": (Piece(f"{_IM}system\n{{content}}{_END}"),),
            "user": (Piece(f"{_IM}user\n{{content}}{_END}"),),
            "tool": (Piece(f"{_IM}user\n<tool_response>\n{{content}}\n</tool_response>{_END}"),),
            "assistant": _assistant(f"{_IM}assistant\n", ("<think>\n{reasoning}", ("keep", "reasoning")), ("\n</think>\n\n", ("keep", "reasoning", "content")), ("{content}", ("content",)), ("\n", ("content", "calls")), ("{calls}", ("calls",)), end=_END),
        },
        open_turn=f"{_IM}assistant\n", ends=("<|endoftext|>", "<|im_end|>"), call='<tool_call>\n{"name": {name}, "arguments": {arguments}}\n</tool_call>', calls="{calls}",
    ),
    "r1": Family(
        begin=_BOS, default_system=None,
        roles={
            "system": (Piece("{content}"),),
            "user": (Piece(_U + "{content}"),),
            "tool": (Piece(_U + "<｜tool▁output▁begin｜>\n{content}\n<｜tool▁output▁end｜>"),),
            "assistant": _assistant(_A, ("<think>\n{reasoning}", ("keep",)), ("\n</think>\n\n", ("keep", "reasoning", "content")), ("{content}", ("content",)), ("\n", ("keep", "reasoning", "content", "calls")), ("{calls}", ("keep", "reasoning", "calls")), end=_EOS),
        },
        open_turn=f"{_A}<think>\n", ends=(_EOS,), call=f"{_CALL}function{_SEP}{{plain_name}}\n```json\n{{arguments}}\n```\n{_DONE}", calls=f"{_CALLS}\n{{calls}}\n{_CALLED}", fenced=True, always_thinks=True,
    ),
    "llama": Family(
        begin="<|begin_of_text|>", default_system=None,
        roles={
            "system": (Piece(_HEAD % "system" + "{content}" + _EOT),),
            "user": (Piece(_HEAD % "user" + "{content}" + _EOT),),
            "tool": (Piece(_HEAD % "user" + _HEAD % "tool_response" + "{content}" + _EOT + _EOT),),
            "assistant": _assistant(_HEAD % "assistant", ("{raw}", ()), end=_EOT),
        },
        open_turn=_HEAD % "assistant", ends=(_EOT,), call="", calls="",
    ),
    "v3": Family(
        begin=_BOS, default_system=None,
        roles={
            "system": (Piece("{content}"),),
            "user": (Piece(_U + "{content}"),),
            "assistant": _assistant(_A, ("<think>{reasoning}", ("keep", "reasoning")), ("</think>{raw}", ("content",)), end=_EOS),
        },
        open_turn=f"{_A}<think>", ends=(_EOS,), call="", calls="",
    ),
}
_FIELD = re.compile(r"\{(content|reasoning|calls|raw|plain_name|name|arguments)\}")


def _filled(text: str, fields: dict[str, Column]) -> Column:
    parts = _FIELD.split(text)
    return F.concat(*(fields[p] if k % 2 else F.lit(p) for k, p in enumerate(parts) if p or k % 2))


def _message(family: Family, m: Column, keep: bool) -> Column:
    empty = F.array().cast("array<struct<text:string,trained:boolean>>")
    calls = F.coalesce(m["calls"], F.array().cast("array<struct<name:string,arguments:string>>"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c["name"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    each = F.transform(calls, lambda c: _filled(family.call, {"name": quoted(c), "plain_name": c["name"], "arguments": F.coalesce(c["arguments"], F.lit("null"))})) if family.call else F.transform(calls, lambda c: F.lit(""))
    raw = F.coalesce(m["content"], F.lit(""))
    trim = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n"))
    fields = {"content": F.when(m["role"] == "assistant", trim(raw)).otherwise(raw), "reasoning": trim(m["reasoning"]), "raw": raw}
    fields["calls"] = _filled(family.calls, {"calls": F.array_join(each, "\n")}) if family.calls else F.lit("")
    says = {"content": fields["content"] != "", "reasoning": fields["reasoning"] != "", "calls": F.size(calls) > 0, "keep": F.lit(keep)}

    def piece(p: Piece) -> Column:
        holds = F.lit(True)
        for name in p.when:
            holds = holds & (~says[name[1:]] if name[0] == "!" else says[name])
        return F.when(holds, F.array(F.struct(_filled(p.text, fields).alias("text"), F.lit(p.trained).alias("trained")))).otherwise(empty)

    out = F.raise_error(F.concat(F.lit("no such role: "), F.coalesce(m["role"], F.lit("null")))).cast(empty_type())
    for role, pieces in family.roles.items():
        out = F.when(m["role"] == role, F.concat(*map(piece, pieces))).otherwise(out)
    return out


def empty_type() -> str:
    return "array<struct<text:string,trained:boolean>>"


def as_messages(messages: Column, fields: tuple[str, ...] = ("role", "content")) -> Column:
    """Messages with the fields of MESSAGE, null where the source has none of that name."""
    kinds = {"role": "string", "content": "string", "reasoning": "string", "calls": "array<struct<name:string,arguments:string>>"}
    return F.transform(messages, lambda m: F.struct(*((m[f] if f in fields else F.lit(None)).cast(k).alias(f) for f, k in kinds.items())))


def pieces(messages: Column, family: str, keep_reasoning: bool = False, first: bool = True, open_turn: bool = False, system: str | None = None) -> Column:
    """array<struct<text, trained>> of messages (as MESSAGE); null has none. ``first``: the chat begins here, so the family's begin and, without a
    system message, its default one come first; ``open_turn``: an assistant's turn is left open at the end. An unknown role is an error."""
    f = FAMILIES[family]
    body = F.flatten(F.transform(messages, lambda m: _message(f, m, keep_reasoning)))
    literal = lambda text: F.array(F.struct(F.lit(text).alias("text"), F.lit(False).alias("trained")))
    parts = [body]
    default = f.default_system if system is None else system
    if first and default is not None:
        head = _filled(f.roles["system"][0].text, {"content": F.lit(default)})
        has = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
        parts.insert(0, F.when(has, F.array().cast(empty_type())).otherwise(F.array(F.struct(head.alias("text"), F.lit(False).alias("trained")))))
    if first and f.begin:
        parts.insert(0, literal(f.begin))
    if open_turn:
        parts.append(literal(f.open_turn))
    return F.when(messages.isNotNull(), F.concat(*parts))


def rendered(parts: Column) -> Column:
    """The text of pieces."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def trained_spans(parts: Column) -> Column:
    """array<struct<start, length>> of what is trained on, in characters; pieces that touch are one span."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(s: Column, p: Column) -> Column:
        n, last = F.char_length(p["text"]), F.try_element_at(s["spans"], F.lit(-1))
        new = F.struct(s["at"].alias("start"), n.alias("length"))
        joined = F.concat(F.slice(s["spans"], F.lit(1), F.size(s["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), (last["length"] + n).alias("length"))))
        touches = F.coalesce(last["start"] + last["length"] == s["at"], F.lit(False))
        spans = F.when(~p["trained"] | (n == 0), s["spans"]).when(touches, joined).otherwise(F.concat(s["spans"], F.array(new)))
        return F.struct((s["at"] + n).alias("at"), spans.alias("spans"))

    return F.aggregate(parts, start, add, lambda s: s["spans"])


def completed(text: Column, family: str, thinks: bool = True) -> Column:
    """struct(reasoning, content, tool_calls) of a completion. With exactly one end of thinking it parts there; else all is reasoning
    that was cut short, or, where the model doesn't think, content. Calls are read from the content and taken out of it."""
    f = FAMILIES[family]
    ends = "(?:" + "|".join(map(re.escape, f.ends)) + r")\s*$"
    trim = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    halves = F.split(text, "</think>")
    one = F.size(halves) == 2
    cleaned = lambda c: trim(F.regexp_replace(F.regexp_replace(c, ends, ""), ends, ""))
    head = trim(F.regexp_replace(F.when(one, halves[0]).otherwise(text), r"^\s*<think>", ""))
    cut = thinks or f.always_thinks
    content = F.when(one, cleaned(F.get(halves, F.lit(1)))).otherwise(F.lit("") if cut else cleaned(text))
    reasoning = F.when(one, head).otherwise(head if cut else F.lit(""))
    marks = rf"(?s){re.escape(_CALL)}.*?{re.escape(_DONE)}|{re.escape(_CALLS)}|{re.escape(_CALLED)}" if f.fenced else r"(?s)<tool_call>.*?</tool_call>"
    calls = (lambda c: fenced_tool_calls(c, _CALL, _SEP, _DONE)) if f.fenced else tool_calls
    return bound(content, lambda c: F.struct(reasoning.alias("reasoning"), trim(F.regexp_replace(c, marks, "")).alias("content"), calls(c).alias("tool_calls")))
