"""Chats of four families, and completions read back."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import chat

MESSAGES = [
    ("system", "be brief", None, None), ("user", "hi {content}", None, None), ("assistant", " hello ", "think it over", [("f", '{"a":1}'), ('g"x', "{}")]), ("tool", "42", None, None), ("assistant", "done", None, None), ("assistant", None, "only thought", None),
]
U, A, E, B = "<｜User｜>", "<｜Assistant｜>", "<｜end▁of▁sentence｜>", "<｜begin▁of▁sentence｜>"


def rows(spark, messages=MESSAGES):
    return spark.createDataFrame([(messages,)], f"m array<{chat.MESSAGE}>")


def text(spark, family, messages=MESSAGES, **kw):
    return rows(spark, messages).select(chat.rendered(chat.pieces(F.col("m"), family, **kw)).alias("t")).first().t


def turn(role, body):
    return f"<|im_start|>{role}\n{body}<|im_end|>\n"


def test_chatml(spark):
    calls = '<tool_call>\n{"name": "f", "arguments": {"a":1}}\n</tool_call>\n<tool_call>\n{"name": "g\\"x", "arguments": {}}\n</tool_call>'
    head = turn("system", "be brief") + turn("user", "hi {content}")
    tail = turn("user", "<tool_response>\n42\n</tool_response>") + turn("assistant", "done")
    assert text(spark, "chatml") == head + turn("assistant", "hello\n" + calls) + tail + turn("assistant", "")
    kept = text(spark, "chatml", keep_reasoning=True, open_turn=True)
    assert kept == head + turn("assistant", "<think>\nthink it over\n</think>\n\nhello\n" + calls) + tail + turn("assistant", "<think>\nonly thought") + "<|im_start|>assistant\n"
    assert text(spark, "chatml", MESSAGES[1:2], system="s") == turn("system", "s") + turn("user", "hi {content}")
    assert text(spark, "chatml", MESSAGES[1:2], first=False) == turn("user", "hi {content}")
    assert text(spark, "chatml", []) == turn("system", chat.FAMILIES["chatml"].default_system) and text(spark, "chatml", None) is None


def test_other_families(spark):
    assert text(spark, "r1") == f"{B}be brief{U}hi {{content}}{A}hello{E}{U}<｜tool▁output▁begin｜>\n42\n<｜tool▁output▁end｜>{A}done{E}{A}{E}"
    kept = text(spark, "r1", MESSAGES[2:3] + MESSAGES[4:5], keep_reasoning=True, first=False, open_turn=True)
    call = lambda n, a: f"<｜tool▁call▁begin｜>function<｜tool▁sep｜>{n}\n```json\n{a}\n```\n<｜tool▁call▁end｜>"
    calls = f"<｜tool▁calls▁begin｜>\n{call('f', '{\"a\":1}')}\n{call('g\"x', '{}')}\n<｜tool▁calls▁end｜>"
    assert kept == f"{A}<think>\nthink it over\n</think>\n\nhello\n{calls}{E}{A}<think>\ndone{E}{A}<think>\n"
    h = lambda r: f"<|start_header_id|>{r}<|end_header_id|>\n\n"
    assert text(spark, "llama", MESSAGES[1:2] + MESSAGES[3:5]) == f"<|begin_of_text|>{h('user')}hi {{content}}<|eot_id|>{h('user')}{h('tool_response')}42<|eot_id|><|eot_id|>{h('assistant')}done<|eot_id|>"
    assert text(spark, "v3", MESSAGES[:3], keep_reasoning=True) == f"{B}be brief{U}hi {{content}}{A}<think>think it over</think> hello {E}"
    assert text(spark, "v3", MESSAGES[4:], open_turn=True) == f"{B}{A}</think>done{E}{A}{E}{A}<think>"
    for family, bad in (("v3", MESSAGES[3:4]), ("llama", [("judge", "x", None, None)])):
        with pytest.raises(Exception, match="no such role"):
            text(spark, family, bad)


def test_masks_are_what_assistants_say(spark):
    for family in ("chatml", "r1", "llama"):
        r = rows(spark).select(chat.pieces(F.col("m"), family, keep_reasoning=True).alias("p")).select(chat.rendered(F.col("p")).alias("t"), chat.trained_spans(F.col("p")).alias("s"), "p").first()
        assert len(r.s) == 3
        assert "".join(r.t[x.start : x.start + x.length] for x in r.s) == "".join(p.text for p in r.p if p.trained)
        assert all("42" not in r.t[x.start : x.start + x.length] and "brief" not in r.t[x.start : x.start + x.length] for x in r.s)


@pytest.mark.parametrize("family", ["chatml", "r1"])
def test_completions_read_back_what_was_rendered(spark, family):
    turn_ = rows(spark, MESSAGES[2:3]).select(chat.pieces(F.col("m"), family, keep_reasoning=True, first=False).alias("p"))
    out = turn_.select(F.array_join(F.transform(F.filter("p", lambda x: x["trained"]), lambda x: x["text"]), "").alias("t")).select(chat.completed(F.col("t"), family).alias("c")).first().c
    assert (out.reasoning, out.content) == ("think it over", "hello")
    assert [(c.name, c.arguments) for c in out.tool_calls] == [("f", '{"a":1}'), ('g"x', "{}")]


def test_completions_that_were_cut_short(spark):
    cases = [("<think>so far", True, "so far", ""), ("just text<|im_end|>\n", False, "", "just text"), ("a</think>b</think>c", True, "a</think>b</think>c", ""), ("<think>\nx\n</think>\n\n y <|im_end|>", True, "x", "y"), ("</think>", True, "", ""), ("", False, "", "")]
    for t, thinks, reasoning, content in cases:
        c = spark.range(1).select(chat.completed(F.lit(t), "chatml", thinks).alias("c")).first().c
        assert (c.reasoning, c.content, c.tool_calls) == (reasoning, content, []), t
