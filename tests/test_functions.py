import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import agent_text as at
from tessera.functions import algebra as al
from tessera.functions import answers as an
from tessera.functions import normalise as nm
from tessera.functions import search as se
from tessera.operators import callgraph as cg
from tessera.operators import curation as cu
from tessera.operators import fault_traces as ft
from tessera.operators import grading as gr


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)] if values else [Row(x=1)]).select(column.alias("v")).first().v


def test_boxes_and_answers():
    assert an.boxed(r"a \boxed{1} then \boxed{\frac{1}{2}} end") == r"\frac{1}{2}"
    assert an.boxed(r"\boxed{open") is None and an.boxed("none") is None and an.boxed(None) is None and an.boxed(r"\fbox{3}") == "3"
    for a, b in ((r"\frac{1}{2}", "0.5"), ("1,000", "1000"), (r"\dfrac12", "1/2"), ("(1, 2)", "(1,2)"), (r"50\%", "50"), (r"\text{cm}5", "cm5"), ("2x+x", "3x"), (r"\sqrt{12}", r"2\sqrt{3}"), ("(x+1)^2", "x^2+2x+1"), (r"(\frac{\sqrt{2}}{2}, 1)", r"(1/\sqrt{2},1)"), ("2.0", "2"), ("x^{2}", "x*x")):
        assert an.same_answer(a, b), (a, b)
    for a, b in (("1/2", "0.51"), ("(1,2)", "(2,1)"), ("x", "y"), ("[1,2)", "(1,2)"), ("", ""), ("2", "4/2"), ("8", "2^3"), ("1/2", "2/4"), ("x+y+z", "z+y+x"), ("x^12", "x^6x^6"), ("2", "3"), ("2x", "2y")):
        assert not an.same_answer(a, b), (a, b)
    assert an.exact_value("__import__('os')") is None and an.exact_value("1/0") is None


def test_rational_functions_with_roots():
    same = ["2x+x = 3x", "(x+1)^2 = x^2+2x+1", "1/sqrt(2) = sqrt(2)/2", "(x^2-1)/(x-1) = x+1", "sqrt(6) = sqrt(2)*sqrt(3)", "sqrt(x+1)^2 = x+1", "sqrt(4x+4) = 2sqrt(x+1)"]
    same += ["1/(sqrt(3)-sqrt(2)) = sqrt(3)+sqrt(2)", "pi r^2 = r r pi", "x^(1/2) = sqrt(x)", "2sin(x+x) = 2sin(2x)", r"\sqrt[3]{16} = 2\sqrt[3]{2}", "a/b+b/a = (a^2+b^2)/(ab)"]
    same += ["sqrt(x/y) = sqrt(xy)/y", "(1+sqrt(5))/2*(1-sqrt(5))/2 = -1", "8^(2/3) = 4", "0 = x-x", "2^(-1) = 1/2", "sqrt(2+4x) = sqrt(2)sqrt(1+2x)", "sqrt(-4)^2 = -4", "sqrt(-x)^2 = -x"]
    for line in same:
        assert al.same_function(*line.split(" = ")) is True, line
    for line in ("2x = 3x", "sqrt(2) = 1.41421356", "x+y = x-y", "1/x = x", "sin(x) = cos(x)", "sqrt(3) = sqrt(2)+1", "sqrt(-4) = 2"):
        assert al.same_function(*line.split(" = ")) is False, line
    for odd in ("1/0", "x=3", "a,b", "__import__('os')", "2^x", "(1+x)^99", "[1]", "", ")(", "(" * 3000):
        assert al.same_function(odd, "1") is None, odd


def test_written_forms_of_answers():
    right = [("\\boxed{1\\,234 \\text{ meters}}", "1234"), ("\\boxed{50\\%}", "50"), ("\\boxed{x = 3}", "3"), ("\\boxed{1\\frac{1}{2}}", "1.5"), ("\\boxed{3 1/2}", "3.5"), ("\\boxed{2 million}", "2*10^6"), ("\\boxed{3 and 4}", "3,4")]
    right += [("\\boxed{0.5}", "\\frac12"), ("\\boxed{(1, 2]}", "(1,2]"), ("\\boxed{\\sqrt3}", "\\sqrt{3}"), ("\\boxed{.5}", "0.50"), ("<|begin_of_box|>7<|end_of_box|> \\boxed{8}", "7"), ("<think>\\boxed{1}</think> \\boxed{2}", "2"), ("\\boxed{30^\\circ}", "30 degrees")]
    wrong = [("\\boxed{\\frac{2}{4}}", "\\frac{1}{2}"), ("\\boxed{(1, 2)}", "(1,2]"), ("no box 5", "5"), ("\\boxed{" + "1+" * 150 + "1}", "151"), ("\\boxed{2 million}", "2000000")]
    for pairs, worth in ((right, 1), (wrong, 0)):
        for action, truth in pairs:
            assert an.math_reward_one(action, [truth], False) == worth, action


def test_kinds_of_math_rewards(spark):
    worth = an.MathRewards(correct=2, wrong=-1, no_form=-2, no_truth=-3, needs_thought=True)
    cases = [(r"</think>\boxed{2x+x}", ["9", "3x"], 2), (r"\boxed{3x}", ["3x"], -2), ("</think>3x", ["3x"], -2), (r"</think>\boxed{3}", ["4"], -1), (r"</think>\boxed{3}", None, -3), (None, ["4"], -2), (r"</think>\boxed{3}", [r"\boxed{"], -3)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, action string, truths array<string>, want int")
    got = df.select("k", "want", an.math_reward(F.col("action"), F.col("truths"), F.lit(True), worth).alias("r"), an.math_kind(F.col("action"), F.col("truths"), worth).alias("kind")).collect()
    assert all(r.r == r.want + (0.5 if r.want == 2 else 0) for r in got)
    assert [r.kind for r in sorted(got)] == ["correct", "no_form", "no_form", "wrong", "no_truth", "no_form", "no_truth"]
    assert one(spark, an.extract_boxed(F.lit(r"a \boxed{1} <|begin_of_box|> 2 <|end_of_box|>"))) == "2"


def test_answers_are_compared_once_a_pair(spark):
    df = spark.createDataFrame([(1, "2x+x", "3x"), (1, "2x+x", "3x"), (1, "4", "3x"), (2, None, "1"), (2, "1", None), (2, "4/2", "2")], "task int, a string, b string")
    assert sorted((r.task, str(r.a), r.is_correct) for r in gr.graded_answers(df, "a", "b").collect()) == [(1, "2x+x", True), (1, "2x+x", True), (1, "4", False), (2, "1", None), (2, "4/2", False), (2, "None", None)]
    assert {(r.task, r.a, round(r.share, 3)) for r in gr.agreed_answers(df, ["task"], "a").collect()} == {(1, "2x+x", 0.667), (2, "1", 0.5)}


def test_rewards():
    assert an.math_reward_one(r"<think>\boxed{2}</think>\boxed{3}", ["3"], False) == 1
    assert an.math_reward_one(r"\boxed{3}", ["2", "3"], True) == 1.5
    assert an.math_reward_one(r"\boxed{3}", [r"so \boxed{3}"], False) == 1
    for action, truths in ((None, ["3"]), ("", ["3"]), (r"\boxed{3}", []), ("3", ["3"])):
        assert an.math_reward_one(action, truths, False) == 0
    assert an.countdown_one("<answer>1</answer><answer>(3 + 5) * 2 = 16</answer>", [2, 3, 5], 16) == 1
    assert an.countdown_one("<answer>3 * 5 + 1</answer>", [2, 3, 5], 16) == 0
    assert an.same_stdout_one("1 2.0\nx\n", "1.0 2\nx") and not an.same_stdout_one("1\n2", "1") and not an.same_stdout_one("a", "b")


def test_overlap(spark):
    f = lambda a, b: one(spark, nm.token_f1(F.lit(a), F.lit(b)))
    assert f("The cat sat", "a cat") == 2 * 1 / 3 and f("yes", "no") == 0 and f("yes", "Yes!") == 1 and f("", "") == 0
    assert abs(f("x x y", "x z") - 0.4) < 1e-9
    assert one(spark, nm.is_test_path(F.lit("a\\testing\\b.py"))) and not one(spark, nm.is_test_path(F.lit("contest/latest.py")))
    assert one(spark, nm.middle_cut(F.lit("a b c d e"), 1)) == "a ... e"


def test_tool_calls(spark):
    text = '<tool_call>{"name":"f","arguments":{"a":1}}</tool_call><tool_call>bad</tool_call><tool_call>{"name":"g","arguments":{}}</tool_call><tool_call>{"name":"h"'
    assert [c.name for c in one(spark, at.tool_calls(F.lit(text)))] == ["f", "g"]
    assert one(spark, at.tool_calls(F.lit("plain"))) == []
    fenced = "<tool_call_begin>function<tool_sep>f\n```json\n{\"a\": 1}\n```<tool_call_end><tool_call_begin>other<tool_sep>g\n```json\n{}\n```<tool_call_end>"
    assert [c.name for c in one(spark, at.fenced_tool_calls(F.lit(fenced)))] == ["f"]


def test_test_logs(spark):
    log = "PASSED a::b\n==== short test summary info ====\nPASSED t.py::C::m\nFAILED t.py::x[1] - assert 0\nERROR t.py::y\nFAILED t.py::C::m\n"
    m = one(spark, at.test_statuses(F.lit(log)))
    assert m == {"C.m": "FAILED", "x[1]": "FAILED", "y": "ERROR"}
    assert one(spark, at.test_statuses(F.lit("no summary"))) is None
    assert one(spark, at.bare_test_name(F.lit("a/t.py::C::m[x-1]"))) == "m"


def test_reads(spark):
    got = one(spark, at.shell_reads(F.lit("cat a.py; head -n 20 b.py; head c.py; sed -n '3,9p' d.py; grep -n foo e.py; tail -5 f.py; cat g.txt; cat a.py")))
    assert [(r.file_path, r.start_line, r.end_line) for r in got] == [("a.py", 1, at.WHOLE), ("b.py", 1, 20), ("c.py", 1, 50), ("f.py", 1, at.WHOLE), ("d.py", 3, 9), ("e.py", 1, at.WHOLE)]


def test_completions(spark):
    v = one(spark, at.completion(F.lit("<think>why</think> do it<|im_end|>")))
    assert (v.reasoning, v.content) == ("why", "do it")
    assert one(spark, at.completion(F.lit("only"))).reasoning == "only" and one(spark, at.completion(F.lit("only"), thinking=False)).content == "only"


def test_callables():
    code = "@dec\ndef f():\n    def g():\n        return 1\n    return g\n\n\nclass A:\n    class B:\n        def m(self):\n            pass\n"
    got = {c[1]: c[2:] for c in cg.callables_of(code)}
    assert set(got) == {"f", "f.<locals>.g", "A.B.m"} and got["f"][:3] == (2, 5, 1) and "return 1" in got["f"][3] and "return 1" not in got["f"][4]
    assert list(cg.callables_of("def (")) == [] and list(cg.callables_of(None)) == []


def test_frames_and_modified(spark):
    log = 'File "/testbed/src/a.py", line 3, in f\n x\nFile "/usr/lib/site-packages/z.py", line 1, in z\nFile "/testbed/b.py", line 9, in g'
    assert [(f.file_path, f.func_name, f.line_no) for f in one(spark, cg.text_frames(F.lit(log)))] == [("src/a.py", "f", 3), ("b.py", "g", 9)]
    old = cg.callables(spark.createDataFrame([("a.py", "def f():\n    return 1\ndef g():\n    pass\n")], "p string, s string"), ["p"], "s")
    new = cg.callables(spark.createDataFrame([("a.py", "def f():\n    return 2\ndef h():\n    pass\n")], "p string, s string"), ["p"], "s")
    assert [r.qualified_name for r in cg.modified(old, new, ["p"]).collect()] == ["f"]
    added, deleted = cg.added_and_deleted(old, new, ["p"])
    assert [r.qualified_name for r in added.collect()] == ["h"] and [r.qualified_name for r in deleted.collect()] == ["g"]
    t = spark.createDataFrame([(1, [("tests/t.py", "T.test_a[1]")]), (2, [("src/t.py", "test_a")])], "i int, frames array<struct<file_path:string,func_name:string>>")
    assert [r.i for r in cg.observed_tests(t, "frames", F.array(F.lit("test_a"))).collect()] == [1]
    assert cg.observed_tests(t, "frames", F.array().cast("array<string>"), ft.FIXTURES).count() == 0
    fixed = spark.createDataFrame([(1, [("tests/t.py", "T.setUp")]), (2, [("src/t.py", "setUp")]), (3, [("tests/t.py", "T.other")])], t.schema)
    assert [r.i for r in cg.observed_tests(fixed, "frames", F.array(F.lit("test_a")), ft.FIXTURES).collect()] == [1]


def test_marker_blocks_and_json_lines_give_one_table(spark):
    log = """noise
<<<FAULT_TRACE_BEGIN:f:a.py:3>>>
/testbed/tests/test_a.py:7:T.test_x[1]:self.go(1): ok
/testbed/a.py:3:go:raise E
/usr/lib/site-packages/p.py:1:z:z
no frame
/testbed/a.py:x:go:bad line number
<<<FAULT_TRACE_END>>>
/testbed/a.py:4:outside:not in a block
<<<FAULT_TRACE_BEGIN:f:a.py:3>>>
/testbed/a.py:3:given up:since another begins
<<<FAULT_TRACE_BEGIN:f:a.py:3>>>
/testbed/tests/b.py:1:T.setUp:s
  /testbed/b.py:9:h:unpatched
<<<FAULT_TRACE_END>>>
<<<FAULT_TRACE_BEGIN:f:a.py:3>>>
/testbed/a.py:3:never closed:x"""
    lines = [{"frames": [{"file": "/testbed/tests/test_a.py", "line": 7, "name": "T.test_x[1]", "code": "self.go(1): ok"}, {"file": "/testbed/a.py", "line": 3, "name": "go", "code": "raise E"}, {"file": "/x/.venv/q.py", "line": 1, "name": "q", "code": ""}]}]
    lines += [None, {"frames": []}, {"frames": [{"file": "/testbed/tests/b.py", "line": 1, "name": "T.setUp", "code": "s"}, {"file": "/testbed/b.py", "line": 9, "name": "h", "code": "unpatched"}]}]
    text = "\n".join("{bad" if x is None else json.dumps(x) for x in lines)
    logs = spark.createDataFrame([("i", log, text), ("none", None, None)], "inst string, log string, jsonl string")
    plain = lambda df: sorted((r.file_path, r.line_no, r.func_name, r.line_content) for r in df.collect())
    marks, jsons = ft.marker_frames(logs, ["inst"], "log"), ft.json_frames(logs, ["inst"], "jsonl")
    assert plain(marks) == plain(jsons) == [("a.py", 3, "go", "raise E"), ("b.py", 9, "h", "unpatched"), ("tests/b.py", 1, "T.setUp", "s"), ("tests/test_a.py", 7, "T.test_x[1]", "self.go(1): ok")]
    patched = spark.createDataFrame([("i", "a.py", 2, 5, "A.go", 1), ("i", "a.py", 1, 9, "A", 0), ("j", "b.py", 1, 99, "B", 0)], "inst string, file_path string, start_line int, end_line int, qualified_name string, ord int")
    for frames in (marks, jsons):
        for few in (0, 256):
            got = ft.with_patched(frames, ["inst"], patched, few).collect()
            assert sorted((r.func_name, r.qualified_name, r.is_patched) for r in got) == [("T.test_x[1]", "T.test_x[1]", False), ("go", "A", True)]
        wanted = spark.createDataFrame([("i", "test_x"), ("j", "q")], "inst string, t string")
        assert ft.from_wanted_tests(frames, ["inst"], wanted, "t").count() == 4  # one by its test, one by its fixture
        assert ft.from_wanted_tests(frames, ["inst"], wanted.where("inst = 'j'"), "t").count() == 0


def test_editor_views_in_all_forms(spark):
    text = (
        '<function=file_editor> {"command": "view", "path": "/testbed/a.py", "view_range": [3, 9]} </function> <function=file_editor>{"command": "view", "path": "b.py"}</function>'
        '<function=file_editor>{"command": "create", "path": "no.py"}</function><function=file_editor><parameter name="command">view</parameter>\n<parameter name="path">./c.py</parameter><parameter name="view_range">[1, 20]</parameter></function>'
        "<function=file_editor><parameter=command>view</parameter><parameter=path>d.py</parameter></function><function=file_editor><parameter=command>undo</parameter><parameter=path>e.py</parameter></function>"
        '<function=bash><parameter name="command">cat f.py</parameter></function><function=file_editor>{broken</function>'
    )
    got = [(r.file_path, r.start_line, r.end_line) for r in one(spark, at.editor_views(F.lit(text)))]
    assert got == [("a.py", 3, 9), ("b.py", 1, 999999), ("c.py", 1, 20), ("d.py", 1, 999999)]
    assert [(r.file_path, r.start_line, r.end_line) for r in one(spark, at.all_reads(F.lit(text)))] == [*got, ("f.py", 1, 999999)]
    assert one(spark, at.editor_views(F.lit("nothing"))) == []


def test_short_answers(spark):
    cases = [
        ("<think>no</think> It is \\boxed{Paris {x}} now", "Paris {x}"), ("\\boxed{a{b}{c{d}}} and \\boxed{z}", "a{b}{c{d}}"), ("\\boxed{open {x}", None), ("\\boxed{}", ""), ("so **Big Ben** it is", "Big Ben"),
        ("*no* then *yes sir*", "yes sir"), ("born on March 3, 1999 there", "March 3, 1999"), ("in june 2001", "june 2001"), ("on 3/4/2001 in 1999", "3/4/2001"), ("late 1999", "1999"), ("we met Ada Lovelace in town", "Ada Lovelace"),
        ("from New York to Éva Nagy", "Éva Nagy"), ("about 1,200 people came with 7 dogs", "1,200"), ("7 dogs", "7"), ("30% of 5", "30"), ("the answer is: green tea leaves.", "green tea leaves"), ("so, we like it (a lot)!", "we like it (a lot"),
        ("a b c. this was mine too. ok", "this was mine too"), ("meh ok", "meh ok"), ("", ""), (None, ""), ("  \n ", ""), ("x" * 3, "xxx"), ("<think>a\nb</think>  red \n\t tea", "red tea"),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(cases)], "k int, r string")
    got = {x.k: x.a for x in df.select("k", se.short_answer(F.col("r")).alias("a")).collect()}
    for k, (r, a) in enumerate(cases):
        assert a is None or got[k] == a, (r, got[k])


def test_failed_tests_by_kind_of_value(spark):
    cases = [
        ('["a", "b::c", 3]', ["a", "b::c", "3"]), ('{"t1": "FAILED", "t2": "PASSED", "t3": "error", "t4": null}', ["t1", "t3"]), ("ok\nFAILED x::y - why\n ERROR z\nFAILED", ["x::y", "z"]), (" test_a ", ["test_a"]), ("m::n", ["m::n"]),
        ("nothing here", []), ('{"tests": [], "f2p_tests": ["q"]}', ["q"]), ('{"FAIL_TO_PASS": "[\\"p\\"]", "tests": ["z"]}', ["p"]), ('{"tests": {"tests": {"u": "fail"}}}', ["u"]), ('"test_quoted"', ["test_quoted"]), ("[broken", []), ("{broken", []),
        ("{}", []), ("[]", []), ("", []), (None, []), ('{"tests": "FAILED k"}', ["k"]), ("7", []),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(cases)], "k int, r string")
    got = {x.k: x.a for x in df.select("k", cu.failed_tests(F.col("r")).alias("a")).collect()}
    for k, (r, a) in enumerate(cases):
        assert got[k] == a, (r, got[k])
