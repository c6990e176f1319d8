"""What agents write and read: tool calls, actions, chats, test logs, file reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .search import bound

#: The end of a file whose length is not known.
WHOLE = 999_999


def tool_calls(text: Column) -> Column:
    """Names and arguments (JSON) of calls between tool_call tags; bad JSON and an open last tag are skipped."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.transform(raw, lambda x: F.try_parse_json(F.btrim(x, F.lit(" \n\t\r"))))
    named = F.transform(calls, lambda v: F.struct(F.try_variant_get(v, "$.name", "string").alias("name"), F.to_json(F.try_variant_get(v, "$.arguments", "variant")).alias("arguments")))
    return F.filter(named, lambda c: c["name"].isNotNull())


def fenced_tool_calls(text: Column, begin: str = "<tool_call_begin>", sep: str = "<tool_sep>", end: str = "<tool_call_end>") -> Column:
    """Calls that give a function name and then a json block, between these marks."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s){begin}function{sep}(.*?){end}"), F.lit(1))
    return F.filter(
        F.transform(blocks, lambda b: F.struct(F.btrim(F.regexp_extract(b, r"^([^\n]*)\n", 1)).alias("name"), F.nullif(F.regexp_extract(b, r"(?s)```json\n(.*?)\n?```", 1), F.lit("")).alias("arguments"))),
        lambda c: (c["name"] != "") & F.try_parse_json(c["arguments"]).isNotNull(),
    )


def xml_action(text: Column) -> Column:
    """The first function and its parameters; of equal names the last holds."""
    body = F.regexp_extract(text, r"(?s)<function=[^>]+>(.*?)(?:</function>|$)", 1)
    pairs = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?s)(<parameter=[^>]+>.*?</parameter>)"), F.lit(1)),
        lambda p: F.struct(F.regexp_extract(p, "<parameter=([^>]+)>", 1).alias("key"), F.btrim(F.regexp_extract(p, r"(?s)<parameter=[^>]+>(.*?)</parameter>", 1), F.lit("\n ")).alias("value")),
    )
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]).alias("again"))), lambda p: ~p["again"])
    return F.struct(F.regexp_extract(text, "<function=([^>]+)>", 1).alias("function"), F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))).alias("parameters"))


def shell_quoted(s: Column) -> Column:
    return F.when(s.rlike(r"^[\w@%+=:,./-]+$"), s).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def shell_command(function: Column, parameters: Column) -> Column:
    """name, its command, then the other parameters as quoted options; finishing is an echo."""
    options = F.transform(F.array_sort(F.map_entries(F.map_filter(parameters, lambda k, v: k != "command"))), lambda e: F.concat(F.lit("--"), e["key"], F.lit(" "), shell_quoted(e["value"])))
    return F.when(function.isin("finish", "submit"), F.lit("echo '<<<Finished>>>'")).otherwise(F.concat_ws(" ", function, F.try_element_at(parameters, F.lit("command")), options))


def chat_text(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>", system: str | None = None, open_turn: bool = False) -> Column:
    """Role-tagged text of messages; a default system message comes first where there is none."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end + "\n"))), "")
    if system is not None:
        body = F.concat(F.when(F.coalesce(F.get(messages, F.lit(0))["role"] != "system", F.lit(True)), F.lit(f"{start}system\n{system}{end}\n")).otherwise(F.lit("")), body)
    return F.concat(body, F.lit(f"{start}assistant\n")) if open_turn else body


def think_and_rest(text: Column, tool_tag: str = "<function=") -> Column:
    """Reasoning and what follows: by think tags, else before the tool tag."""
    tail = F.substring_index(text, "</think>", -1)
    head = F.regexp_replace(F.substring_index(text, "</think>", 1), "^<think>", "")
    at = F.instr(text, F.lit(tool_tag))
    return F.when(text.contains("</think>"), F.struct(F.btrim(head, F.lit("\n ")).alias("thought"), F.btrim(tail, F.lit("\n ")).alias("action"))).when(
        at > 0, F.struct(F.btrim(F.left(text, at - 1), F.lit("\n ")).alias("thought"), F.substring(text, at, F.length(text)).alias("action"))
    ).otherwise(F.struct(F.lit("").alias("thought"), text.alias("action")))


def completion(text: Column, end_tag: str = "<|im_end|>", thinking: bool = True) -> Column:
    """reasoning and content of a completion: both with exactly one end of thinking, else all is reasoning (content if thinking is off)."""
    t = F.replace(text, F.lit(end_tag), F.lit(""))
    parts = F.split(t, "</think>")
    whole = F.struct(F.btrim(t).alias("reasoning"), F.lit("").alias("content")) if thinking else F.struct(F.lit("").alias("reasoning"), F.btrim(t).alias("content"))
    return F.when(F.size(parts) == 2, F.struct(F.btrim(F.regexp_replace(parts[0], "^\\s*<think>", "")).alias("reasoning"), F.btrim(parts[1]).alias("content"))).otherwise(whole)


def test_statuses(log: Column) -> Column:
    """Test name -> status from the short summary of a pytest log."""
    clean = F.regexp_replace(log, "\\x1b\\[[0-9;]*m", "")
    tail = F.when(clean.contains("short test summary info"), F.substring(clean, F.instr(clean, F.lit("short test summary info")) + 23, F.length(clean)))
    status = lambda x: F.when(x.contains("PASSED"), "PASSED").when(x.contains("FAILED"), "FAILED").when(x.contains("ERROR"), "ERROR")
    lines = F.filter(F.split(tail, "\n"), lambda x: status(x).isNotNull() & x.contains("::"))
    name = lambda x: F.concat_ws(".", F.slice(F.split(F.element_at(F.split(F.btrim(x), " - "), 1), "::"), F.lit(2), F.size(F.split(x, "::"))))
    entries = F.transform(lines, lambda x, i: F.struct(name(x).alias("key"), (-i).alias("back"), status(x).alias("value")))
    # sorted by name, the last of a log first; a name's first entry is the one whose neighbour has another name
    last = bound(F.array_sort(entries), lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["key"] != e["key"], F.lit(True))))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def same_statuses(got: Column, want: Column) -> Column:
    """As many tests, and the same status for each; an empty name is skipped."""
    a, b = (F.map_filter(m, lambda k, v: k != "") for m in (got, want))
    return (F.size(got) == F.size(want)) & F.forall(F.map_entries(b), lambda e: F.coalesce(F.try_element_at(a, e["key"]) == e["value"], F.lit(False)))


def resolved(statuses: Column, fail_to_pass: Column, pass_to_pass: Column) -> Column:
    return F.forall(F.concat(fail_to_pass, pass_to_pass), lambda t: F.coalesce(F.try_element_at(statuses, t) == "PASSED", F.lit(False)))


def bare_test_name(test: Column) -> Column:
    """What follows the last ::, without parameters."""
    return F.regexp_replace(F.element_at(F.split(test, "::"), -1), r"\[.*\]$", "")


def _read(path: Column, start: Column, end: Column) -> Column:
    return F.struct(path.alias("file_path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def viewed_ranges(text: Column) -> Column:
    """Files an editor's view command shows, with line ranges; the whole file without one."""
    calls = F.regexp_extract_all(text, F.lit(r"(view\s+\S+\.py(?:\s+--view_range\s+\[?\d+[ ,]+\d+\]?)?)"), F.lit(1))
    return F.transform(calls, lambda c: _read(F.regexp_extract(c, r"view\s+(\S+)", 1), F.coalesce(F.nullif(F.regexp_extract(c, r"\[?(\d+)[ ,]+\d+\]?$", 1), F.lit("")), F.lit("1")), F.coalesce(F.nullif(F.regexp_extract(c, r"\[?\d+[ ,]+(\d+)\]?$", 1), F.lit("")), F.lit(str(WHOLE)))))


def editor_views(text: Column) -> Column:
    """Views that an editor tool is asked for, as JSON or as parameters (name="path" or =path), with their ranges.

    A call reaches to the next one; one whose command isn't view, or without a path, is left out.
    """
    from .normalise import sandbox_path

    calls = F.filter(F.split(text, "<function="), lambda c: F.startswith(c, F.lit("file_editor>")))

    def field(c: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(c, rf'<parameter(?: name="{name}"|={name})>([^<]*)</parameter>', 1), F.lit(""))

    def asked(c: Column) -> Column:
        body = F.from_json(F.regexp_extract(c, r"(?s)^file_editor>\s*(\{.*\})", 1), "struct<command:string,path:string,view_range:array<int>>")
        numbers = F.transform(F.regexp_extract_all(field(c, "view_range"), F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))
        both = F.struct(F.coalesce(body["command"], field(c, "command")).alias("command"), sandbox_path(F.btrim(F.coalesce(body["path"], field(c, "path")))).alias("path"), F.coalesce(body["view_range"], numbers).alias("lines"))

        def read(x: Column) -> Column:
            whole = F.coalesce(F.size(x["lines"]), F.lit(0)) != 2
            return F.struct(x["command"].alias("command"), _read(x["path"], F.when(whole, 1).otherwise(F.try_element_at(x["lines"], F.lit(1))), F.when(whole, WHOLE).otherwise(F.try_element_at(x["lines"], F.lit(2)))).alias("read"))

        return bound(both, read)

    wanted = F.filter(F.transform(calls, asked), lambda x: (x["command"] == "view") & x["read"]["file_path"].isNotNull())
    return F.transform(wanted, lambda x: x["read"])


def all_reads(text: Column) -> Column:
    """What an agent's text shows it of files, by their paths in the repository: editor views in all their forms, and shell commands."""
    from .normalise import sandbox_path

    found = F.concat(editor_views(text), viewed_ranges(text), shell_reads(text))
    return F.array_distinct(F.transform(found, lambda r: _read(sandbox_path(r["file_path"]), r["start_line"], r["end_line"])))


def shell_reads(text: Column) -> Column:
    """Python files that cat, head, tail, sed and grep read; head without a number shows 50 lines."""

    def each(pattern: str, make) -> Column:  # noqa: ANN001
        return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), make)

    path = lambda c: F.regexp_extract(c, r"(\S+\.py)\b", 1)
    cat = each(r"\bcat\s+(?:-n\s+)?\S+\.py\b", lambda c: _read(path(c), F.lit(1), F.lit(WHOLE)))
    tail = each(r"\btail\s+(?:-n\s*\d+\s+|-\d+\s+)?\S+\.py\b", lambda c: _read(path(c), F.lit(1), F.lit(WHOLE)))
    grep = each(r"\bgrep\s+(?:-\w+\s+)*\S+\s+\S+\.py\b", lambda c: _read(F.regexp_extract(c, r"(\S+\.py)$", 1), F.lit(1), F.lit(WHOLE)))
    head = each(r"\bhead\s+(?:-n\s*\d+\s+|-\d+\s+)?\S+\.py\b", lambda c: _read(path(c), F.lit(1), F.coalesce(F.nullif(F.regexp_extract(c, r"-n?\s*(\d+)", 1), F.lit("")), F.lit("50"))))
    sed = each(r"\bsed\s+-n\s+'?\d+,\d+p'?\s+\S+\.py\b", lambda c: _read(path(c), F.regexp_extract(c, r"(\d+),\d+p", 1), F.regexp_extract(c, r"\d+,(\d+)p", 1)))
    return F.array_distinct(F.concat(cat, head, tail, sed, grep))


def decorator_change(hunk: Column) -> Column:
    """swap, add, remove, or null: for hunks whose changed lines are decorators only; file headers are no changes."""
    lines = F.filter(F.split(hunk, "\n"), lambda x: x.rlike(r"^(?:\+(?!\+\+ )|-(?!-- ))"))
    deco = F.forall(lines, lambda x: x.rlike(r"^[+-]\s*@"))
    plus, minus = F.exists(lines, lambda x: x.startswith("+")), F.exists(lines, lambda x: x.startswith("-"))
    return F.when((F.size(lines) > 0) & deco, F.when(plus & minus, "swap").when(plus, "add").otherwise("remove"))


def metadata_slug(metadata: Column, prefix: str = "meta") -> Column:
    """URL-safe base64 of the JSON with sorted keys, without padding."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata))))
    return F.concat(F.lit(prefix + "-"), F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/\n\r", "-_"), F.lit("=")))


def slug_metadata(slug: Column, prefix: str = "meta") -> Column:
    body = F.translate(F.regexp_replace(slug, f"^{prefix}-", ""), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.decode(F.unbase64(padded), "utf-8"), "map<string,string>")


def inherited(parent: Column, child: Column) -> Column:
    """Both maps' entries; of equal keys the child's."""
    return F.map_concat(F.map_filter(parent, lambda k, v: ~F.coalesce(F.map_contains_key(child, k), F.lit(False))), child)


def case_type(n_patched: Column, n_new: Column, n_traces: Column, n_on_trace: Column, error: Column) -> Column:
    """First match: what kind of localisation case an instance is."""
    return (
        F.when(error, "error").when((n_patched == 0) & (n_new == 0), "no_callable").when(n_patched == 0, "only_new").when(n_traces == 0, "no_trace")
        .when(n_on_trace == 0, "all_unobserved").when(n_on_trace < n_patched, "partly_observed").when(n_new > 0, "observed_with_new").otherwise("all_pass")
    )
