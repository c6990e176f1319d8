import random
import re

from tessera.llm.line_dedup import MIN_WORDS, _lines, line_dedup, without_repeated_lines

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def near(u, v):
    if min(len(u), len(v)) < 5:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) <= 1
    if len(u) < len(v):
        u, v = v, u
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def brute(rows):
    lines = sorted((i, k, W.findall(x)) for i, t, _ in rows for k, x in enumerate((t or "").split("\n")) if W.search(x))
    out = {i: (0, []) for i, _, _ in rows}
    for p, (i, k, w) in enumerate(lines):
        gone = any(w == x or near(w, x) for _, _, x in lines[:p])
        out[i] = (out[i][0] + 1, out[i][1] + [k] * gone)
    return out


def make(seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 9, 12, 25]))] for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p, kind = rng.randrange(len(w)), rng.random()
                if kind < 0.4:
                    w[p] = f"x{rng.randrange(9)}"
                elif kind < 0.7:
                    w.insert(p, "ins")
                else:
                    del w[p]
            lines.append(rng.choice(["", " "]) + "  ".join(w) if rng.random() < 0.2 else " ".join(w))
        rows.append(((i * 13) % 97, "\n".join(lines), "s"))
    return [*rows, (1000, None, "s"), (1001, "", "s"), (1002, "\n \n", "s"), (1003, " ".join(["the"] * 3000), "s"), (1004, " ".join(["the"] * 2999), "s")]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed)
        got = {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
        want = brute(rows)
        assert got == want, {i: (got.get(i), want[i]) for i in want if got.get(i) != want[i]}


def test_cut_texts_keep_other_columns(spark):
    rows = make(3)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "line")
    out = {r.doc_id: r for r in without_repeated_lines(df).collect()}
    want = brute(rows)
    for i, t, s in rows:
        kept = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i][1])
        assert out[i].text == kept and out[i].line == s


def test_empty(empty):
    assert line_dedup(empty).count() == 0


def test_a_line_is_cut_into_words_once(spark):
    rows = [(1, "a b\tc  d\r\n\x0b\x0c\n \t\r\n\ne", "s"), (2, "a b c d\na\x0bb\x0cc\td\n\x0be", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = _lines(df, "doc_id", "text", MIN_WORDS)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove(") == 1, plan
    assert sorted((r.doc, r.line, r.n) for r in lines.collect()) == [(1, 0, 4), (1, 4, 1), (2, 0, 4), (2, 1, 4), (2, 2, 1)]
    got = {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup(df).collect()}
    assert got == brute(rows) == {1: (2, []), 2: (3, [0, 1, 2])}
