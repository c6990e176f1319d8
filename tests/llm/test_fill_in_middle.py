import contextlib
import hashlib
import io
import re

from pyspark.sql import functions as F

from tessera.llm.fill_in_middle import fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, rows, **kw):
    out = fill_in_middle(docs, **kw).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r[0] is None, r[0] or 0), r.n, r.form, r.prefix_chars is None, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out)
    want = []
    for i, t, *_ in rows:
        n, form, p, m, o = brute(i, t, **{k: v for k, v in {"rate": kw.get("rate"), "spm": kw.get("spm_rate")}.items() if v is not None})
        want.append(((i is None, i or 0), n, form, p is None, p, m, o, t or ""))
    assert got == sorted(want)


def test_against_brute_force(docs, rows):
    check(docs, rows)
    check(docs, rows, rate=100, spm_rate=50)


def test_odd_texts_ids_and_names(spark):
    texts = ["", None, " \n\t ", "a", "a <P> b c d", "x" * 100000, "é😀 ß z  \x0b y\x85w ", ("word \n" * 400000) + "end", "<S", "P> <", " lead", "a<\nb", "\x1c\x1d t"]
    rows = [(i % 9 if i % 4 else None, t, 1, 2, "n") for i, t in enumerate(texts * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, row int, form string").repartition(5)
    check(docs, rows, rate=90)


def test_any_id_name_and_empty_table(spark, empty):
    assert fill_in_middle(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "output long, text string")
    assert fill_in_middle(docs, id_col="output").columns[0] == "output_"


def test_texts_are_dealt_once(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fill_in_middle(spark.read.parquet(str(tmp_path / "d")))
        out.write.parquet(str(tmp_path / "o"))
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            out.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = shown.getvalue()
    dealt = re.findall(r"Exchange hashpartitioning\(row#\d+L, \d+\), REPARTITION_BY_COL", plan)
    assert len(re.findall("Exchange hashpartitioning", plan)) == len(dealt) == 3  # one for each use, equal but for column numbers; Spark runs the first only
    columns = re.findall(r"Project \[doc_id#\d+L AS id#\d+L, coalesce\(text#\d+, \) AS text#\d+, monotonically_increasing_id\(\) AS row#\d+L\]", plan)
    assert len(columns) == 3
