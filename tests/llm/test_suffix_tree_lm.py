import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.suffix_tree_lm import _TOTAL, Alphabet, _gram_counts, distinct_words, from_planes, grow, suffix_tree_scores, summed, symbol_logs, unpack

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*W.findall(low), None]


def test_counts_and_base_match_brute_force(docs, rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows}
    c = Counter(w for i, t, _ in rows if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in suffix_tree_scores(docs, F.crc32(F.col("id").cast("string")) % 5 != 1).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r, tok = got[i], tokens(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tok), sum(c[w] > 0 for w in tok), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0


def test_distributions_sum_to_one():
    a = Alphabet(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(1 << 16, 2), np.array([0, 50, 100, 500, 350]), np.zeros(5, np.int64), 3)
    rng = np.random.RandomState(0)
    s = rng.choice([1, 2, 3, 4], 4000, p=[0.05, 0.1, 0.5, 0.35])
    s[1:][s[:-1] == 4] = 3  # 3 follows 4
    keys = np.concatenate([(1 << 60) | (s[:-1] << 20) | s[1:], (2 << 60) | (s[:-2] << 40) | (s[1:-1] << 20) | s[2:]]).astype(np.uint64)
    k, c = summed(keys, np.ones(len(keys), np.int64))
    ctx, total = summed(k >> np.uint64(20), c)
    k, c = np.append(k, (ctx << np.uint64(20)) | np.uint64(_TOTAL)), np.append(c, total)
    order = np.argsort(k)
    tree = grow(a, 0, k[order], c[order])
    assert len(tree.contexts[0]) >= 1
    for p1 in range(5):
        for p2 in range(5):
            logs = symbol_logs(tree, np.arange(1, 5), np.full(4, p1), np.full(4, p2))
            assert abs(np.exp(logs).sum() - 1) < 1e-9
    after = symbol_logs(tree, np.array([3]), np.array([4]), np.array([3]))
    assert np.exp(after[0]) > 0.9


def test_no_training_rows_and_empty(docs, rows, empty):
    got = suffix_tree_scores(docs, F.lit(False)).collect()
    assert len(got) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in got)
    assert suffix_tree_scores(empty, F.lit(True)).count() == 0


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in suffix_tree_scores(docs, F.crc32(F.col("id").cast("string")) % 5 != 1).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_force_scores(texts):
    """log10 of each text; every word is frequent enough to be a symbol, so no class has a word."""
    grams = {1: {}, 2: {}}
    for t in texts:
        seq = ["START", "START", *tokens(t)]
        for i in range(2, len(seq)):
            for d in (1, 2):
                grams[d].setdefault(tuple(seq[i - d : i]), Counter())[seq[i]] += 1
    c = Counter(w for t in texts for w in tokens(t))
    whole = sum(c.values()) + 0.5 * (len(c) + 1)  # and a class without words
    dist = {(): lambda s: (c[s] + 0.5) / whole}

    def of(ctx):
        return dist[ctx] if ctx in dist else of(ctx[1:])

    for d in (1, 2):
        for ctx, n in grams[d].items():
            above, total = of(ctx[1:]), sum(n.values())
            p = lambda s, n=n, above=above, total=total: (n[s] + 20 * above(s)) / (total + 20)
            if sum(k * math.log(p(s) / above(s)) for s, k in n.items()) >= 20:
                dist[ctx] = p
    out = []
    for t in texts:
        seq = ["START", "START", *tokens(t)]
        out.append(sum(math.log10(of(tuple(seq[i - 2 : i]))(seq[i])) for i in range(2, len(seq))))
    return out, [x for x in dist if len(x) == 2], c


def test_contexts_and_next_symbols_of_any_count_match_brute_force(spark):
    rng = np.random.RandomState(4)
    texts = [" ".join(f"w{i}" for i in rng.randint(0, 60, 100)) for _ in range(170)]
    texts += ["x y z", "v y u"] * 84 + ["x y r"] * 4
    want, longer, c = brute_force_scores(texts)
    n = sum(c.values())
    assert ("x", "y") in longer and c["x"] < 5e-3 * n  # this context was not counted
    assert min(c.values()) >= 2e-4 * n
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in suffix_tree_scores(docs, F.lit(True)).collect()}
    assert all(abs(got[i] - w) < 1e-6 * abs(w) for i, w in enumerate(want))


def test_counts_sent_in_parts_are_those_of_brute_force(spark):
    texts = [" ".join("abcdefgh"[i] for i in np.random.RandomState(j).randint(0, 8, 400)) for j in range(60)]
    want = Counter()
    for t in texts:
        seq = ["START", "START", *tokens(t)]
        for i in range(2, len(seq)):
            want[tuple(seq[i - 2 : i + 1])] += 1
            want[tuple(seq[i - 1 : i + 1])] += 1
    letters = np.frombuffer(b"a b c d e f g h", np.uint8)
    words, h, *_ = distinct_words(letters, np.array([0, len(letters)]))
    order = np.argsort(h)
    sym = ["START", None, "", *("abcdefgh"[i] for i in order)]
    alphabet = Alphabet(h[order], 3 + np.arange(8), np.full(1 << 16, 2), np.zeros(11, np.int64), np.zeros(11, np.int64), 3)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        rows = _gram_counts(docs, alphabet, 5, 10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = {}
    for r in rows:
        for k, n in zip(unpack([bytes(r["keys"])]).tolist(), from_planes([bytes(r["counts"])], np.int64).tolist(), strict=True):
            gram = tuple(sym[k >> shift & _TOTAL] for shift in ((40, 20, 0) if k >> 60 == 2 else (20, 0)))
            assert r["bucket"] == k >> 60 and gram not in got
            got[gram] = n
    assert got == want
