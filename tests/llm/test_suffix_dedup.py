import hashlib

import numpy as np

from tessera.llm.suffix_dedup import multikey_quicksort, suffix_dedup


def brute(rows):
    first, texts = {}, sorted((i, (t or "").encode()) for i, t, _ in rows)
    for i, b in texts:
        for s in range(len(b) - 99):
            first.setdefault(b[s : s + 100], (i, s))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_matches_brute_force(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()}
    assert got == brute(rows)


def test_whole_texts_and_repeated_rows(spark, empty):
    rows = [(5, "ab" * 400, "s"), (5, "ab" * 400, "s"), (7, "q" * 99, "s"), (9, "q" * 99, "s"), (-3, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()}
    assert got == brute(rows[1:])
    assert suffix_dedup(empty).count() == 0


def test_repeats_inside_one_segment(spark):
    rng = np.random.RandomState(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.randint(0, 26, n))
    texts = ["ab" * 75, "-" * 120, "ab" * 81 + "a", "=" * 163, *(f"{word(150)}\n{'~' * 130}\n{word(150)}" for _ in range(4))]
    for period in (1, 2, 3, 8, 16, 31, 32, 33, 47, 62, 63, 64, 65, 99, 100):
        unit = word(period)
        texts += [word(40) + (unit * 300)[: 100 + extra] + word(40) for extra in (period - 1, period, period + 7, 163, 227)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()}
    assert got == brute(rows)
    alone = {r.doc_id: r.n_removed for r in suffix_dedup(df.where("doc_id < 2")).collect()}
    assert alone == {0: 148, 1: 119}


def test_multikey_quicksort():
    rng = np.random.RandomState(1)
    cols = [rng.randint(0, 5, 60000), rng.randint(0, 9, 60000), rng.permutation(60000)]
    assert (multikey_quicksort(cols) == np.lexsort(cols[::-1])).all()
