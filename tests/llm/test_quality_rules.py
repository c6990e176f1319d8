import re
from collections import Counter

import numpy as np

from tessera.llm import quality_rules as module
from tessera.llm.quality_rules import accepted, expectation_maximisation, quality_rules

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n)


def test_statistics_match_brute_force(docs, rows):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), i
        assert not (r.kept and r.base_failed)


def test_empty_table(empty):
    assert quality_rules(empty).count() == 0


def test_estimates_find_what_is_wrong():
    rng = np.random.RandomState(3)
    good = rng.rand(8000) < 0.85
    kind = rng.randint(0, 2, 8000)  # which two rules see what is wrong
    wrong = ~good[:, None] & (kind[:, None] == np.arange(6) // 3) & (rng.rand(8000, 6) < 0.9)
    pats, inv, counts = np.unique(np.where(wrong, -1, 1), axis=0, return_inverse=True, return_counts=True)
    shares, prior, post = expectation_maximisation(pats, counts.astype(float))
    assert abs(prior - 0.85) < 0.05 and np.allclose(shares.sum(2), 1)
    assert ((post[inv.ravel()] >= 0.5) == good).mean() > 0.97
    assert (shares[:, 0, 0] < 0.02).all() and (shares[:, 1, 0] > 0.15).all()


def plain_em(pats, counts, rounds):
    """The same estimates document by document, in plain Python."""
    docs = [tuple(p) for p, c in zip(pats.tolist(), counts.astype(int).tolist()) for _ in range(c)]
    good = [0.1 if -1 in d else 0.9 for d in docs]
    share = 0.5
    for _ in range(rounds):
        tables = []
        for weight, mean in ((good, module.PRIOR_GOOD), ([1 - g for g in good], module.PRIOR_BAD)):
            total = sum(weight) + module.PSEUDO
            tables.append([[(sum(w for d, w in zip(docs, weight) if d[k] == v) + module.PSEUDO * mean[v + 1]) / total for v in (-1, 0, 1)] for k in range(pats.shape[1])])
        share = (sum(good) + 1) / (len(docs) + 2)
        new = {}
        for d in set(docs):
            a, b = share, 1 - share
            for k, v in enumerate(d):
                a, b = a * tables[0][k][v + 1], b * tables[1][k][v + 1]
            new[d] = a / (a + b)
        good = [new[d] for d in docs]
    return [new[tuple(p)] for p in pats.tolist()]


def test_posterior_matches_plain_em():
    rng = np.random.RandomState(5)
    bad = rng.rand(600) < 0.3
    votes = np.where(rng.rand(600, 4) < np.where(bad, 0.6, 0.05)[:, None], -1, rng.choice([0, 1], (600, 4)))
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    got = expectation_maximisation(pats, counts.astype(float), rounds=25)[2]
    assert np.allclose(got, plain_em(pats, counts, 25), atol=1e-6)


def test_an_unreliable_rule_is_outvoted():
    rng = np.random.RandomState(6)
    bad = rng.rand(20000) < 0.2
    votes = np.where(bad[:, None] & (rng.rand(20000, 4) < 0.8), -1, 1)
    votes[:, 3] = np.where(rng.rand(20000) < 0.1, -1, 1)  # says bad at random
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    shares, _, post = expectation_maximisation(pats, counts.astype(float))
    alone = (pats == [1, 1, 1, -1]).all(1)
    assert post[alone] > 0.9 and abs(shares[3, 0, 0] - 0.1) < 0.02
    two = (pats == [-1, -1, 1, 1]).all(1)
    assert post[two] < 0.1


def test_pseudo_documents_do_not_grow_with_the_corpus():
    pats = np.array([[1, 1, 1], [-1, -1, 1], [1, 1, -1]])
    small, large = (expectation_maximisation(pats, np.array([80.0, 15, 5]) * k)[0] for k in (1, 1000))
    assert abs(large[2, 0, 0] - 5 / 85) < 0.01 < abs(small[2, 0, 0] - 5 / 85)


def test_null_ids_clashing_names_and_rows_that_stay(spark):
    good = " ".join("w" + "abcdefghij"[k // 10] * 2 + "abcdefghij"[k % 10] * 2 for k in range(60))
    schema = "doc_id long, text string, n_words string, kept int, `a b` int, row int"
    docs = spark.createDataFrame([(1, good, "x", 1, 1, 1), (None, good, None, 2, 2, 2), (None, "short", "y", 3, 3, 3), (4, None, "z", 4, 4, 4), (1, good, "x", 1, 1, 1)], schema)
    got = sorted((r.doc_id or 0, r.kept) for r in quality_rules(docs).collect())
    assert got == [(0, False), (0, True), (1, True), (1, True), (4, False)]
    left = accepted(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept, r.row) for r in left.collect()) == [(0, 2, 2), (1, 1, 1), (1, 1, 1)]


def test_megabyte_texts(spark):
    long, one = " ".join(f"w{k}" for k in range(400_000)), "x" * 2_000_000
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(1, long), (2, one), (3, long + " " + long)], "doc_id long, text string")).collect()}
    assert got[1].n_words == 400_000 and got[1].n_repeat_words == 0 and not got[1].base_failed
    assert (got[2].n_words, got[2].word_chars, got[2].base_failed) == (1, 2_000_000, True)
    assert got[3].n_repeat_words == 800_000 and got[3].base_failed
