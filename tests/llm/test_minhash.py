import re

import numpy as np
import pytest

from tessera.llm.minhash import BANDS, ROWS, _bounds, block_survivors, components, least_matches, near_duplicates, survivors

W = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, width):
    sets = {}
    for i, t, _ in rows:
        w = W.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_components_match_brute_force(docs, rows):
    for width in (2, 5):
        got = {r.doc_id: r for r in near_duplicates(docs, width=width).collect()}
        want = brute(rows, width)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_chain_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[k * 6 : k * 6 + 100]), "s") for k in range(12)] + [(99, "other words here", "s")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"), width=2).collect()}
    want = {i: c for i, (_, c) in brute(rows, 2).items()}
    assert got == want


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_empty_table_and_bounds(empty):
    assert near_duplicates(empty).count() == 0
    assert 0 < least_matches(32, 0.8) < 26 and least_matches(160, 0.8) > 80


def test_a_block_prunes_as_single_pairs_do():
    rng = np.random.RandomState(6)
    x = rng.randint(0, 1 << 16, (30, ROWS * BANDS)).astype(np.uint16)
    y = np.where(rng.rand(20, ROWS * BANDS) < rng.rand(20)[:, None], x[rng.randint(0, 30, 20)], rng.randint(0, 1 << 16, (20, ROWS * BANDS))).astype(np.uint16)
    apart = rng.rand(30, 20) < 0.8
    a, b = np.nonzero(apart)
    alive = survivors(x, y, a, b, _bounds(80))
    got = block_survivors(x, y, apart, _bounds(80))
    assert len(alive) and {*zip(a[alive], b[alive], strict=True)} == {*zip(*got, strict=True)}


@pytest.mark.parametrize("block", [8, 512])
def test_buckets_of_unlike_documents_are_compared_in_blocks(spark, monkeypatch, block):
    """Many documents with one long common part share band keys without being alike; a few pairs of them are.

    The sides of a block must meet in one task also where shuffle partitions are not coalesced.
    """
    monkeypatch.setattr("tessera.llm.minhash.BLOCK", block)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    common = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join(common + [f"u{k}x{j}" for j in range(22)]), "s") for k in range(40)]
    rows += [(100 + k, " ".join(common + [f"u{k}x{j}" for j in range(21)] + [f"v{k}"]), "s") for k in range(0, 40, 3)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"), width=2).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_repeated_and_null_ids_and_clashing_names(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(120)) for x in "abc")
    rows = [(1, a, 0), (1, b, 0), (5, a + " x", 0), (7, b + " y", 0), (None, c, 0), (None, c + " z", 0), (None, a + " w", 0), (None, None, 0), (9, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(docs).collect())
    # a null id has no component to name where it reaches no id, and goes where it does
    assert got == sorted([(1, 1, True), (1, 1, True), (5, 1, False), (7, 1, False), (0, 0, True), (0, 0, False), (0, 1, False), (0, 0, True), (9, 9, True)])


def test_megabyte_texts(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 2_000_000), (4, "x" * 2_000_000), (5, "y" * 2_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5)}
