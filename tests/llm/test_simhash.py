import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as sh
from tessera.llm.minhash import components


def fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute_links(fps):
    fps = sorted(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]


def test_documents_against_brute_force(spark, docs, rows):
    far = 10**9
    odd = [(far, None, ""), (far, "Alpha beta\tgamma  delta", ""), (None, "alpha beta gamma delta", ""), (far + 1, "", ""), (None, "one two three", ""), (None, "a b c", "")]
    every = [*rows, *odd]
    out = sh.simhash_groups(docs.union(spark.createDataFrame(odd, docs.schema))).collect()
    fp = [fingerprint(t) for _, t, _ in every]
    links = brute_links(fp)
    by_id = {}
    for (i, _, _), f in zip(every, fp, strict=True):
        if i is not None:
            links.append((by_id.setdefault(i, f), f))
    root = groups_of(fp, links)
    least = {}
    for (i, _, _), f in zip(every, fp, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i is None, i or 0), f"{f:016x}", least.get(root[f], -1)) for (i, _, _), f in zip(every, fp, strict=True))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, -1 if r.component_id is None else r.component_id) for r in out) == want


def test_blanks_long_texts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(sh, "CHUNK", 7)
    rng = random.Random(5)
    texts = ["  ", "a", "A b", "x y z", " ".join(str(rng.randrange(99)) for _ in range(200)), "q\n" * 30, "é " * 40 + "w" * 5000]
    for t in texts:
        low = sh.tn.LOWER[sh.np.frombuffer(t.encode(), sh.np.uint8)]
        words = sh.tn.Words(low, sh.np.array([0, len(low)]))
        assert sh.majority(low.tobytes(), words.start, words.end, 3) == fingerprint(t)


@pytest.mark.parametrize("parts", [2, 3, 4])
@pytest.mark.parametrize("limit", [0, 30, 10**9])
def test_links_connect_what_is_near(spark, parts, limit):
    """A large group that differs in few bits, chains, and bits that go together; by probes, beyond them and mixed."""
    rng = random.Random(parts)
    fps = [rng.getrandbits(64) for _ in range(60)]
    base = rng.getrandbits(64)
    fps += [base ^ sum(1 << (5 * j) for j in range(11) if rng.random() < 0.5) for _ in range(300)]  # many within one group
    for _ in range(60):
        fps.append(rng.choice(fps[:60]) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps += [(x | 0xFFFFFF) for x in (rng.getrandbits(64) for _ in range(60))]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = sh.close_pairs(nodes, parts, limit)
    found = {(r.a, r.b) for r in links.collect()}
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 and a != b for a, b in found)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & mask).bit_count() <= 2]
    assert groups_of(fps, found) == groups_of(fps, near)
    if limit == 10**9:
        assert {tuple(sorted(p)) for p in near} == {tuple(sorted(p)) for p in found}
    comp = {r.id: r.component for r in components(links).collect()}
    assert {f: comp.get(f, f) for f in fps} == groups_of(fps, near)


def test_thresholds_are_the_cheapest_that_suffice():
    rng = sh.np.random.RandomState(1)
    cost = rng.rand(50, 4, 3) * 9
    cost = cost.cumsum(2)
    t, total = sh.thresholds(cost)
    every = [(a, b, c, d) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) for d in range(-1, 3) if a + b + c + d == 2 - 4 + 1]
    for k in range(50):
        price = {x: sum(cost[k, p, v] for p, v in enumerate(x) if v >= 0) for x in every}
        assert abs(total[k] - min(price.values())) < 1e-9 and abs(price[tuple(t[k].tolist())] - total[k]) < 1e-9


def test_bits_that_go_together_share_a_partition(spark):
    rng = random.Random(8)
    fps = []
    for _ in range(400):
        f = rng.getrandbits(64)
        for pair in ((3, 40), (9, 60), (20, 33)):
            f = f & ~(1 << pair[1]) | ((f >> pair[0] & 1) << pair[1])
        fps.append((f - (1 << 64) if f >> 63 else f,))
    nodes = spark.createDataFrame(fps, "fp long")
    groups = sh.correlated_groups(sh.joint_counts(nodes), len(fps), 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and [len(g) for g in groups] == [21, 21, 22]
    where = {b: k for k, g in enumerate(groups) for b in g}
    assert where[3] == where[40] and where[9] == where[60] and where[20] == where[33]


def test_empty_one_and_clashing_names(spark, empty):
    assert sh.simhash_groups(empty).count() == 0
    one = spark.createDataFrame([(7, "a b c", 1, 2)], "kept long, text string, fp int, id int")
    r = sh.simhash_groups(one, id_col="kept").collect()
    assert [(x.kept_, x.component_id, x.kept) for x in r] == [(7, 7, True)]
    many = spark.createDataFrame([(i, "same text here") for i in range(300)], "doc_id long, text string")
    assert {x.component_id for x in sh.simhash_groups(many).collect()} == {0}
    assert sh.simhash_groups(many).where(F.col("kept")).count() == 1
