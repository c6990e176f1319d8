import hashlib

from tessera.llm.lz_fingerprint import edited_text, fingerprint, likeness, lz_fingerprints, phrases


def test_neighbours_and_fingerprints_match_brute_force(docs, rows):
    got = {r.doc_id: r for r in lz_fingerprints(docs).collect()}
    order = sorted(((i, t or "") for i, t, _ in rows), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = edited_text(t, nxt)
        a, b, c = (fingerprint(x.encode()) for x in (t, e, nxt))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:04x}" for x in a) and r.edited_fingerprint == "".join(f"{x:04x}" for x in b)
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))


def test_phrases_and_likeness():
    assert sorted(phrases(b"a b a b a b c")) == [b"a ", b"a b ", b"a b c ", b"b "]
    assert likeness(fingerprint(b""), fingerprint(b" \n")) == 1 and likeness(fingerprint(b""), fingerprint(b"x y")) == 0
    assert len(phrases("字".encode() * 400)) > 10
    base = [f"w{k}" for k in range(600)]
    near, far = " ".join([*base[:450], *(f"v{k}" for k in range(150))]), " ".join(f"u{k}" for k in range(600))
    x = fingerprint(" ".join(base).encode())
    assert likeness(x, fingerprint(near.encode())) > 0.4 and likeness(x, fingerprint(far.encode())) < 0.05


def test_few_rows(spark, empty):
    assert lz_fingerprints(empty).count() == 0
    one = lz_fingerprints(spark.createDataFrame([(3, "a b c d", "s")], "doc_id long, text string, source string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(edited_text("a b c d", "a b c d").encode()).hexdigest()
    two = lz_fingerprints(spark.createDataFrame([(3, "a", "s"), (3, "a", "s"), (-1, None, "s")], "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in two) == [-1, 3, 3]
