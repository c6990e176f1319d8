import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import Encoder, bpe_round_trip, lookahead

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def enc():
    return Encoder(PATH)


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


HARD = ["", " ", "Don't we'LL", "ΟΔΟΣ Σ ΣΑΣ", "é ́x", "a b  c\u0085d", "x\x1cy", "İstanbul", "12345 6", "<|endoftext|>a <|startoftext|>", "<| endoftext", "日本語テキスト", "🙂🙂👨‍👩‍👧", "ab\x00c", "***foo###", "ß ẞ ﬁ", "x" * 5000, "!?" * 3000]


def test_encode_and_decode_as_the_library(enc, lib):
    for t in HARD:
        want = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == want, t[:40]
        assert enc.decode(want) == lib.decode(want, skip_special_tokens=False), t[:40]


def test_streamed_pieces_equal_whole_merges(enc):
    rng = random.Random(5)
    toks = [t.removesuffix("</w>") for t in enc.ids]
    for k in range(60):
        s = "".join(rng.choice("abcdeinrst") for _ in range(3000)) if k % 2 else "".join(rng.choice(toks) for _ in range(700))
        whole = enc.merge([*s[:-1], s[-1] + "</w>"])
        assert list(enc.stream(iter(s))) == whole


def test_lookahead_bounds_influence():
    rng = random.Random(1)
    for _ in range(150):
        toks, merges = list("abc"), []
        while len(merges) < 12:
            m = (rng.choice(toks), rng.choice(toks))
            if m not in merges and len(m[0] + m[1]) < 7:
                merges.append(m)
                toks.append(m[0] + m[1])
        e = Encoder.__new__(Encoder)
        e.rank, e.end, e.ahead = {m: k for k, m in enumerate(merges)}, "", lookahead(merges)
        for _ in range(20):
            s = "".join(rng.choice("abc") for _ in range(600))
            assert list(e.stream(iter(s))) == e.merge(list(s))


def test_byte_level_decoder(lib):
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = Encoder(path), Tokenizer.from_file(path)
    for s in HARD:
        ids = t.encode(s, add_special_tokens=False).ids
        for cut in (ids, ids[: len(ids) // 2], ids[1:]):
            assert e.decode(cut) == t.decode(cut, skip_special_tokens=False)


def test_query_digests(docs, rows, empty, lib):
    got = {r.doc_id: r for r in bpe_round_trip(docs, PATH).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_round_trip(empty, PATH).count() == 0
