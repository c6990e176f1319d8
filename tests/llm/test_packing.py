import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm.packing import best_two_fit, cut_lengths, pack_documents, text_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "a", "a b", "a  b", "a\n\nb", "a  b\n\n c", "x　\n y", " lead", "trail \n", "it's 'tis don't", "<|endoftext|> x", "é 日本\t\tz", "1234 56,7", "\x1c a", "  \n\n  q"]


def test_texts_encode_as_the_library_does():
    enc, lib = text_encoder(PATH), Tokenizer.from_file(PATH)
    long = ["x" * 50_000, "^" * 50_000, " " * 50_000 + "a", "\n" * 50_000, "日本" * 20_000, "a1 " * 20_000]
    every = ["".join(f"a{chr(c)}b1{chr(c)} {chr(c)}!" for c in range(k, k + 512) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 512)]
    for t in [*HARD, " ".join(HARD), "\n".join(HARD[:5]), *long, *every]:
        assert enc(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_long_white_space_and_long_words():
    enc, lib = text_encoder(PATH), Tokenizer.from_file(PATH)
    for n, run in ((4095, " "), (4096, " "), (4097, "\n"), (2_000_000, "\t "), (5_000_000, " "), (1_500_000, "\n"), (70_000, " \u3000\x85\xa0\r\u2028"), (9000, "\x1c")):
        blanks = run * n
        for text in (f"x{blanks}y", blanks, f"{blanks}'s", f"a {blanks}", f"1{blanks}<|endoftext|> z", f"<|endoftext|>{blanks}\n!") if n < 100_000 else (f"x{blanks}y",):
            assert enc(text).tolist() == lib.encode(text, add_special_tokens=False).ids, (n, run, text[:3])
    for text in ("x" * 1_000_000, "9" * 300_000, "a b  c\n" * 300_000 + " " * 5000, f"{' ' * 5000}a{chr(10) * 5000} b"):
        assert enc(text).tolist() == lib.encode(text, add_special_tokens=False).ids, text[:9]


def test_null_ids_and_repeated_rows_have_their_own_pieces(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (None, "x y"), (None, None), (2, "x" + " " * 1_200_000 + "y")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = []
    for i, t in rows:
        ids, at = [*lib.encode(t or "", add_special_tokens=False).ids, 0], 0
        for k, n in enumerate(cut_lengths(len(ids))):
            want.append((i or -1, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_pieces_and_places(docs, rows, empty):
    lib = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    seqs = defaultdict(list)
    for r in pack_documents(docs, PATH).collect():
        got[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        parts = sorted(got[i], key=lambda r: r.piece)
        assert [r.length for r in parts] == cut_lengths(len(ids)) and [r.piece for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-total // 2048) + 1
    assert pack_documents(empty, PATH).count() == 0


def test_best_two_fit_places_all_and_beats_plain_greedy():
    rng = np.random.RandomState(2)
    for cap, n in ((100, 3000), (100, 7), (2048, 4000)):
        counts = np.bincount(rng.randint(1, cap + 1, n), minlength=cap + 1)
        bins = best_two_fit(counts, cap)
        back = np.zeros(cap + 1, np.int64)
        for m, inside in bins:
            assert sum(inside) <= cap
            np.add.at(back, inside, m)
        assert (back == counts).all()
        least = -(-int((counts * np.arange(cap + 1)).sum()) // cap)
        assert sum(m for m, _ in bins) <= max(least * 1.05 + 1, (np.arange(cap + 1) > cap // 2) @ counts)
    # 55 is best filled by 45, which two others of 22 + 23 replace only where tighter
    counts = np.bincount([60, 35, 20, 20], minlength=101)
    assert sum(m for m, _ in best_two_fit(counts, 100)) == 2
