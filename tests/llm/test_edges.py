"""Null and repeated ids, clashing names, megabyte texts and empty tables through every operator and stage."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.classifier import quality_scores
from tessera.llm.line_dedup import line_dedup, without_repeated_lines
from tessera.llm.lz_fingerprint import edited_text, lz_fingerprints
from tessera.llm.packing import pack_documents
from tessera.llm.paragraph_dedup import repeated_passages, without_repeats
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.suffix_tree_lm import suffix_tree_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, `of` int, id int, gone int"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TRAIN = "crc32(cast(id as string)) % 5 <> 1"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    shared = prose(rng, 90)
    texts = [(1, shared), (3, prose(rng, 60) + "\n" + shared), (None, shared + "\n" + prose(rng, 50)), (None, prose(rng, 70)), (4, prose(rng, 80)), (4, None), (None, None), (6, "")]
    texts[5] = texts[4]  # a repeated row
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in texts], SCHEMA).cache()


def by_text(docs, out, column):
    return sorted((r[0] is None, r[0] or 0, r[column]) for r in out.collect())


def test_null_ids_lose_nothing_and_take_nothing_away(odd):
    with_, without = (suffix_dedup(d) for d in (odd, odd.where("doc_id is not null")))
    assert [r for r in by_text(odd, with_, "n_removed") if not r[0]] == by_text(odd, without, "n_removed")
    assert sorted(r.n_removed > 0 for r in with_.collect() if r.doc_id is None) == [False, False, True]
    found = repeated_passages(odd).collect()
    assert sorted((r.doc_id or 0, r.copy_of) for r in found) == [(0, 1), (3, 1)]
    lines = {(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup(odd).collect()}
    assert lines == {(1, 1, 0), (3, 2, 1), (None, 2, 1), (None, 1, 0), (4, 1, 0), (None, 0, 0), (6, 0, 0)}
    n = odd.count()
    for out in (lz_fingerprints(odd), bpe_round_trip(odd, WORD), suffix_tree_scores(odd, F.expr(TRAIN)), quality_scores(odd, odd.select("doc_id", F.lit(1).alias("quality")), F.expr(TRAIN))):
        rows = out.collect()
        assert len(rows) == n and sum(r[0] is None for r in rows) == 3
        assert all(r.held_out for r in rows if r[0] is None and "held_out" in out.columns)


def test_id_columns_with_any_name(odd):
    for name in ("n.chars", "length"):
        d = odd.select(F.col("doc_id").alias(name), "text")
        for op in (suffix_dedup, repeated_passages, line_dedup, lz_fingerprints, lambda x, c: bpe_round_trip(x, WORD, c), lambda x, c: suffix_tree_scores(x, F.expr(TRAIN), c), lambda x, c: pack_documents(x, BYTE, id_col=c)):
            out = op(d, name)
            assert out.columns[0] in (name, name + "_") and len(set(out.columns)) == len(out.columns)
            assert out.count() >= 2


def test_rows_that_pass_through_keep_their_columns(odd):
    for cut in (without_repeated_lines, without_repeats):
        out = cut(odd)
        assert out.columns == odd.columns and out.count() == odd.count()
        assert {(r.length, r["of"], r.id, r.gone) for r in out.collect()} == {(1, 2, 3, 4)}


def test_stages_on_odd_and_empty_tables(spark, odd):
    for docs in (odd, odd.limit(0)):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, "")
            assert out.columns == docs.columns, name
            at = spark.createDataFrame(out.collect(), out.schema)
        # rules drop what has no text; repeated rows are one document; null ids stay where they repeat nothing
        left = sorted((r.doc_id or 0) for r in at.collect())
        assert left == ([0, 0, 1, 3, 4, 4] if docs is odd else [])
        pieces = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
        assert len(pieces) == len(left)


def test_megabyte_texts(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(250_000))
    rows = [(1, long), (2, "start\n" + long), (3, "x" * 1_500_000), (4, "日本" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(docs).collect()}
    size = len(long)
    assert got == {1: (size, 0, 0), 2: (size + 6, size, 1), 3: (1_500_000, 1_499_999, 1), 4: (1_800_000, 1_800_000 - 6, 1)}
    spans = {r.doc_id: (r.first_word, r.n_words, r.copy_of) for r in repeated_passages(docs).collect()}
    assert spans == {2: (1, 250_000, 1)}
    assert {r.doc_id: r.n_removed for r in line_dedup(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    fp = {r.doc_id: r for r in lz_fingerprints(docs).collect()}
    texts = dict(rows)
    for i, nxt in ((4, 3), (3, 2), (2, 1), (1, 4)):
        assert fp[i].edited_sha256 == hashlib.sha256(edited_text(texts[i], texts[nxt]).encode()).hexdigest()
    lib = Tokenizer.from_file(WORD)
    for r in bpe_round_trip(docs, WORD).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    byte = Tokenizer.from_file(BYTE)
    length = {i: len(byte.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    packed = pack_documents(docs, BYTE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert {r.doc_id: r.n for r in packed} == length and max(r.most for r in packed) <= 2048
    scores = {r.doc_id: (r.n_tokens, r.score < 0) for r in suffix_tree_scores(docs, F.lit(True)).collect()}
    assert scores == {1: (250_001, True), 2: (250_002, True), 3: (2, True), 4: (2, True)}
