"""Language-model scores from a probabilistic suffix tree over words.

The alphabet: words that make up ``MIN_SHARE`` of the training tokens, classes of rarer words by
their last two bytes (again those of at least that share; one class takes the rest), and the
end of a text. So it has at most ``1 / MIN_SHARE`` symbols and three, however large the corpus. Contexts
are the last one or two symbols. Every context and every next symbol of the training rows is
counted. A context is retained if its next-symbol distribution diverges from its parent's by
``MIN_GAIN`` nats over its count. Distributions are smoothed towards the parent's with ``SMOOTH``
counts, and the longest retained suffix of what came before gives a token's distribution. Within a
class a word has its share of the class; words unknown to the training rows together have the share
of the class's tokens seen once (Good-Turing), as the base has one unknown word.

Contexts of one symbol are broadcast: at most the alphabet's size squared entries, whatever the
corpus. Those of two symbols stay distributed and grow with it: counts are summed by bucket of
context and symbol, so that a frequent context is in no one group; sums meet by context for the
test; all that is broadcast of them is which contexts are retained.

Word counts of the whole corpus stay distributed too: tasks send their distinct word hashes
with counts, packed by hash bucket; chunks of documents send the distinct hashes and entries of
retained contexts they need and get the counts back.

Defined cases: a null text counts as empty; an empty text is its end token alone; rows
with one id are each scored; rows with a null id are scored, held out and never learnt from; without training rows all counts are zero; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .store import dropped, free_name, id_again, id_of, named, partitions, recorded, shuffle_width, written
from .suffix_dedup import _by_group, _join, _table, chunk_column

MIN_SHARE = 2e-4
MIN_GAIN = 20.0
SMOOTH = 20.0
MOST_NEW = 0.9
CHUNK_BYTES = 8 << 20
#: A task sends its counts of contexts when it holds so many.
HELD = 4 << 20
START, END, OTHER = 0, 1, 2
#: The hash that stands for the end token.
END_HASH = np.uint64(0x0123456789ABCDEF)
_TOTAL = (1 << 20) - 1  # in place of a symbol: the context's own count


@dataclass
class Alphabet:
    hashes: np.ndarray  # of frequent words, sorted
    symbols: np.ndarray  # theirs
    tails: np.ndarray  # symbol of each of the 65536 two-byte endings
    counts: np.ndarray  # training tokens by symbol
    once: np.ndarray  # of these, of words seen once, by class
    first_word: int  # symbols from here on are single words

    def of(self, uniq: np.ndarray, tail: np.ndarray) -> np.ndarray:
        out = self.tails[tail]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, uniq), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == uniq, self.symbols[at], out)
        return out


@dataclass
class Tree:
    """root[s]; for retained contexts by depth: entry keys and logs, context keys and the log factor for other symbols."""

    root: np.ndarray
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    factors: list[np.ndarray]


def distinct_words(buf: np.ndarray, off: np.ndarray) -> tuple[tn.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their hash, distinct hashes, two-byte ending of each, place of each word among the distinct)."""
    low = tn.LOWER[buf]
    words = tn.Words(low, off)
    h = tn.span_hash(tn.prefix_hash(low), words.start, words.end)
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    last = words.end[at] - 1
    tail = low[last].astype(np.int64) + 256 * np.where(last > words.start[at], low[np.maximum(last - 1, 0)], 0).astype(np.int64) if len(at) else at
    return words, h, uniq, tail, inv


def planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers as all lowest bytes, then all second ones and so on: small numbers compress to little."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(packed: list[bytes], dtype: type) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(dtype).ravel() for x in packed]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def pack(keys: np.ndarray) -> bytes:
    """Of sorted keys."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(packed: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(from_planes([x], np.uint64), dtype=np.uint64) for x in packed)])


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted; np.unique of numpy 2.3 takes ten times as long here."""
    k = np.sort(keys)
    return k[np.append(True, k[1:] != k[:-1])[: len(k)]]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[cut], np.add.reduceat(counts[order], cut)


def summed_words(keys: np.ndarray, counts: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k = keys[order]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))[: len(k)]
    return k[cut], np.add.reduceat(counts[order], cut) if len(k) else counts, tails[order][cut]


_PACK = (["bucket", "keys", "counts", "tails"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()])
_PACKED = "bucket long, keys binary, counts binary, tails binary"


def _word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """Packed by bucket: distinct word hashes of the training rows, their counts and endings."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in it:
            for _, _, buf, off in tn.slices(batch.column(0)):
                _, _, uniq, tail, inv = distinct_words(buf, off)
                parts.append((np.append(uniq, END_HASH), np.append(np.bincount(inv, minlength=len(uniq)), len(off) - 1).astype(np.int64), np.append(tail, 0).astype(np.uint16)))
                if len(parts) > 16:
                    parts = [summed_words(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        if parts:
            k, c, t = summed_words(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            rows = [(b, pack(k[i]), planes(c[i]), t[i].tobytes()) for b, i in _by_group((k % np.uint64(buckets)).astype(np.int64))]
            for a in range(0, len(rows), 64):
                yield from _table(rows[a : a + 64], *_PACK).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        k, c, t = summed_words(unpack(table.column("keys").to_pylist()), from_planes(table.column("counts").to_pylist(), np.int64), _join(table, "tails", np.uint16))
        return _table([(table.column("bucket")[0].as_py(), pack(k), planes(c), t.tobytes())], *_PACK)

    return train.select("text").mapInArrow(run, _PACKED).groupBy("bucket").applyInArrow(merge, _PACKED)


def _alphabet(vocab: DataFrame, n: int) -> Alphabet:
    """From at most 1 / MIN_SHARE frequent words and 65536 endings."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for keys, counts, tails in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
                k, c, t = unpack([keys]), from_planes([counts], np.int64), np.frombuffer(tails, np.uint16)
                often = (c >= MIN_SHARE * n) & (k != END_HASH)
                rest = ~often & (k != END_HASH)
                total, once = np.bincount(t[rest], weights=c[rest], minlength=1 << 16), np.bincount(t[rest], weights=c[rest] == 1, minlength=1 << 16)
                there = np.flatnonzero(total)
                cols = [np.append(np.zeros(int(often.sum())), np.ones(len(there))), np.append(k[often].view(np.int64), there), np.append(c[often], total[there]), np.append(np.zeros(int(often.sum())), once[there])]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["kind", "key", "n", "once"])

    rows = vocab.select("keys", "counts", "tails").mapInArrow(run, "kind long, key long, n long, once long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()
    words = sorted((np.int64(r["key"]).view(np.uint64), r["n"]) for r in rows if r["kind"] == 0)
    tails = np.full(1 << 16, OTHER, np.int64)
    counts, once = [0, 0, 0], [0, 0, 0]
    for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["key"]):
        if r["n"] >= MIN_SHARE * n:
            tails[r["key"]] = len(counts)
            counts.append(r["n"])
            once.append(r["once"])
        else:
            counts[OTHER] += r["n"]
            once[OTHER] += r["once"]
    first = len(counts)
    return Alphabet(np.array([w for w, _ in words], np.uint64), first + np.arange(len(words)), tails, np.array([*counts, *(c for _, c in words)], np.int64), np.array([*once, *(0 for _ in words)], np.int64), first)


def token_symbols(words: tn.Words, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, the one before, the one before that, place of the ends) of all tokens, the end of each text included."""
    n = len(words.first) - 1
    ends = words.first[1:] + np.arange(n)
    s = np.full(len(sym) + n, END, np.int64)
    body = np.ones(len(s), bool)
    body[ends] = False
    s[body] = sym
    first = words.first[:-1] + np.arange(n)
    p1 = np.append(START, s[:-1])
    p1[first] = START
    p2 = np.append(START, p1[:-1])
    p2[first] = START
    return s, p1, p2, ends


_GRAMS = (["bucket", "keys", "counts"], [pa.int64(), pa.binary(), pa.binary()])
_GRAM = "bucket long, keys binary, counts binary"


def _dealt_grams(group: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by group of sorted keys and their counts."""
    rows = [(b, pack(keys[i]), planes(counts[i])) for b, i in _by_group(group)]
    for a in range(0, len(rows), 64):
        yield from _table(rows[a : a + 64], *_GRAMS).to_batches()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (tn.mix(keys) % np.uint64(buckets)).astype(np.int64)


def gram_keys(s: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    return ((2 << 60) | (p2 << 40) | (p1 << 20) | s).astype(np.uint64)


def _gram_counts(train: DataFrame, alphabet: Alphabet, buckets: int, most: int = HELD) -> DataFrame:
    """Packed, with its depth for a bucket: (depth, context and symbol; count) of all contexts of one or two symbols."""
    shared = train.sparkSession.sparkContext.broadcast(alphabet)  # at most 1 / MIN_SHARE symbols and three

    def sent(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, times = summed(np.uint64(1 << 60) | (k & np.uint64((1 << 40) - 1)), c)
        k, c = np.append(one, k), np.append(times, c)
        yield from _dealt_grams(_bucket(k, buckets), k, c)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in it:
            for _, _, buf, off in tn.slices(batch.column(0)):
                words, _, uniq, tail, inv = distinct_words(buf, off)
                s, p1, p2, _ = token_symbols(words, shared.value.of(uniq, tail)[inv])
                held.append(summed(gram_keys(s, p1, p2), np.ones(len(s), np.int64)))
                if len(held) > 8:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > most:
                        yield from sent(*held.pop())
        if held:
            yield from sent(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def merge(table: pa.Table) -> pa.Table:
        k, c = summed(unpack(table.column("keys").to_pylist()), from_planes(table.column("counts").to_pylist(), np.int64))
        return pa.Table.from_batches(_dealt_grams((k >> np.uint64(60)).astype(np.int64), k, c))

    return train.select("text").mapInArrow(run, _GRAM).groupBy("bucket").applyInArrow(merge, _GRAM)


def _collected(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts."""
    rows = grams.select("keys", "counts").collect()
    k, c = unpack([bytes(r["keys"]) for r in rows]), from_planes([bytes(r["counts"]) for r in rows], np.int64)
    order = np.argsort(k)
    return k[order], c[order]


def with_totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts with those of the contexts themselves."""
    ctx, total = summed(keys >> np.uint64(20), counts)
    k, c = np.append(keys, (ctx << np.uint64(20)) | np.uint64(_TOTAL)), np.append(counts, total)
    order = np.argsort(k)
    return k[order], c[order]


def _diverging(grams: DataFrame, tree: Tree, buckets: int) -> DataFrame:
    """Counts of the retained contexts of two symbols, next symbols and totals, packed by bucket; their totals again in bucket -1."""
    shared = grams.sparkSession.sparkContext.broadcast(tree)  # contexts of one symbol

    def by_context(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                k = unpack([keys])
                yield from _dealt_grams(_bucket(k >> np.uint64(20), buckets), k, from_planes([counts], np.int64))

    def test(table: pa.Table) -> pa.Table:
        k, c = unpack(table.column("keys").to_pylist()), from_planes(table.column("counts").to_pylist(), np.int64)
        order = np.argsort(k)
        k, c = with_totals(k[order], c[order])
        _, _, kept, _ = entries(shared.value, k, c, MIN_GAIN)
        on, _ = _find(kept, k >> np.uint64(20))
        k, c = k[on], c[on]
        total = (k & np.uint64(_TOTAL)) == np.uint64(_TOTAL)
        out = [*_dealt_grams(_bucket(k, buckets), k, c), *_dealt_grams(np.full(int(total.sum()), -1), k[total], c[total])]
        return pa.Table.from_batches(out) if out else _table([], *_GRAMS)

    return grams.where("bucket = 2").mapInArrow(by_context, _GRAM).groupBy("bucket").applyInArrow(test, _GRAM)


def grow(alphabet: Alphabet, texts: int, keys: np.ndarray, counts: np.ndarray) -> Tree:
    """The retained contexts, parents first."""
    root = alphabet.counts + 0.5
    root[END] += texts
    root[START] = 0
    root = root / root.sum()
    tree = Tree(np.log(np.maximum(root, 1e-300)), [], [], [], [])
    assert len(root) < _TOTAL
    for depth in (1, 2):
        there = (keys >> np.uint64(60)) == np.uint64(depth)
        if depth == 1 or there.any():
            tree = deeper(tree, keys[there], counts[there], MIN_GAIN)
    return tree


def deeper(tree: Tree, keys: np.ndarray, counts: np.ndarray, least: float) -> Tree:
    """tree with the contexts of one more symbol that gain ``least`` or more."""
    new = entries(tree, keys, counts, least)
    return Tree(tree.root, *([*old, x] for old, x in zip((tree.keys, tree.logs, tree.contexts, tree.factors), new, strict=True)))


def entries(tree: Tree, keys: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, logs, contexts, factors) of contexts one symbol longer than the tree's, from sorted keys with the contexts' totals."""
    own = (keys & np.uint64(_TOTAL)) == np.uint64(_TOTAL)
    ctx, total = keys[own] >> np.uint64(20), counts[own]
    k, c = keys[~own], counts[~own]
    at = np.searchsorted(ctx, k >> np.uint64(20))
    s, p1, p2 = ((k >> np.uint64(x) & np.uint64(_TOTAL)).astype(np.int64) for x in (0, 20, 40))
    parent = symbol_logs(tree, s, p1, p2)
    logs = np.log((c + SMOOTH * np.exp(parent)) / (total[at] + SMOOTH))
    good = np.bincount(at, weights=c * (logs - parent), minlength=len(ctx)) >= least
    return k[good[at]], logs[good[at]], ctx[good], np.log(SMOOTH / (total[good] + SMOOTH))


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which are there, their places)."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return sorted_keys[at] == wanted, at


def symbol_logs(tree: Tree, s: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """log P(symbol) by the longest retained suffix of the two symbols before it."""
    out = tree.root[s].copy()
    for d, ctx in ((1, (1 << 40) | p1), (2, (2 << 40) | (p2 << 20) | p1))[: len(tree.contexts)]:
        there, at = _find(tree.contexts[d - 1], ctx.astype(np.uint64))
        on = np.flatnonzero(there)
        hit, place = _find(tree.keys[d - 1], ((ctx[on] << 20) | s[on]).astype(np.uint64))
        out[on] = np.where(hit, tree.logs[d - 1][place] if len(tree.logs[d - 1]) else 0, out[on] + tree.factors[d - 1][at[on]])
    return out


def suffix_tree_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    train: over the id as column ``id``, true where the row is learnt from.
    """
    spark = docs.sparkSession
    src = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    src = src.withColumn("train", F.coalesce(train, F.lit(False)) & F.col("id").isNotNull()).withColumn("id", id_of("id", "text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(shuffle_width(spark), -(-total // CHUNK_BYTES))
    vocab = written(_word_counts(src.where("train"), chunks), "suffixtree")

    def stats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            c = [from_planes([x], np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in c], pa.int64()) for f in (len, lambda x: int(x.sum()))], names=["v", "n"])

    got = vocab.select("counts").mapInArrow(stats, "v long, n long").agg(F.sum("v"), F.sum("n")).first()
    v, n = (x or 0 for x in got)
    alphabet = _alphabet(vocab, n)
    alphabet.counts[END] = texts = int(n - alphabet.counts.sum())
    new = np.minimum((alphabet.once + 0.5) / (alphabet.counts + 1), MOST_NEW)  # by class, of unknown words
    size = len(alphabet.counts)
    retained = np.zeros(size * size, bool)
    known = vocab.select("bucket", "keys", "counts")
    if texts:
        with recorded() as paths:
            grams = written(_gram_counts(src.where("train"), alphabet, chunks), "suffixtree")
        tree = grow(alphabet, 0, *with_totals(*_collected(grams.where("bucket = 1"))))
        longer = written(_diverging(grams, tree, chunks), "suffixtree")
        dropped(spark, paths)
        kept = _collected(longer.where("bucket = -1"))[0]
        retained[((kept >> np.uint64(40) & np.uint64(_TOTAL)) * np.uint64(size) + (kept >> np.uint64(20) & np.uint64(_TOTAL))).astype(np.int64)] = True
        known = known.union(longer.where("bucket >= 0").withColumn("bucket", F.col("bucket") + chunks))
    else:
        tree = grow(alphabet, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast((alphabet, tree, retained))  # at most 1 / MIN_SHARE symbols and three, their square in entries
    dealt = src.withColumn("chunk", chunk_column(F.col("id"), chunks)).repartition(partitions(spark, total), "chunk")

    def wants(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, _, retained = shared.value
        need: dict[tuple[int, bool], list] = {}
        for batch in it:
            chunk = batch.column("chunk").to_numpy()
            for i, j, buf, off in tn.slices(batch.column("text")):
                words, h, uniq, tail, inv = distinct_words(buf, off)
                s, p1, p2, _ = token_symbols(words, alphabet.of(uniq, tail)[inv])
                long = retained[p2 * size + p1]
                k = gram_keys(s, p1, p2)[long]
                of, of_k = chunk[i:j][words.doc()], np.repeat(chunk[i:j], np.diff(words.first) + 1)[long]
                for c in np.unique(chunk[i:j]).tolist():
                    for key, new in (((c, False), h[of == c]), ((c, True), k[of_k == c])):
                        held = need.setdefault(key, [])
                        held.append(distinct(new))
                        if len(held) > 8:
                            need[key] = [distinct(np.concatenate(held))]
        for (c, gram), parts in need.items():
            k = np.concatenate(parts)
            k = distinct(np.concatenate([k, k | np.uint64(_TOTAL) if gram else [END_HASH]]))
            bucket = chunks + _bucket(k, chunks) if gram else (k % np.uint64(chunks)).astype(np.int64)
            rows = [(c, b, pack(k[i])) for b, i in _by_group(bucket)]
            for a in range(0, len(rows), 64):
                yield from _table(rows[a : a + 64], ["chunk", "bucket", "keys"], [pa.int64(), pa.int64(), pa.binary()]).to_batches()

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known, times = counted(right)
        rows = []
        for c, b, keys in zip(*(left.column(x).to_pylist() for x in ("chunk", "bucket", "keys")), strict=True):
            k = unpack([keys])
            hit, at = _find(known, k)
            rows.append((c, b >= chunks, pack(k[hit]), planes(times[at[hit]])))
        return _table(rows, ["chunk", "gram", "keys", "counts"], [pa.int64(), pa.bool_(), pa.binary(), pa.binary()])

    def counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        k, c = unpack(table.column("keys").to_pylist()), from_planes(table.column("counts").to_pylist(), np.int64)
        order = np.argsort(k)
        return k[order], c[order]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        alphabet, tree, _ = shared.value
        known, times = counted(right.filter(pc.invert(right.column("gram"))))
        tree = deeper(tree, *counted(right.filter(right.column("gram"))), -np.inf)  # told are retained contexts alone

        def count(k: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(k), np.int64)
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            return np.where(known[at] == k, times[at], 0)

        def base_logs(c: np.ndarray) -> np.ndarray:
            return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

        end_c = count(np.array([END_HASH]))
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for _, _, buf, off in tn.slices(left.column("text")):
            words, _, uniq, tail, inv = distinct_words(buf, off)
            c = count(uniq)
            sym = alphabet.of(uniq, tail)
            seen = np.log(np.maximum((1 - new[sym]) * c / np.maximum(alphabet.counts[sym], 1), 1e-300))
            inside = np.where(sym >= alphabet.first_word, 0.0, np.where(c > 0, seen, np.log(new[sym])))
            s, p1, p2, ends = token_symbols(words, sym[inv])
            doc, m = words.doc(), len(off) - 1
            _, one, back = np.unique(gram_keys(s, p1, p2), return_index=True, return_inverse=True)
            logp = symbol_logs(tree, s[one], p1[one], p2[one])[back]
            tdoc = np.repeat(np.arange(m), np.diff(words.first) + 1)
            cols[0].append(np.diff(words.first) + 1)
            cols[1].append(np.bincount(doc, weights=(c > 0)[inv], minlength=m).astype(np.int64) + int(end_c[0] > 0))
            cols[2].append(np.bincount(doc, weights=base_logs(c)[inv], minlength=m) + base_logs(end_c))
            cols[3].append((np.bincount(tdoc, weights=logp, minlength=m) + np.bincount(doc, weights=inside[inv], minlength=m)) / np.log(10))
        tokens, hits, base, mixed = (np.concatenate(x) if x else np.zeros(0) for x in cols)
        return pa.table({
            "id": left.column("id"), "held_out": pc.invert(left.column("train")), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(hits.astype(np.int64)),
            "train_tokens": pa.array(np.full(left.num_rows, n, np.int64)), "base_score": pa.array(base.astype(float)), "score": pa.array(mixed.astype(float)),
        })

    asked = dealt.mapInArrow(wants, "chunk long, bucket long, keys binary")  # all columns: the texts are shuffled once for both
    told = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "chunk long, gram boolean, keys binary, counts binary")
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)
    return out.select(id_again("id").alias(free_name(id_col, out.columns[1:])), *out.columns[1:])
