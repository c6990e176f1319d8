"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document becomes the set of its distinct word shingles. Documents with equal
   sets form one class, known by the set's 64-bit hash, so copies are never paired.
2. Classes are banded. A band key shared by several of them proposes
   pairs with the least and the greatest member of its bucket (linear in the bucket).
3. Signatures of proposed pairs are compared in batches; after each batch a pair is
   pruned once the posterior probability of reaching the threshold is under ``MISS``.
4. Survivors are confirmed on their full sets; confirmed links make components.
5. Larger buckets that still span several components are compared in blocks: what is
   outside a bucket's main component meets the blocks of its group, by signatures and the
   same pruning first; blocks of survivors then compare full sets.

Defined cases: null and empty texts have no shingles, link with nothing and stay; a
text of fewer words than a shingle is one shingle; rows with one id are one document, so their
texts' components are one; rows with a null id are documents after all others, one for each text, whose component is
null where no id is reachable (one of them stays then); an empty table gives an empty result; only the
id and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .store import NO_ID, free_name, id_again, id_and_text, written

ROWS, BANDS = 5, 32
BATCH = 32
MISS = 1e-6
SIMILARITY = 80
BLOCK = 512

_rng = np.random.RandomState(97)
_MUL = _rng.randint(1, 1 << 62, ROWS * BANDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.randint(1, 1 << 62, ROWS * BANDS, dtype=np.int64).astype(np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters are lower-cased."""
    low = tn.LOWER[buf]
    words = tn.Words(low, off)
    h = tn.span_hash(tn.prefix_hash(low), words.start, words.end)
    m = max(0, len(h) - width + 1)
    wide = tn.fold([h[k : m + k] for k in range(width)]) if m else h[:0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(wide[a : b - width + 1])
        elif b > a:
            yield tn.fold([h[a + k : a + k + 1] for k in range(b - a)] + [np.array([b - a], np.uint64)])
        else:
            yield h[:0]


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum under each of ROWS * BANDS hash functions, 32 bits each."""
    out = np.empty(len(_MUL), np.uint64)
    step = max(1, (1 << 17) // max(1, len(s)))
    for k in range(0, len(_MUL), step):
        x = s[None, :] * _MUL[k : k + step, None]
        x += _ADD[k : k + step, None]
        out[k : k + step] = x.min(1) >> np.uint64(32) if len(s) < 1 << 24 else (x >> np.uint64(32)).min(1)
    return out.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return tn.fold([np.arange(BANDS, dtype=np.uint64), *rows.T])


def set_hashes(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    x = tn.mix(s)
    return int((tn.fold([np.bitwise_xor.reduce(x)[None], x.sum(dtype=np.uint64)[None], np.array([len(s)], np.uint64)])).view(np.int64)[0]) if len(s) else 0


def features(src: DataFrame, width: int) -> DataFrame:
    """id, n_shingles, node (the set's hash), bands, sig of every row of id and text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, node, bands, sigs = [], [], [], []
            for _, _, buf, off in tn.slices(batch.column(1)):
                for s in shingle_sets(buf, off, width):
                    n.append(len(s))
                    node.append(set_hashes(s))
                    sig = signature(s) if len(s) else None
                    bands.append(None if sig is None else band_keys(sig).view(np.int64))
                    sigs.append(None if sig is None else sig.astype(np.uint16).tobytes())
            cols = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_shingles", "node", "bands", "sig"])

    return src.mapInArrow(run, "id long, n_shingles long, node long, bands array<long>, sig binary")


def sets_of(src: DataFrame, width: int) -> DataFrame:
    """id (the set's hash) and set of every text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [s for _, _, buf, off in tn.slices(batch.column(1)) for s in shingle_sets(buf, off, width)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hashes(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    return src.select("id", "text").mapInArrow(run, "id long, set binary")


def least_matches(n: int, similarity: float, miss: float = MISS) -> int:
    """Fewest matches of n at which similarity or more keeps a posterior of ``miss`` (uniform prior)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total >= miss:  # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
            return m
    return n


def _bounds(percent: int) -> list[tuple[int, int]]:
    return [(k, least_matches(k, percent / 100)) for k in range(BATCH, ROWS * BANDS + 1, BATCH)]


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, ROWS * BANDS)


def survivors(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]], matches: np.ndarray | None = None) -> np.ndarray:
    """Which of the pairs (row a of x, row b of y) no batch of signatures prunes; matches: of the batches before the first of bounds."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64) if matches is None else matches
    for k, least in bounds:
        matches[alive] += (x[a[alive], k - BATCH : k] == y[b[alive], k - BATCH : k]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive


def block_survivors(x: np.ndarray, y: np.ndarray, apart: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) of the pairs where apart holds that no batch prunes; the first batch counts all of a block at once."""
    k, least = bounds[0]
    matches = np.zeros(apart.shape, np.uint8)
    equal = np.empty(apart.shape, bool)
    for p, q in zip(np.ascontiguousarray(x[:, :k].T), np.ascontiguousarray(y[:, :k].T), strict=True):
        np.equal(p[:, None], q[None, :], out=equal)
        matches += equal.view(np.uint8)
    a, b = np.nonzero((matches >= least) & apart)
    alive = survivors(x, y, a, b, bounds[1:], matches[a, b].astype(np.int64))
    return a[alive], b[alive]


def plausible(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures prunes."""
    bounds = _bounds(percent)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                alive = pa.array(survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), at, at, bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], names=["a", "b"])

    s = sigs.select("id", "sig")
    wide = pairs.join(s.withColumnsRenamed({"id": "b", "sig": "y"}), "b").join(s.withColumnsRenamed({"id": "a", "sig": "x"}), "a")
    return wide.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(sets.withColumnsRenamed({"id": "b", "set": "y"}), "b").join(sets.withColumnsRenamed({"id": "a", "set": "x"}), "a")
    return wide.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _signed(sets: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sigs = [signature(np.frombuffer(x.as_py(), np.uint64)).astype(np.uint16).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], names=["id", "sig"])

    return sets.select("id", "set").mapInArrow(run, "id long, sig binary")


def block_links(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share buckets; named: (key, id, comp).

    A bucket's main component is its most frequent. All members of the buckets of one main component
    form a group, dealt to blocks of about BLOCK, and so are its members outside the main component; groups of up to
    BLOCK members share blocks of about that many. A block meets a block of these by signatures; members
    with a partner that the posterior leaves are compared exactly, where an index of their shingles gives
    similarities, one link for a document and component. Only signatures go to all blocks. A task holds two blocks.
    """
    main = named.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", -F.col("comp"))).alias("m")).select("key", (-F.col("m.col2")).alias("main"))
    members = written(named.join(main, "key").groupBy("main", "id", "comp").agg(F.lit(1).alias("n")).select("main", "id", "comp"), "minhash")
    outside = F.count_if(F.col("comp") != F.col("main"))
    sizes = members.groupBy("main").agg((F.count("*") > BLOCK).alias("big"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(outside / BLOCK).cast("int").alias("parts"), F.count("*").alias("n"))
    sizes = written(sizes, "minhash")
    slots = max(1, -(-(sizes.where("not big").agg(F.sum("n")).first()[0] or 0) // BLOCK))
    slot = F.when(F.col("big"), F.col("main")).otherwise(F.pmod(F.xxhash64("main"), F.lit(slots)))
    place = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = members.join(sizes.drop("n"), "main").withColumns({"slot": slot, "block": place, "part": part})
    sigs = written(_signed(sets.join(members.select("id").distinct(), "id", "left_semi")), "minhash")

    key = ["big", "slot", "block", "part"]
    key_type = "big boolean, slot long, block int, part int"

    def sides() -> tuple[DataFrame, DataFrame]:
        with_value = dealt.join(sigs, "id")
        all_parts, all_blocks = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
        left = with_value.select("big", "slot", "block", F.explode(all_parts).alias("part"), "main", "id", "comp", "sig")
        right = with_value.where("comp <> main").select("big", "slot", F.explode(all_blocks).alias("block"), "part", "main", "id", "comp", "sig")
        return left, right.toDF(*(f"{c}_" for c in right.columns))

    bounds = _bounds(percent)

    def sift(mine: pa.Table, others: pa.Table) -> pa.Table:
        """Of a block and a part of the others: the ids with a plausible partner on the other side."""
        side, ids = np.zeros(0, bool), np.zeros(0, np.int64)
        if mine.num_rows and others.num_rows:
            x, y = ([t.column(c + s).to_numpy() for c in ("main", "id", "comp")] for t, s in ((mine, ""), (others, "_")))
            apart = (x[0][:, None] == y[0][None, :]) & (x[2][:, None] != y[2][None, :])
            a, b = (np.unique(i) for i in block_survivors(_signatures(mine.column("sig")), _signatures(others.column("sig_")), apart, bounds))
            a, b = np.unique(x[1][a]), np.unique(y[1][b])
            side, ids = np.repeat([True, False], [len(a), len(b)]), np.append(a, b)
        head = [mine.column(c)[0].as_py() for c in key] if len(ids) else [None] * len(key)
        types = [pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
        return pa.table({**{c: pa.array([v] * len(ids), t) for c, v, t in zip(key, head, types, strict=True)}, "mine": pa.array(side), "id": pa.array(ids)})

    left, right = sides()
    hopeful = written(left.groupBy(*key).cogroup(right.groupBy(*(f"{c}_" for c in key))).applyInArrow(sift, f"{key_type}, mine boolean, id long"), "minhash")

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        ids, comps = mine.column("id").to_numpy(), mine.column("comp").to_numpy()
        a, b = [], []
        if others.num_rows:
            sets_ = [np.frombuffer(x.as_py(), np.uint64) for x in mine.column("set")]
            size = np.array([len(x) for x in sets_], np.int64)
            keys = np.concatenate(sets_) if sets_ else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            keys, owner = keys[order], np.repeat(np.arange(len(sets_)), size)[order]
            for i, c, x in zip(others.column("id_").to_pylist(), others.column("comp_").to_pylist(), others.column("set_"), strict=True):
                q = np.frombuffer(x.as_py(), np.uint64)
                lo, hi = np.searchsorted(keys, q, "left"), np.searchsorted(keys, q, "right")
                both = np.bincount(owner[tn.ranges(lo, hi - lo)], minlength=len(size))
                hit = np.flatnonzero((100 * both >= percent * (size + len(q) - both)) & (both > 0) & (comps != c))
                hit = hit[np.unique(comps[hit], return_index=True)[1]]
                a += [i] * len(hit)
                b += ids[hit].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    held = members.select("id", "comp").distinct().join(sets, "id")
    full = hopeful.join(held, "id").select(*key, "mine", "id", "comp", "set")
    asked = full.where("not mine").drop("mine")
    asked = asked.toDF(*(f"{c}_" for c in asked.columns))
    return full.where("mine").groupBy(*key).cogroup(asked.groupBy(*(f"{c}_" for c in key))).applyInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the least id reachable, for every id that has an edge.

    Minimum labels of neighbours, then one pointer jump, until nothing changes: labels only fall, and each
    round at least halves the pointers left, so rounds grow with the logarithm of a component's width.
    """
    both = written(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).where("id <> to").distinct(), name)
    labels = written(both.groupBy("id").agg(F.min("to").alias("low")).select("id", F.least("id", "low").alias("component")), name)
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("at"))
        jump = labels.select(F.col("id").alias("at"), F.col("component").alias("far"))
        new = written(step.join(jump, "at").select("id", "was", F.least("at", "far").alias("component")), name)
        labels = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return labels


def _same_id(full: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows with one id."""
    rows = full.where(F.col("id") < NO_ID).select("id", "node")
    several = rows.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    return rows.join(several, "id").where("a < node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (least id reachable), kept (id = component_id) of every document."""
    source = id_and_text(docs, id_col, text_col)
    feats = written(features(source, width), "minhash")
    full = feats.where("n_shingles > 0")
    classes = full.groupBy("node").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min_by("sig", "id").alias("sig"))
    classes = written(classes, "minhash")
    rows = classes.select(F.explode("bands").alias("key"), F.col("node").alias("id"))
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low < high")
    multi = written(rows.join(shared, "key"), "minhash")
    star = (
        multi.select(F.col("low").alias("a"), F.col("id").alias("b")).union(multi.select(F.col("id").alias("a"), F.col("high").alias("b"))).where("a < b")
        .groupBy("a", "b").agg(F.count("*").alias("bands"))
    )
    star = written(star, "minhash")
    sigs = classes.select(F.col("node").alias("id"), "sig").join(multi.select("id").distinct(), "id", "left_semi")
    best = star.groupBy("b").agg(F.max(F.struct("bands", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    hopeful = written(plausible(star.select("a", "b"), sigs, percent), "minhash")
    links: list[DataFrame] = [written(_same_id(full), "minhash")]

    def gathered(nodes: DataFrame) -> DataFrame:
        """Full sets of these classes, from the texts of their representatives."""
        wanted = nodes.join(classes.select(F.col("node").alias("id"), "rep"), "id")
        texts = source.join(wanted.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
        return written(sets_of(texts, width).join(nodes.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "minhash")

    def labels() -> DataFrame:
        return components(reduce(DataFrame.union, links), "minhash")

    sets = gathered(hopeful.select(F.col("a").alias("id")).union(hopeful.select("b")).distinct())
    links.append(written(confirmed(hopeful.join(best, ["a", "b"], "left_semi"), sets, percent), "minhash"))
    comp = labels()

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs that are not in one component yet."""
        a = comp.withColumnsRenamed({"id": "a", "component": "ca"})
        b = comp.withColumnsRenamed({"id": "b", "component": "cb"})
        return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    more = written(apart(hopeful, comp).join(best, ["a", "b"], "left_anti"), "minhash")
    if not more.isEmpty():
        links.append(written(confirmed(more, sets, percent), "minhash"))
        comp = labels()
    named = multi.where("size > 3").join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l < h").select("key")
    named = written(named.join(open_keys, "key", "left_semi"), "minhash")
    if not named.isEmpty():
        sets = sets.union(gathered(named.select("id").distinct().join(sets, "id", "left_anti")))
        links.append(written(block_links(named, sets, percent), "minhash"))
        comp = labels()
    reached = classes.select("node", "rep").join(comp.withColumnRenamed("id", "node"), "node")
    least = reached.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_node = reached.join(least, "component").select("node", "component_id")
    # a class without links has the least id of its own rows
    by_node = classes.select("node", "rep").join(by_node, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = feats.select("id", "n_shingles", "node").join(by_node, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(id_again("id").alias(free_name(id_col, ["n_shingles", "component_id", "kept"])), "n_shingles", id_again("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
