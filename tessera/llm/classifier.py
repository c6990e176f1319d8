"""Quality classifier: learned hashed word and character n-gram vectors, averaged, then softmax.

Features of a text are its words, the byte 3- and 4-grams of each word with its edges, and
marks of how often the text repeats itself (a few buckets), all hashed to ``BUCKETS`` vectors
of ``DIM``. A text is the average of its features' vectors; two outputs and softmax give the
probability of label 1. Stochastic gradient descent in numpy fits vectors and outputs to
at most ``SAMPLE`` labelled rows (taken by the least hash of their id, so the sample is
the same for any layout of the table); every document is scored by whole text.

Scoring needs of each vector only its effect on the difference of the two outputs, so the
model sent to the tasks is one number for each bucket.

Defined cases: a null text counts as empty; a text without words scores by its marks
alone; without labelled rows, or with one class only, the score is the share of label 1 (one
half without rows); several labels of one document count by their majority; repeated rows are
scored each for itself; rows with a null id are scored and held out; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .store import free_name, named

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)
#: Labelled rows that the model is fitted to, at most.
SAMPLE = 4000
EPOCHS, RATE, BATCH = 12, 1.0, 16
#: A mark counts as this share of a text's features.
MARK_SHARE = 0.05
CUT = 0.7


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words in order, number of each word's)."""
    size = end - start
    at = np.cumsum(size + 2) - size - 2  # where each word goes, with an edge sign before and after
    flat = np.full(int((size + 2).sum()), 32, np.uint8)
    flat[tn.ranges(at + 1, size)] = buf[tn.ranges(start, size)]
    pre = tn.prefix_hash(flat)
    spans = [(at, size + 2, np.ones(len(size), np.int64))]
    spans += [(at, np.full(len(size), n), np.maximum(size + 3 - n, 0)) for n in GRAMS]
    count = sum(c for *_, c in spans)
    out = np.empty(int(count.sum()), np.int64)
    put = np.cumsum(count) - count
    for k, (a, n, c) in enumerate(spans):
        s = tn.ranges(a, c)
        h = tn.span_hash(pre, s, s + np.repeat(n, c)) + np.uint64(k * 0x51ED2701)
        out[tn.ranges(put, c)] = (tn.mix(h) % np.uint64(BUCKETS)).astype(np.int64)
        put = put + c
    return out, count


def marks(words: tn.Words, inv: np.ndarray, n: int) -> np.ndarray:
    """Bucketed statistics of each text: its length, and its share of different words."""
    total = np.diff(words.first)
    key = words.doc().astype(np.int64) * (int(inv.max(initial=0)) + 1) + inv
    kinds = np.bincount(words.doc()[np.unique(key, return_index=True)[1]], minlength=n)[:n]
    ratio = np.where(total > 0, kinds / np.maximum(total, 1) * np.log2(total + 2), 0)
    long_ = np.minimum(np.log2(total + 1).astype(np.int64), 20)
    feats = np.stack([long_, 100 + np.minimum((4 * ratio).astype(np.int64), 60)], 1)
    return (tn.mix(feats.astype(np.uint64) + np.uint64(0xFEED0000)) % np.uint64(BUCKETS)).astype(np.int64)


def _slice(buf: np.ndarray, off: np.ndarray) -> tuple[tn.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words = tn.Words(buf, off)
    h = tn.span_hash(tn.prefix_hash(buf), words.start, words.end)
    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
    feats, count = word_features(buf, words.start[at], words.end[at])
    return words, feats, count, inv, marks(words, inv, len(off) - 1)


def bags(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, their weights, which sum to one) of each text."""
    words, feats, count, inv, mark = _slice(buf, off)
    first = np.cumsum(count) - count
    for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        w = inv[a:b]
        f = feats[tn.ranges(first[w], count[w])]
        ids, n = np.unique(f, return_counts=True)
        rest = 1 - MARK_SHARE * mark.shape[1] if len(f) else 0
        yield np.concatenate([ids, mark[k]]), np.concatenate([n * (rest / max(len(f), 1)), np.full(mark.shape[1], MARK_SHARE if len(f) else 1 / mark.shape[1])])


@dataclass
class Model:
    """effect[bucket]: of a feature on the log odds; bias."""

    effect: np.ndarray
    bias: float


def fit(ids: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    n = len(labels)
    share = float(labels.mean()) if n else 0.5
    if not n or share in (0.0, 1.0):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.RandomState(seed)
    vec = (rng.rand(BUCKETS, DIM) - 0.5) / DIM
    out, bias = rng.randn(DIM, 2) * 0.1, np.log(np.array([1 - share, share]))
    steps, done = EPOCHS * -(-n // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            pick = order[a : a + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            f = np.concatenate([ids[k] for k in pick])
            w = np.concatenate([weights[k] for k in pick])
            size = np.array([len(ids[k]) for k in pick])
            at = np.cumsum(size) - size
            hidden = np.add.reduceat(vec[f] * w[:, None], at)
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            back = np.repeat(p @ out.T, size, axis=0) * w[:, None]
            out -= rate * hidden.T @ p / len(pick) * 4
            bias = bias - rate * p.mean(0)
            uniq, inv = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(inv, weights=back[:, d], minlength=len(uniq)) for d in range(DIM)], 1)
            vec[uniq] -= rate * 20 * grad
    diff = out[:, 1] - out[:, 0]
    return Model(vec @ diff, float(bias[1] - bias[0]))


def slice_scores(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    words, feats, count, inv, mark = _slice(buf, off)
    n, m = len(off) - 1, mark.shape[1]
    if len(count):
        effect = np.add.reduceat(model.effect[feats], np.cumsum(count) - count)
        doc = words.doc()
        total = np.bincount(doc, weights=count[inv], minlength=n)
        body = np.bincount(doc, weights=effect[inv], minlength=n) / np.maximum(total, 1)
    else:
        total = body = np.zeros(n)
    tail = model.effect[mark].sum(1)
    z = np.where(total > 0, (1 - MARK_SHARE * m) * body + MARK_SHARE * tail, tail / m) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """learn: over the id as column ``id``, true where a row's label may be used."""
    marked = labels.select(named(id_col).cast("long").alias("id"), named(label_col).alias("label")).where(F.col("label").isNotNull() & learn)
    chosen = marked.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    src = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    few = src.join(F.broadcast(chosen), "id").select("id", "label", "text")  # at most ``sample`` rows are broadcast

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [(i.astype(np.int32).tobytes(), w.astype(np.float32).tobytes()) for _, _, buf, off in tn.slices(batch.column(2)) for i, w in bags(buf, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], names=["id", "label", "f", "w"])

    rows = sorted(few.mapInArrow(run, "id long, label int, f binary, w binary").collect(), key=lambda r: (r["id"], bytes(r["f"])))
    return fit([np.frombuffer(r["f"], np.int32) for r in rows], [np.frombuffer(r["w"], np.float32).astype(float) for r in rows], np.array([r["label"] for r in rows], np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """id_col, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn, id_col, text_col, sample=sample))  # BUCKETS numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = [slice_scores(model.value, buf, off) for _, _, buf, off in tn.slices(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["id", "held_out", "score"])

    src = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).withColumn("held_out", ~F.coalesce(learn, F.lit(False)))
    out = src.select("id", "held_out", "text").mapInArrow(run, "id long, held_out boolean, score double")
    rest = ["held_out", "score", "predicted"]
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int")).select(F.col("id").alias(free_name(id_col, rest)), *rest)
