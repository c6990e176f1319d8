import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import textnum as tn
from tessera.llm.classifier import bags, fit, quality_scores, slice_scores


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(400):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        rows.append((i, " ".join(w + rng.choice(["###", "%%%"]) for w in body) if i % 4 == 0 else " ".join(body), "s", int(i % 4 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int")
    out = quality_scores(df.drop("quality"), df.select("doc_id", "quality"), F.col("id") % 5 != 2).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and len(held) == 80
    assert sum((r.doc_id % 4 > 0) == (r.predicted == 1) for r in held) >= 78


def test_scores_equal_the_bags(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    got = list(bags(buf, off))
    assert all(abs(w.sum() - 1) < 1e-9 for _, w in got)
    model = fit([i for i, _ in got], [w for _, w in got], np.arange(len(got)) % 2)
    want = [1 / (1 + np.exp(-(model.effect[i] @ w + model.bias))) for i, w in got]
    assert np.allclose(slice_scores(model, buf, off), want)
    whole = [slice_scores(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(whole, want)
    assert len(list(tn.slices(__import__("pyarrow").array([None, ""])))) >= 1


def test_without_labels_and_empty(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none, F.lit(True)).collect()} == {0.5}
    assert quality_scores(empty, none, F.lit(True)).count() == 0
