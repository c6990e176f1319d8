"""Near-duplicate rows, contamination and retrieval by cosine and by BM25, all through shared keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, so of a task, at most about.
BLOCK_ROWS = 65536


def cosine_top_k(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, vec: str, k: int, blocks: int | None = None) -> DataFrame:
    """query_id, vector_id, score, rank: the k best of all vectors for a stated set of queries; ties by id.

    The query set meets the vectors in blocks: each block is one matrix product and keeps its own k best for a
    query before these meet. There are as many blocks as the session has shuffle
    partitions, more where these would hold over BLOCK_ROWS vectors.
    """
    blocks = blocks or max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // BLOCK_ROWS))
    q = queries.select(F.col(query_id).alias("qid"), F.col(vec).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at"))
    v = vectors.select(F.col(vector_id).alias("vid"), F.col(vec).alias("v"), F.pmod(F.xxhash64(vector_id), F.lit(blocks)).cast("int").alias("block"))

    def units(column: pa.ChunkedArray) -> np.ndarray:
        m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size > 0, size, 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({query_id: pa.array([], pa.int64()), vector_id: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vid, qid = left.column("vid").to_numpy(), right.column("qid").to_numpy()
        order = np.argsort(vid, kind="stable")
        score = units(right.column("q")) @ units(left.column("v"))[order].T
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return pa.table({query_id: np.repeat(qid, best.shape[1]), vector_id: vid[order][best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    kinds = dict(queries.dtypes)[query_id], dict(vectors.dtypes)[vector_id]
    local = v.groupBy("block").cogroup(q.groupBy("at")).applyInArrow(run, f"`{query_id}` {kinds[0]}, `{vector_id}` {kinds[1]}, score double")
    return local.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), vector_id))).where(F.col("rank") <= k)


def above(scored: DataFrame, score: str, threshold: float, row: str) -> DataFrame:
    """Ids whose best score is over the threshold."""
    return scored.where(F.col(score) > threshold).select(row).distinct()


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles(w: Column, n: int) -> Column:
    """Distinct runs of n words; w is a stored column, since the lambda reads it for every run."""
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))).otherwise(F.array().cast("array<string>"))


def contaminated(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, n: int, share: float) -> DataFrame:
    """doc, item, shared, share: documents that hold at least ``share`` of an item's shingles."""
    i = items.select(item, words(F.col(text)).alias("w")).select(item, shingles(F.col("w"), n).alias("s")).withColumn("size", F.size("s")).where("size > 0")
    d = docs.select(doc, words(F.col(text)).alias("w")).select(doc, F.explode(shingles(F.col("w"), n)).alias("g"))
    hits = d.join(i.select(item, "size", F.explode("s").alias("g")), "g").groupBy(doc, item, "size").agg(F.count("*").alias("shared"))
    return hits.withColumn("share", F.col("shared") / F.col("size")).where(F.col("share") >= share).drop("size")


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """query, doc, score, rank of the k best, from term and document frequencies; only documents that share a term meet a query."""
    d = docs.select(doc, words(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    terms = queries.select(query, F.explode(F.array_distinct(words(F.col(text)))).alias("t"))
    tf = d.select(doc, "len", F.explode("w").alias("t")).join(terms.select("t").distinct(), "t", "left_semi").groupBy(doc, "len", "t").agg(F.count("*").alias("tf"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    joined = terms.join(tf, "t").join(df, "t").join(F.broadcast(stats), F.lit(True))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = joined.groupBy(query, doc).agg(F.sum(s).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), doc))).where(F.col("rank") <= k)


def greedy_kept(pairs: DataFrame, rows: DataFrame, a: str, b: str, row: str) -> DataFrame:
    """Rows that stay when, in order, each row that is still there takes out its later partners.

    Equal to the sequential loop: a row whose earlier partners are all decided is decided by whether one of them stayed.
    Rounds decide at least all first rows of what is left, until every row in a pair is decided.
    """
    edges = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x < y").distinct()
    state = edges.select(F.col("y").alias("n")).union(edges.select("x")).distinct().withColumn("s", F.lit(0))  # 1 stays, -1 goes
    while True:
        from_ = edges.join(state.select(F.col("n").alias("x"), F.col("s").alias("sx")), "x")
        agg = from_.groupBy(F.col("y").alias("n")).agg(F.max("sx").alias("most"), F.max((F.col("sx") == 0).cast("int")).alias("waits"))
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("most").isNull(), 1).when(F.col("most") == 1, -1).when(F.col("waits") == 1, 0).otherwise(1)
        state = state.join(agg, "n", "left").select("n", new.alias("s")).checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else state.join(agg, "n", "left").select("n", new.alias("s")).persist()
        if state.where("s = 0").isEmpty():
            return rows.join(state.where("s = -1").select(F.col("n").alias(row)), row, "left_anti")


def one_to_one(scored: DataFrame, left: str, score: str, least: float) -> DataFrame:
    """Best match of each left row; rows whose best is under ``least`` are marked."""
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy(left).orderBy(F.desc(score)))).where("r = 1").drop("r")
    return best.withColumn("matched", F.col(score) >= least)


def dedup_key(*columns: str) -> Sequence[Column]:
    return [F.col(c) for c in columns]
