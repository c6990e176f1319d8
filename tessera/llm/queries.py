"""The queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_documents(spark, sf_dir))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_round_trip

    return bpe_round_trip(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_fingerprint import lz_fingerprints

    return lz_fingerprints(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    lines = line_dedup(_documents(spark, sf_dir))
    return lines.withColumn("removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ","))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree_lm import suffix_tree_scores

    return suffix_tree_scores(_documents(spark, sf_dir), F.crc32(F.col("id").cast("string")) % 5 != 1)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), width=2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import quality_scores

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(_documents(spark, sf_dir), labels, F.crc32(F.col("id").cast("string")) % 4 != 2)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import repeated_passages

    return repeated_passages(_documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    out = fill_in_middle(_documents(spark, sf_dir))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return out.withColumns(digests).drop("output", "first_cut", "last_cut")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_documents(spark, sf_dir)).drop("kept")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_clusters

    out = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digits = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    return out.withColumn("centroid_sha256", F.sha2(digits, 256)).drop("centroid")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_lz_fingerprint": op4_lz_fingerprint,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_tree_lm": op6_suffix_tree_lm,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_paragraph_dedup": op10_paragraph_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}


def _lloyd_sql(rounds: int = 5, clusters: int = 40) -> str:
    """The clustering as plain rounds over all vectors, a CTE for each."""
    near = """a{k} AS MATERIALIZED (SELECT vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS b
FROM x, c{k} GROUP BY vec_id, v)"""
    mean = """c{k} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{j} o LEFT JOIN (
  SELECT c, list(f ORDER BY i) AS m FROM (SELECT c, i, CAST((s - ((s % n + n) % n)) / n AS BIGINT) AS f FROM (
    SELECT b.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{j}, range(1, 65) AS t(i) GROUP BY 1, 2)) GROUP BY c) n USING (c))"""
    steps = [
        "x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM x ORDER BY sha256('2:' || vec_id) LIMIT {clusters})",
    ]
    for k in range(rounds):
        steps += [near.format(k=k), mean.format(j=k, k=k + 1)]
    steps.append(near.format(k=rounds))
    last = f"""
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(m, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = b.c"""
    return "WITH " + ",\n".join(steps) + last


ORACLE: dict[str, str] = {
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
x AS (SELECT * FROM (SELECT doc_id, line, list_filter(regexp_split_to_array(t, '[\t\v\f\r ]+'), lambda y: y <> '') AS w FROM l) WHERE len(w) > 0),
d AS (SELECT w, min({'d': doc_id, 'l': line}) AS e FROM x GROUP BY w),
v AS (SELECT w, e, i, list_concat(w[1:i - 1], w[i + 1:]) AS r FROM (SELECT w, e, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= 5)),
near AS (
  SELECT w FROM (SELECT w, e, min(e) OVER (PARTITION BY i, r) AS m FROM v) WHERE m < e
  UNION SELECT v.w FROM v JOIN d ON d.w = v.r AND len(d.w) >= 5 WHERE d.e < v.e
  UNION SELECT d.w FROM v JOIN d ON d.w = v.r AND len(d.w) >= 5 WHERE v.e < d.e),
g AS (SELECT x.doc_id, x.line, d.e <> {'d': x.doc_id, 'l': x.line} OR near.w IS NOT NULL AS gone FROM x JOIN d USING (w) LEFT JOIN near USING (w))
SELECT documents.doc_id, coalesce(count(line), 0) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (gone), '') AS removed
FROM documents LEFT JOIN g USING (doc_id) GROUP BY 1""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS w, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT)) AS d FROM t),
f AS (SELECT *, len(w) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, CAST(coalesce(list_sum(w[1 : least(d[1] % (n + 1), d[2] % (n + 1))]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(w[1 : greatest(d[1] % (n + 1), d[2] % (n + 1))]), 0) AS BIGINT) AS b FROM f),
p AS (SELECT *, left(text, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
    "op13_centroid_clustering": _lloyd_sql(),
}
