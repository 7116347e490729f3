"""Queries over the given tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, compact_windows, drift_kmeans, exact_dedup, external_shuffle, host_rules, kmeans_tree, licenses, packing, prefix_join, quote_linking, spelling_variants, toxicity
from .common import table, text_or_empty


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = external_shuffle.external_shuffle(table(spark, sf_dir, "documents"), shards=16)
    text = text_or_empty(F.col("row.text"))
    return shuffled.select(
        F.col("row.doc_id").alias("doc_id"),
        external_shuffle.record_size(text).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(external_shuffle.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP4_SQL = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), k AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "start_word", "end_word", "other_id", "other_start_word", "other_end_word", "similarity", F.md5("passage").alias("passage_md5")
    )


def op6_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.similar_documents(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), reach AS (
    SELECT a AS doc_id, b AS other FROM link
    UNION
    SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    doc_id = F.col("row.doc_id")
    return toxicity.scored(docs, model).select(
        doc_id.alias("doc_id"),
        (toxicity.fold(doc_id) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_linking.linked_conversations(table(spark, sf_dir, "conversations"))


def op10_bitmap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encoded(docs, *vocabulary).select(F.col("row.doc_id").alias("doc_id"), "ids")
    return byte_bpe.decoded(ids, *vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op11_drift_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids, _ = drift_kmeans.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3)
    per = centroids.select(
        "cluster",
        "cluster_inertia",
        F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia"),
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )
    return assigned.join(F.broadcast(per), "cluster").select(  # 16 rows
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op11_sql() -> str:
    parts = """WITH kept AS (
    SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM (SELECT * FROM kept ORDER BY sha256('1:' || vec_id), v LIMIT 16))"""
    for i in range(4):
        parts += f""", d{i} AS (SELECT vec_id, v, j, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS d FROM kept, c{i}),
a{i} AS (SELECT vec_id, v, CAST(arg_min(j, d * 1000 + j) AS INTEGER) AS j, CAST(min(d) AS BIGINT) AS d FROM d{i} GROUP BY vec_id, v)"""
        if i < 3:
            parts += f""", m{i} AS (SELECT j, list(f ORDER BY pos) AS c FROM (SELECT j, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS f FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY j, pos) GROUP BY j),
c{i + 1} AS (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))"""
    return parts + """
SELECT a3.vec_id, a3.j AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY a3.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.j = a3.j"""


def op12_sorted_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.vocabulary(table(spark, sf_dir, "documents"), noise=97)
    return spelling_variants.grouped(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(table(spark, sf_dir, "documents"), host="source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {
    "op1_kmeans_tree": op1_kmeans_tree,
    "op2_external_shuffle": op2_external_shuffle,
    "op3_license_scan": op3_license_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_compact_windows": op5_compact_windows,
    "op6_grouped_prefix_join": op6_grouped_prefix_join,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_sum_of_squares": op8_sum_of_squares,
    "op9_quote_linking": op9_quote_linking,
    "op10_bitmap_bpe": op10_bitmap_bpe,
    "op11_drift_kmeans": op11_drift_kmeans,
    "op12_sorted_spelling": op12_sorted_spelling,
    "op13_host_rules": op13_host_rules,
}

ORACLE = {
    "op3_license_scan": licenses.oracle_sql(),
    "op4_exact_dedup": OP4_SQL,
    "op6_grouped_prefix_join": OP6_SQL,
    "op9_quote_linking": quote_linking.ORACLE_SQL,
    "op11_drift_kmeans": _op11_sql(),
    "op12_sorted_spelling": spelling_variants.oracle_sql(),
    "op13_host_rules": host_rules.oracle_sql(),
}
