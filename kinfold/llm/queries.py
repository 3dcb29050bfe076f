"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import graph, lines, mixing, packing, passages, quality, quantise, secrets, simhash, tokens
from kinfold.sources.tables import table

VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), size=1024)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(table(spark, sf_dir, "documents"), least_chars=20, least_docs=3))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_near_vectors": op6_near_vectors,
    "op7_line_dedup": op7_line_dedup,
    "op8_passages": op8_passages,
    "op9_nearest": op9_nearest,
    "op10_simhash": op10_simhash,
}

#: Operators whose results SQL can state; the others are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_near_vectors": """
WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.98 * a.n * b.n),
  reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
  c AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
  k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM u LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op7_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, unnest(range(1, len(lines) + 1)) AS t(i)),
  h AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key),
  x AS (SELECT l.doc_id, i, line, coalesce(n >= 3 AND l.doc_id <> top, false) AS gone FROM l LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id""",
}
