"""The corpus operators as queries over whole tables: each takes (spark, sf_dir) and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import bpe, fingerprints, language, lm, mixing, ngram_join, pii, quality, sharding, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: exact matches and what weak supervision adds."""
    return pii.find(_documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of the text decoded from them."""
    out = bpe.encode(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document by single words and by the log-bilinear model."""
    return lm.score_documents(_documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.compare_with_next(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document through a digest cache that starts empty."""
    return token_counts.count_tokens(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by a Feistel permutation of its row number."""
    return sharding.shard_documents(_documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.near_duplicates(_documents(spark, sf_dir), width=3, similarity=(90, 100))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, votes and verdict for every document."""
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(_documents(spark, sf_dir)).select(*base, "p_good")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.size("ranges").alias("n_ranges"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's last stage over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(doc_id, root) AS (SELECT DISTINCT x, x FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in (op1_pii, op2_language, op3_bpe, op4_lm_scoring, op5_fingerprints, op6_token_counts, op7_sharding, op8_ngram_join, op9_quality_rules, op10_mixing, pipeline)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express. The others are held against plain Python in tests/llm."""
    return {"op8_ngram_join": NGRAM_JOIN}
