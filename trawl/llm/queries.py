"""The queries opN_<name>: each operator over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import bpe, caps, chat, jaccard, kneser_ney, licences, packing, pitman_yor, repeats, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.classes(_table(spark, sf_dir, "embeddings"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return kneser_ney.score(docs, labels).select("doc_id", "lang", "n_words", "perplexity", "threshold", "keep")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), check=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.occurrences(_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


#: Links by joining n-grams themselves, classes by following links.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\x0b\\f]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest([list_aggregate(w[i:i+3], 'string_agg', ' ') FOR i IN range(1, greatest(len(w) - 2, 2))]) AS g
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), linked AS (
  SELECT doc_a, doc_b FROM shared JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b
  WHERE overlap / (x.n + y.n - overlap) >= 0.4
), reached AS (
  SELECT doc_id AS doc_a, doc_id AS doc_b FROM documents
  UNION
  SELECT r.doc_a, l.doc_b FROM reached r JOIN linked l ON r.doc_b = l.doc_a
)
SELECT r.doc_a AS doc_id, min(r.doc_b) AS class_id, (SELECT count(*) FROM linked l WHERE l.doc_a = r.doc_a) AS links
FROM reached r GROUP BY r.doc_a
"""

#: The same neighbours by all distances; the queries are the rows whose id is divisible by 20.
TOP_K_SQL = """
SELECT query_id, "rank", neighbour_id, round(d, 6) AS distance
FROM (
  SELECT query_id, neighbour_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS "rank"
  FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id,
      list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0
  )
)
WHERE "rank" <= 10
"""

#: Classes and links by all cosines.  The operator is approximate, but misses about one pair in e^8 at the threshold.
NEAR_VECTORS_SQL = """
WITH RECURSIVE linked AS (
  SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9
), reached AS (
  SELECT vec_id AS vec_a, vec_id AS vec_b FROM embeddings
  UNION
  SELECT r.vec_a, l.vec_b FROM reached r JOIN linked l ON r.vec_b = l.vec_a
)
SELECT r.vec_a AS vec_id, min(r.vec_b) AS class_id, (SELECT count(*) FROM linked l WHERE l.vec_a = r.vec_a) AS links
FROM reached r GROUP BY r.vec_a
"""

QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_licence_scan": op9_licence_scan,
    "op10_packing": op10_packing,
}
ORACLE: dict[str, str] = {"op1_embedding_near_dedup": NEAR_VECTORS_SQL, "op4_exact_top_k": TOP_K_SQL, "op8_ngram_jaccard_join": JACCARD_SQL}
