"""Queries of the problems tagged llm (p1, p7, p8, p9, p10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, knn, leakage, mojibake, terms
from ledgerloom.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "chunk_embeddings").filter("is_active = 1")
    return knn.similar_pairs(vectors, "embedding_id", "embedding").select(F.col("id_1").alias("embedding_id_1"), F.col("id_2").alias("embedding_id_2"))


def p1_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar of every vector whose id is divisible by 20, with the chunks that name them."""
    vectors = table(spark, sf, "chunk_embeddings").filter("is_active = 1")
    near = knn.top_k_search(vectors, vectors.filter("embedding_id % 20 = 0"), "embedding_id", "embedding")
    named = table(spark, sf, "chunk_metadata").filter("vector_id IS NOT NULL").select(F.col("vector_id").alias("neighbour"), "chunk_id").distinct()
    return near.join(named, "neighbour", "left").select(F.col("id").alias("embedding_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 9).alias("cosine"), "chunk_id")


def _term_counts(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "chunk_metadata").select("chunk_id", "text", "keyword", "loaded_at")
    return terms.marked(terms.term_counts(terms.once_per_record(raw, "chunk_id", ["text", "keyword"]), raw.select("text", "keyword")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _term_counts(spark, sf).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _term_counts(spark, sf)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.verbatim_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, sf, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_top5, p7_found, p7_counts, p8_ids, p9_found, p9_leaks, p10_found, p10_restored)}

SQL: dict[str, str] = {
    "p1_top5": """
WITH v AS (SELECT embedding_id AS id, any_value(embedding) AS e FROM chunk_embeddings WHERE is_active = 1 AND embedding_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
u AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM v),
c AS (SELECT q.id, o.id AS other, list_sum(list_transform(range(1, 65), lambda i: q.e[i]::DOUBLE * o.e[i]::DOUBLE)) / (q.n * o.n) AS cosine FROM u q JOIN u o ON q.id % 20 = 0 AND o.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, other) AS rank FROM c)
SELECT id AS embedding_id, rank::INT AS rank, other AS neighbour_id, round(cosine, 9) AS cosine, chunk_id
FROM r LEFT JOIN (SELECT DISTINCT vector_id, chunk_id FROM chunk_metadata WHERE vector_id IS NOT NULL) m ON m.vector_id = r.other WHERE rank <= 5"""
}
