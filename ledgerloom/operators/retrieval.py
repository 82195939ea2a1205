"""Exact vector search, lexical search and evidence selection.

A search has few queries and many candidates: the queries are broadcast in blocks
of about ``MAX_QUERIES``, candidates are scanned once a block, filtered before they
are scored, and a top-k per query leaves every task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.ranking import top_per_group

MAX_QUERIES = 1000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """All queries, cut by a hash of their id into blocks ready to broadcast."""
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    return [F.broadcast(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)) for b in range(blocks)]


def cosine_scores(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Every other row with its score for every query (query_id, query_vector), without the vectors."""
    parts = [vectors.join(part).filter(F.col(id_column) != F.col("query_id")).withColumn("score", dot(F.col(vector_column), F.col("query_vector"))).drop("query_vector", vector_column) for part in query_blocks(queries)]
    return reduce(DataFrame.unionByName, parts)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int, group: list[str] | None = None) -> DataFrame:
    """The k most similar rows of every query (query_id, query_vector), ties by id; per group if given."""
    scored = cosine_scores(vectors, queries, id_column, vector_column)
    return top_per_group(scored, ["query_id", *(group or [])], [F.desc("score"), F.col(id_column)], k)


#: Hits a scoped search may ask for.
MAX_HITS = 40


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """One row per id of the vectors that have ``dim`` finite numbers, not all zero: id_column, vector_column."""
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.filter(F.col(id_column).isNotNull() & (F.size(vector_column) == dim) & finite & F.exists(vector_column, lambda x: x != 0))
    return good.groupBy(id_column).agg(F.min_by(vector_column, F.xxhash64(vector_column)).alias(vector_column))


def scoped_search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, scope: list[str], vector_id: str = "vector_id", vector: str = "embedding") -> DataFrame:
    """The k chunks of every scope that are most similar to each query, with the scope's coverage.

    ``chunks`` has chunk_id, ``vector_id`` and the scope's columns, ``vectors`` the
    usable vectors by ``vector_id``, ``queries`` query_id and query_vector.  Chunks
    are filtered before they are scored; ``searchable`` and ``covered`` count the
    scope's chunks and those with a vector.  ``k`` must be between 1 and MAX_HITS.
    """
    if not 1 <= k <= MAX_HITS:
        raise ValueError(f"k must be between 1 and {MAX_HITS}")
    held = chunks.select("chunk_id", *scope, vector_id).join(vectors.select(vector_id, vector), vector_id, "left")
    coverage = held.groupBy(*scope).agg(F.count(F.lit(1)).alias("searchable"), F.count(vector).alias("covered"))
    there = held.filter(F.col(vector).isNotNull()).withColumn("_n", norm(F.col(vector)))
    asked = [part.withColumn("_q", norm(F.col("query_vector"))) for part in query_blocks(queries)]
    scored = [there.join(F.broadcast(part)).select("query_id", *scope, "chunk_id", (dot(F.col(vector), F.col("query_vector")) / (F.col("_n") * F.col("_q"))).alias("score")) for part in asked]
    found = reduce(DataFrame.unionByName, scored).withColumn("score", F.round("score", 9))
    return top_per_group(found, ["query_id", *scope], [F.desc("score"), F.col("chunk_id")], k).join(coverage, scope)


def vector_contract(vectors: DataFrame, id_column: str, vector_column: str, dim: int, tolerance: float = 2e-3) -> DataFrame:
    """One row of counts: rows, distinct ids, wrong shapes, not finite, not of unit length."""
    v = F.col(vector_column)
    bad_shape = v.isNull() | (F.size(v) != dim)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.when(~bad_shape & finite, norm(v))
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(id_column).alias("ids"),
        F.count_if(bad_shape).alias("wrong_shape"),
        F.count_if(~bad_shape & ~finite).alias("not_finite"),
        F.count_if(F.abs(length - 1) > tolerance).alias("not_unit"),
    )


def clean_query(text: Column, names: list[str], year: int | None) -> Column:
    """A query without the candidates' company names and a single year, white space collapsed, at most 8,000 characters."""
    out = text
    for name in names:
        out = F.replace(out, F.lit(name), F.lit(" "))
    if year is not None:
        out = F.regexp_replace(out, f"{year}년?", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, 8000)


def lexical_score(text: Column, terms: list[tuple[str, ...]]) -> Column:
    """Sum over terms of min(5, occurrences of any alias), over the number of terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for aliases in terms:
        hits = F.lit(0)
        for a in aliases:
            hits = hits + (F.length(low) - F.length(F.replace(low, F.lit(a.lower()), F.lit("")))) / F.lit(len(a))
        total = total + F.least(F.lit(5.0), hits)
    return total / len(terms)


def lexical_top_k(rows: DataFrame, text: str, terms: list[tuple[str, ...]], id_column: str, k: int) -> DataFrame:
    return rows.withColumn("score", lexical_score(F.col(text), terms)).filter("score > 0").orderBy(F.desc("score"), id_column).limit(k)


def topic_evidence(scored: DataFrame, scope: list[str], limit: int, topics: int) -> DataFrame:
    """Per scope: the best k = max(1, limit // topics) of every topic, united by chunk in first-seen order, capped at the limit.

    Needs topic (an ordinal), chunk_id and score.
    """
    per = top_per_group(scored, [*scope, "topic"], [F.desc("score"), F.col("chunk_id")], max(1, limit // topics), "_r")
    seen = per.groupBy(*scope, "chunk_id").agg(F.min(F.struct("topic", "_r")).alias("_o"), F.max("score").alias("score"))
    return top_per_group(seen, scope, [F.col("_o"), F.col("chunk_id")], limit, "position").drop("_o")


def thin_evidence(rows: DataFrame, scope: list[str], latest: int) -> DataFrame:
    """Two rows per scope in the latest year, one in earlier ones, by chunk id."""
    w = Window.partitionBy(*scope).orderBy("chunk_id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.when(F.col("year") == latest, 2).otherwise(1)).drop("_n")


def historical_anchors(rows: DataFrame, scopes: DataFrame, most: int = 4) -> DataFrame:
    """For up to ``most`` (company, type) scopes the best row of the year before."""
    # a top-k of every task and one of those, no window
    few_scopes = scopes.orderBy("corp_code", "report_type").limit(most)
    wanted = few_scopes.select("corp_code", "report_type", (F.col("year") - 1).alias("year"))
    # at most ``most`` rows
    hits = rows.join(F.broadcast(wanted), ["corp_code", "report_type", "year"], "left_semi")
    return top_per_group(hits, ["corp_code", "report_type"], [F.desc("score"), F.col("chunk_id")], 1).drop("rank")


def adjacent_context(text: Column, start: Column, end: Column, width: int = 120) -> Column:
    """The characters before and after a span of a text (0-based, end exclusive)."""
    low = F.greatest(F.lit(0), start - width)
    return F.struct(F.substring(text, low + 1, start - low).alias("before"), F.substring(text, end + 1, F.lit(width)).alias("after"))
