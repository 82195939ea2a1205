"""Keyword signals and retrieval (K, V and their top-k windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import ranking as rk
from ledgerloom.operators import retrieval as rt
from ledgerloom.operators import signals as sg
from ledgerloom.plans import base as b
from ledgerloom.plans.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.queries, R.sql
YEARS = [2022, 2023, 2024, 2025]
r6 = lambda c: F.round(c, 6)

# Keywords of the listed keyword field: one row per chunk and keyword.
_KW = b.SQL_CHUNKS + ", kw AS (SELECT DISTINCT chunk_id, corp_code, year, report_type, section_name, trim(unnest(string_split(keyword, ',')), ' ') AS keyword FROM chunks WHERE keyword IS NOT NULL), hits AS (SELECT * FROM kw WHERE keyword <> '')"


def hits(t: Tables) -> DataFrame:
    w = F.array_distinct(F.transform(F.split("keyword", ",", -1), lambda x: F.trim(x)))
    c = b.chunks(t, "keyword", "corp_code", "year", "report_type", "section_name").filter("keyword IS NOT NULL")
    return c.select("chunk_id", "corp_code", "year", "report_type", "section_name", F.explode(w).alias("keyword")).filter("keyword <> ''")


def year_rates(t: Tables) -> DataFrame:
    totals = b.chunks(t, "year").groupBy("year").agg(F.count(F.lit(1)).alias("total"))
    return sg.mention_rates(hits(t), totals, ["year"])


def comparable_change(t: Tables) -> DataFrame:
    counts = hits(t).groupBy("keyword", "year", "report_type").agg(F.count(F.lit(1)).alias("df"))
    totals = b.chunks(t, "year", "report_type").groupBy("year", "report_type").agg(F.count(F.lit(1)).alias("total"))
    return sg.comparable_change(counts, totals, YEARS)


def spread(t: Tables) -> DataFrame:
    totals = b.chunks(t, "corp_code", "year").filter("year = 2025 AND corp_code IS NOT NULL").groupBy("corp_code").agg(F.count(F.lit(1)).alias("total"))
    per = sg.mention_rates(hits(t).filter("year = 2025 AND corp_code IS NOT NULL"), totals, ["corp_code"])
    # one row: the number of companies
    size = totals.agg(F.count(F.lit(1)).alias("of"))
    return sg.sector_spread(per.join(F.broadcast(size)), F.col("of"))


def sector_scores(t: Tables) -> DataFrame:
    """The sector signal in its order: counts, change, spread, noise, percentiles, penalties, rank."""
    now = year_rates(t).filter("year = 2025").select("keyword", F.col("df").alias("current")).filter("current >= 2")
    change = comparable_change(t)
    rows = now.join(change, "keyword").join(spread(t).filter("companies >= 2"), "keyword").withColumn("sector", F.lit("all"))
    # ranks must not hang on the last digit of a sum, which follows its order
    rows = rows.withColumns({"change_raw": F.round("change_raw", 9), "spread": F.round("spread", 9)})
    return sg.suppress_components(sg.signal_scores(rows, ["sector"]), ["sector"], ["재고"])


@R.add("K1_canonical_keywords", None)
def k1(t: Tables) -> DataFrame:
    v = sg.Vocabulary(aliases={"hbm": "고대역폭메모리"})
    return sg.extract_keywords(b.chunks(t, "text", "year"), v).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@R.add("K2_masked_patterns", None)
def k2(t: Tables) -> DataFrame:
    v = sg.Vocabulary(compounds=("온실가스 배출량", r"현금및현금성자산", r"연구개발 조직"))
    return sg.extract_keywords(b.chunks(t, "text"), v).filter(F.col("keyword").isin("온실가스 배출량", "온실가스", "배출량")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@R.add("K3_words_and_pairs", None)
def k3(t: Tables) -> DataFrame:
    return sg.extract_keywords(b.chunks(t, "text", "corp_code")).filter(F.col("keyword").contains(" ")).groupBy("keyword").agg(F.count_distinct("corp_code").alias("companies"), F.count(F.lit(1)).alias("n"))


# The classes written out once more for SQL, in their order of precedence.
_NOISE = """CASE WHEN regexp_matches(keyword, '^(?:USD|JPY|KRW|EUR|CNY|GBP|CHF|CAD|AUD|HKD|SGD)$') OR regexp_matches(keyword, '환율|환산|외화|원화|통화위험') THEN '통화/환율'
  WHEN regexp_matches(keyword, '전년|전기|전분기|전월|당기|동기|전년도|기간 대비') THEN '기간 비교' WHEN regexp_matches(keyword, '업계 최초|세계 최초|국내 최초|최고 수준|업계 최고|경쟁 우위') THEN '홍보·수식'
  WHEN regexp_matches(keyword, '재고 자산|매출액|재무|회계|충당금|감가상각|장부가액|보고기간') THEN '회계·보고서 관용'
  WHEN regexp_matches(keyword, '(?:기업\\s*공시|공시)\\s*서식|서식\\s*(?:작성|기준)|기재\\s*(?:예정|생략)|(?:분\\s*[ㆍ·ᆞ]\\s*반기|분반기)|분석\\s*의견') THEN '공시 메타'
  WHEN regexp_matches(keyword, '(?i)\\b(?:comprising|thereof|wherein)\\b|\\b(?:inhibitors?|compositions?)\\s+and\\s+methods?\\b') THEN '특허 법률 문구'
  WHEN regexp_matches(keyword, '^(?:기존\\s*대비|기저\\s*효과)$') OR regexp_matches(keyword, '^[가-힣]+(?:특별시|광역시|특별자치시|특별자치도|도|시|군|구)\\s*소재$') THEN '문서성 표현'
  WHEN regexp_matches(keyword, '부가 가치|자금 조달|수주 상황|경영 전략|사업 계획') THEN '일반 경영' END"""
# Headings and report names are candidates too: they hold the classes that the keyword field lacks.
_WORDS = f"{_KW}, words AS (SELECT DISTINCT keyword FROM hits UNION SELECT DISTINCT regexp_replace(section_name, '^[IVX]+\\. ', '') FROM chunks WHERE section_name IS NOT NULL UNION SELECT DISTINCT regexp_replace(subsection_name, '^[0-9]+\\. ', '') FROM chunks WHERE subsection_name IS NOT NULL)"


@R.add("K5_noise_classes", f"WITH {_WORDS}, n AS (SELECT keyword, {_NOISE} AS noise FROM words) SELECT keyword, noise, noise IS NOT NULL AND noise NOT IN ('홍보·수식', '일반 경영') AS dropped, CASE WHEN noise = '일반 경영' THEN 2.0 ELSE 0.0 END::DOUBLE AS penalty FROM n")
def k5(t: Tables) -> DataFrame:
    c = b.chunks(t, "section_name", "subsection_name")
    heading = lambda c_, p: c.filter(F.col(c_).isNotNull()).select(F.regexp_replace(c_, p, "").alias("keyword"))
    words = hits(t).select("keyword").unionByName(heading("section_name", r"^[IVX]+\. ")).unionByName(heading("subsection_name", r"^[0-9]+\. ")).distinct()
    noise = sg.noise_class(F.col("keyword"))
    return words.select("keyword", noise.alias("noise")).select("keyword", "noise", sg.is_dropped(F.col("noise")).alias("dropped"), sg.noise_penalty(F.col("noise")).alias("penalty"))


@R.add("K6_mention_rate", f"WITH {_KW}, yt AS (SELECT year, count(*) AS total FROM chunks GROUP BY 1) SELECT keyword, year, count(*) AS df, round(count(*) / any_value(total), 9) AS rate FROM hits JOIN yt USING (year) GROUP BY 1, 2")
def k6(t: Tables) -> DataFrame:
    return year_rates(t).select("keyword", "year", "df", F.round("rate", 9).alias("rate"))


# Completed years whole, the newest only on the report types that it shares with the year before; comparisons without chunks are skipped.
_CHANGE = """ty AS (SELECT report_type FROM chunks WHERE report_type IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (year = 2024) > 0 AND count(*) FILTER (year = 2025) > 0),
tt AS (SELECT count(*) FILTER (year = 2022)::DOUBLE AS t2, count(*) FILTER (year = 2023)::DOUBLE AS t3, count(*) FILTER (year = 2024)::DOUBLE AS t4,
  count(*) FILTER (year = 2024 AND report_type IN (FROM ty))::DOUBLE AS p, count(*) FILTER (year = 2025 AND report_type IN (FROM ty))::DOUBLE AS l FROM chunks),
ky AS (SELECT keyword, count(*) FILTER (year = 2022) AS n2, count(*) FILTER (year = 2023) AS n3, count(*) FILTER (year = 2024) AS n4,
  count(*) FILTER (year = 2024 AND report_type IN (FROM ty)) AS np, count(*) FILTER (year = 2025 AND report_type IN (FROM ty)) AS nl FROM hits GROUP BY 1),
dl AS (SELECT keyword, list_filter([n3 / nullif(t3, 0) - n2 / nullif(t2, 0), n4 / nullif(t4, 0) - n3 / nullif(t3, 0), nl / nullif(l, 0) - np / nullif(p, 0)], lambda x: x IS NOT NULL) AS d FROM ky, tt),
ch AS (SELECT keyword, CASE len(d) WHEN 0 THEN 0 WHEN 1 THEN d[1] WHEN 2 THEN d[1] * 0.4 + d[2] * 0.6 ELSE (d[1] * 0.4 + d[2] * 0.6) * 0.4 + d[3] * 0.6 END AS change_raw FROM dl)"""


@R.add("K7_change_blend", f"WITH {_KW}, {_CHANGE} SELECT keyword, round(change_raw, 9) AS change_raw FROM ch")
def k7(t: Tables) -> DataFrame:
    return comparable_change(t).select("keyword", F.round("change_raw", 9).alias("change_raw"))


_SPREAD = "ct AS (SELECT corp_code, count(*)::DOUBLE AS total FROM chunks WHERE year = 2025 AND corp_code IS NOT NULL GROUP BY 1), cd AS (SELECT keyword, corp_code, count(*)::DOUBLE AS df, any_value(total) AS total, (SELECT count(*) FROM ct) AS of FROM hits JOIN ct USING (corp_code) WHERE year = 2025 GROUP BY 1, 2), cp AS (SELECT *, (df / total) / sum(df / total) OVER (PARTITION BY keyword) AS p FROM cd), sp AS (SELECT keyword, count(*) AS companies, max(df) / sum(df) AS max_share, greatest(0, least(100, -sum(p * ln(p)) / ln(max(of)) * 100)) AS entropy, count(*) / max(of) * 100 AS coverage FROM cp GROUP BY 1)"


@R.add("K8_sector_spread", f"WITH {_KW}, {_SPREAD} SELECT keyword, companies, round(0.6 * coverage + 0.4 * entropy, 6) AS spread, round(max_share, 6) AS max_share FROM sp")
def k8(t: Tables) -> DataFrame:
    return spread(t).select("keyword", "companies", r6("spread").alias("spread"), r6("max_share").alias("max_share"))


_P = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / count(*) OVER () * 100"
#: The whole sector signal in SQL: counts, change, spread, noise, percentiles, penalties, rank, suppression.
SQL_SECTOR = f"""{_KW}, {_CHANGE}, {_SPREAD}, nw AS (SELECT keyword, count(*) AS current FROM hits WHERE year = 2025 GROUP BY 1 HAVING count(*) >= 2),
rw AS (SELECT keyword, current, round(change_raw, 9) AS change_raw, companies, max_share, round(0.6 * coverage + 0.4 * entropy, 9) AS spread, {_NOISE} AS noise FROM nw JOIN ch USING (keyword) JOIN sp USING (keyword) WHERE companies >= 2),
kept AS (SELECT * FROM rw WHERE noise IS NULL OR noise IN ('홍보·수식', '일반 경영')),
pc AS (SELECT *, {_P.format("current")} AS current_score, {_P.format("change_raw")} AS change_score, {_P.format("spread")} AS spread_score FROM kept),
sg AS (SELECT *, 0.5 * current_score + 0.3 * change_score + 0.2 * spread_score AS signal, least(15.0, greatest(0.0, (max_share - 0.5) * 30)) + CASE WHEN noise = '일반 경영' THEN 2.0 ELSE 0.0 END AS penalty FROM pc),
rk AS (SELECT *, signal - penalty AS final_score, row_number() OVER (ORDER BY signal - penalty DESC, keyword)::INT AS final_rank FROM sg),
sector AS (SELECT * FROM rk WHERE NOT (keyword IN ('재고') AND keyword IN (SELECT unnest(string_split(keyword, ' ')) FROM rk WHERE contains(keyword, ' ')))),
cloud AS (SELECT *, min(final_score) OVER () AS lo, max(final_score) OVER () AS hi, count(*) OVER () AS size FROM sector WHERE final_rank <= 30),
wt AS (SELECT *, CASE WHEN size = 1 THEN 100.0 WHEN hi > lo THEN 30 + 70 * (0.7 * ((final_score - lo) / (hi - lo)) * ((final_score - lo) / (hi - lo)) + 0.3 * (1 - (final_rank - 1) / (size - 1))) ELSE 30 + 70 * (1 - (final_rank - 1) / (size - 1)) END AS weight FROM cloud),
hot AS (SELECT keyword FROM sector WHERE final_rank <= 30 AND change_score >= 90 AND change_raw > 0 ORDER BY change_raw DESC, change_score DESC, final_score DESC, final_rank, keyword LIMIT 3)"""


@R.add("K9_signal", f"WITH {SQL_SECTOR} SELECT keyword, round(signal, 6)::DOUBLE AS signal, round(penalty, 6)::DOUBLE AS penalty, round(final_score, 6)::DOUBLE AS final_score, final_rank FROM sector")
def k9(t: Tables) -> DataFrame:
    return sector_scores(t).select("keyword", r6("signal").alias("signal"), r6("penalty").alias("penalty"), r6("final_score").alias("final_score"), "final_rank")


@R.add("K10_component_drop", None)
def k10(t: Tables) -> DataFrame:
    e = sg.extract_keywords(b.chunks(t, "text", "year").filter("year = 2025")).groupBy("year", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return sg.suppress_components(e, ["year"], ["설비", "환경", "수요"])


@R.add("K11_company_concentration", f"WITH {_KW} SELECT keyword, corp_code, count(*) AS n FROM hits WHERE year = 2025 AND keyword IN (SELECT keyword FROM hits WHERE year = 2025 GROUP BY 1 ORDER BY count(*) DESC, keyword LIMIT 10) GROUP BY 1, 2")
def k11(t: Tables) -> DataFrame:
    h = hits(t).filter("year = 2025")
    top = h.groupBy("keyword").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "keyword").limit(10).select("keyword")
    return h.join(F.broadcast(top), "keyword").groupBy("keyword", "corp_code").agg(F.count(F.lit(1)).alias("n"))


@R.add("K18_spelling_merge", f"WITH {_KW}, n AS (SELECT keyword, count(*) AS n FROM hits GROUP BY 1), k AS (SELECT *, lower(regexp_replace(keyword, '[\\s\\-_/·.&+]', '', 'g')) AS key, length(regexp_replace(keyword, '[^A-Z]', '', 'g')) AS capitals FROM n) SELECT key, arg_max(keyword, (n, capitals, length(keyword), keyword)) AS keyword, sum(n)::BIGINT AS n FROM k GROUP BY 1")
def k18(t: Tables) -> DataFrame:
    n = hits(t).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit(0))
    return sg.merge_spellings(n, ["scope"]).drop("scope")


_SIGN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[‐-―]', '-', 'g'), '[‘’“”\"]', chr(39), 'g'), '[0-9][0-9.,]*', '#', 'g'), '\\s+', ' ', 'g'))"
_PLAIN = "regexp_full_match(text, '[ -~가-힣\\s]*')"


# NFKC is not in SQL: compared are the chunks whose text it leaves as it is
@R.add("K21_context_diversity", f"""WITH {_KW}, x AS (SELECT chunk_id, {_SIGN} AS context FROM chunks WHERE text IS NOT NULL AND {_PLAIN}), st AS (SELECT chunk_id, list(DISTINCT keyword ORDER BY keyword) AS cooc FROM hits GROUP BY 1),
d AS (SELECT keyword, count(DISTINCT chunk_id) AS n, count(DISTINCT context) AS contexts, count(DISTINCT cooc) AS sets FROM hits JOIN x USING (chunk_id) JOIN st USING (chunk_id) GROUP BY 1),
a AS (SELECT keyword, n, contexts / n AS c2, sets / n AS c3, least(1.0, n / 10.0)::DOUBLE AS support, round((contexts / n * 0.4 + sets / n * 0.6) * least(1.0, n / 10.0), 9)::DOUBLE AS adjusted FROM d)
SELECT keyword, n, round(c2, 9) AS c2, round(c3, 9) AS c3, support, adjusted, round({_P.format("adjusted")}, 6)::DOUBLE AS score FROM a""")
def k21(t: Tables) -> DataFrame:
    texts = b.chunks(t, "text").filter("text IS NOT NULL").filter(F.col("text").rlike("^[ -~가-힣\\s]*\\z"))
    d = sg.context_diversity(hits(t).select("keyword", "chunk_id"), texts).withColumn("adjusted", F.round("adjusted", 9))
    return d.select("keyword", "n", F.round("c2", 9).alias("c2"), F.round("c3", 9).alias("c3"), "support", "adjusted", r6(rk.percentile_score(F.col("adjusted"), [])).alias("score"))


_FILED = "fd AS (SELECT corp_code, regexp_replace(rcept_no, '[^0-9]', '', 'g') AS r, max(rcept_dt) AS dt FROM filings WHERE corp_code IS NOT NULL GROUP BY 1, 2)"


@R.add("K23_related_filings", f"""WITH {b.SQL_CHUNKS}, {_FILED}, m AS (SELECT corp_code, regexp_replace(rcept_no, '[^0-9]', '', 'g') AS r, len(regexp_extract_all(lower(nfc_normalize(text)), '온실가스\\s*배출량|특허권')) AS n FROM chunks WHERE text IS NOT NULL AND corp_code IS NOT NULL),
g AS (SELECT m.corp_code, m.r, sum(n)::BIGINT AS mentions, any_value(dt) AS dt FROM m JOIN fd ON m.corp_code = fd.corp_code AND m.r = fd.r WHERE n > 0 GROUP BY 1, 2)
SELECT DISTINCT ON (corp_code) corp_code, mentions, r AS rcept_no FROM g ORDER BY corp_code, mentions DESC, dt DESC NULLS LAST, r DESC""")
def k23(t: Tables) -> DataFrame:
    c = b.chunks(t, "corp_code", "rcept_no", "text").filter("corp_code IS NOT NULL").withColumn("rcept_no", F.regexp_replace("rcept_no", "[^0-9]", ""))
    d = t.filings.filter("corp_code IS NOT NULL").select("corp_code", F.regexp_replace("rcept_no", "[^0-9]", "").alias("rcept_no"), "rcept_dt")
    return sg.related_filings(c, d, "온실가스 배출량", {"특허권": "온실가스  배출량"})


@R.add("K24_wordcloud_items", f"WITH {SQL_SECTOR} SELECT keyword AS text, round(weight, 6)::DOUBLE AS weight, keyword IN (FROM hot) AS hot, current AS count, round(final_score, 6)::DOUBLE AS score FROM wt")
def k24(t: Tables) -> DataFrame:
    top = sector_scores(t).filter("final_rank <= 30")
    w = rk.hot_flags(top.withColumn("weight", rk.display_weight(F.col("final_score"), F.col("final_rank"), ["sector"])), ["sector"], 30)
    return w.select(F.col("keyword").alias("text"), r6("weight").alias("weight"), "hot", F.col("current").alias("count"), r6("final_score").alias("score"))


# Retrieval

_Q = "q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), sc AS (SELECT query_id, vec_id, label, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * q.qv[i]::DOUBLE)) AS score FROM embeddings e, q WHERE vec_id <> query_id)"


def every_20th(t: Tables) -> DataFrame:
    """The whole query set: every id divisible by 20."""
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@R.add("V2_cosine_top_k", f"WITH {_Q} SELECT query_id, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc) WHERE rank <= 5")
def v2(t: Tables) -> DataFrame:
    return rt.cosine_top_k(t.embeddings, every_20th(t), "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")


@R.add("V2_cosine_top_k_by_group", f"WITH {_Q} SELECT query_id, label, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc) WHERE rank <= 2")
def v2g(t: Tables) -> DataFrame:
    return rt.cosine_top_k(t.embeddings, every_20th(t), "vec_id", "embedding", 2, ["label"]).select("query_id", "label", "vec_id", "rank")


@R.add("J16_cosine_cross", f"WITH {_Q} SELECT query_id, vec_id, round(score, 6) AS score FROM sc")
def j16(t: Tables) -> DataFrame:
    # the query set against all rows, in broadcast blocks
    return rt.cosine_scores(t.embeddings, every_20th(t), "vec_id", "embedding").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@R.add("V3_vector_contract", "WITH e AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM embeddings) SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS wrong_shape, 0::BIGINT AS not_finite, count(*) FILTER (abs(len - 1) > 0.002) AS not_unit FROM e")
def v3(t: Tables) -> DataFrame:
    return rt.vector_contract(t.embeddings, "vec_id", "embedding", 64)


@R.add("V1_query_cleaning", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, left(trim(regexp_replace(regexp_replace(replace(text, '당사', ' '), '2024년?', ' ', 'g'), '\\s+', ' ', 'g')), 8000) AS q FROM chunks WHERE text IS NOT NULL AND regexp_full_match(text, '[ -~가-힣]*')")
def v1(t: Tables) -> DataFrame:
    rows = b.chunks(t, "text").filter(F.col("text").rlike("^[ -~가-힣]*\\z"))
    return rows.select("chunk_id", rt.clean_query(F.col("text"), ["당사"], 2024).alias("q"))


TERMS = [("설비", "장비"), ("특허",), ("온실가스",)]
_LEX = "lx AS (SELECT chunk_id, (least(5, (length(lower(text)) - length(replace(lower(text), '설비', ''))) / 2 + (length(lower(text)) - length(replace(lower(text), '장비', ''))) / 2) + least(5, (length(lower(text)) - length(replace(lower(text), '특허', ''))) / 2) + least(5, (length(lower(text)) - length(replace(lower(text), '온실가스', ''))) / 4)) / 3 AS score FROM chunks WHERE text IS NOT NULL)"


@R.add("V5_lexical_score", f"WITH {b.SQL_CHUNKS}, {_LEX} SELECT chunk_id, round(score, 6)::DOUBLE AS score FROM lx")
def v5(t: Tables) -> DataFrame:
    return b.chunks(t, "text").filter("text IS NOT NULL").select("chunk_id", F.round(rt.lexical_score(F.col("text"), TERMS), 6).alias("score"))


@R.add("W18_lexical_top_k", f"WITH {b.SQL_CHUNKS}, {_LEX} SELECT chunk_id, round(score, 6)::DOUBLE AS score FROM lx WHERE score > 0 ORDER BY lx.score DESC, chunk_id LIMIT 25")
def w18(t: Tables) -> DataFrame:
    return rt.lexical_top_k(b.chunks(t, "text"), "text", TERMS, "chunk_id", 25).select("chunk_id", F.round("score", 6).alias("score"))


_VEC = """vecs AS (SELECT embedding_id AS vector_id, any_value(embedding) AS embedding FROM chunk_embeddings WHERE is_active = 1 AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
lens AS (SELECT vector_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM vecs)"""
_COS = "round(list_sum(list_transform(range(1, 65), lambda i: h.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) / (h.len * q.len), 9)"
_SCOPE = "sc AS (SELECT chunk_id, corp_code, year, vector_id FROM chunks WHERE is_active = 1 AND is_searchable = 1 AND corp_code IS NOT NULL AND year = 2024), cov AS (SELECT corp_code, count(*) AS searchable, count(l.vector_id) AS covered FROM sc LEFT JOIN lens l USING (vector_id) GROUP BY 1)"


def searchable(t: Tables) -> DataFrame:
    return b.chunks(t, "corp_code", "year", "vector_id", "is_active", "is_searchable").filter("is_active = 1 AND is_searchable = 1 AND corp_code IS NOT NULL AND year = 2024")


def chunk_vectors(t: Tables) -> DataFrame:
    return rt.usable_vectors(t.chunk_embeddings.filter("is_active = 1").withColumnRenamed("embedding_id", "vector_id"), "vector_id", "embedding", 64)


@R.add("V6_scoped_search", f"WITH {b.SQL_CHUNKS}, {_VEC}, {_SCOPE}, f AS (SELECT q.vector_id AS query_id, sc.chunk_id, corp_code, {_COS} AS score FROM sc JOIN lens h USING (vector_id), lens q WHERE q.vector_id % 20 = 0 AND corp_code = '00000990'), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score, searchable, covered FROM r JOIN cov USING (corp_code) WHERE rank <= 10")
def v6(t: Tables) -> DataFrame:
    """For every query vector the ten nearest chunks of one company's year."""
    vectors = chunk_vectors(t)
    queries = vectors.filter("vector_id % 20 = 0").select(F.col("vector_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits_ = rt.scoped_search(searchable(t).filter("corp_code = '00000990'"), vectors, queries, 10, ["corp_code"])
    return hits_.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "searchable", "covered")


def topic_scores(t: Tables) -> DataFrame:
    c = b.chunks(t, "text", "corp_code", "year", "report_type").filter("text IS NOT NULL AND corp_code IS NOT NULL")
    scores = F.array(*(F.struct(F.lit(i).alias("topic"), rt.lexical_score(F.col("text"), [x]).alias("score")) for i, x in enumerate(TERMS)))
    return c.select("corp_code", "year", "report_type", "chunk_id", F.inline(scores)).filter("score > 0")


_TOPICS = "tp AS (SELECT corp_code, year, report_type, chunk_id, 0 AS topic, least(5, (length(lower(text)) - length(replace(lower(text), '설비', ''))) / 2 + (length(lower(text)) - length(replace(lower(text), '장비', ''))) / 2) AS score FROM chunks WHERE text IS NOT NULL AND corp_code IS NOT NULL UNION ALL SELECT corp_code, year, report_type, chunk_id, 1, least(5, (length(lower(text)) - length(replace(lower(text), '특허', ''))) / 2) FROM chunks WHERE text IS NOT NULL AND corp_code IS NOT NULL UNION ALL SELECT corp_code, year, report_type, chunk_id, 2, least(5, (length(lower(text)) - length(replace(lower(text), '온실가스', ''))) / 4) FROM chunks WHERE text IS NOT NULL AND corp_code IS NOT NULL), tr AS (SELECT *, row_number() OVER (PARTITION BY corp_code, year, report_type, topic ORDER BY score DESC, chunk_id) AS r FROM tp WHERE score > 0), ts AS (SELECT corp_code, year, report_type, chunk_id, min((topic, r)) AS o FROM tr WHERE r <= 2 GROUP BY 1, 2, 3, 4), te AS (SELECT *, row_number() OVER (PARTITION BY corp_code, year, report_type ORDER BY o, chunk_id) AS position FROM ts)"


@R.add("W9_topic_evidence", f"WITH {b.SQL_CHUNKS}, {_TOPICS} SELECT corp_code, year, report_type, chunk_id, position::INT AS position FROM te WHERE position <= 6")
def w9(t: Tables) -> DataFrame:
    e = rt.topic_evidence(topic_scores(t), ["corp_code", "year", "report_type"], 6, 3)
    return e.select("corp_code", "year", "report_type", "chunk_id", "position")


R.add("V7_topic_evidence", SQL["W9_topic_evidence"])(w9)


@R.add("W7_exact_top_k", f"WITH {_Q} SELECT vec_id, query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc) WHERE rank = 1")
def w7(t: Tables) -> DataFrame:
    return rt.cosine_top_k(t.embeddings, every_20th(t), "vec_id", "embedding", 1).select("vec_id", "query_id")


@R.add("W8_ranked_top_k", f"WITH {_Q}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc) SELECT query_id, vec_id, rank::INT AS rank, round(score, 4) AS score FROM rk WHERE rank <= 8 AND score > 0")
def w8(t: Tables) -> DataFrame:
    """The team client's search: eight hits with their rounded score, none below zero."""
    hits = rt.cosine_top_k(t.embeddings, every_20th(t), "vec_id", "embedding", 8).filter("score > 0")
    return hits.select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


@R.add("W10_evidence_thinning", f"WITH {b.SQL_CHUNKS}, {_TOPICS}, th AS (SELECT *, row_number() OVER (PARTITION BY corp_code, year, report_type ORDER BY chunk_id) AS n FROM te WHERE position <= 6) SELECT chunk_id FROM th WHERE n <= CASE WHEN year = 2025 THEN 2 ELSE 1 END")
def w10(t: Tables) -> DataFrame:
    e = rt.topic_evidence(topic_scores(t), ["corp_code", "year", "report_type"], 6, 3)
    return rt.thin_evidence(e, ["corp_code", "year", "report_type"], 2025).select("chunk_id")


@R.add("W11_budgeted_round_robin", None)
def w11(t: Tables) -> DataFrame:
    c = b.chunks(t, "text", "corp_code", "year", "report_type").filter("text IS NOT NULL AND corp_code IS NOT NULL AND year IS NOT NULL")
    e = rk.top_per_group(c, ["year", "corp_code"], [F.col("chunk_id")], 3, "_n").drop("_n")
    return rk.budgeted_round_robin(e, ["year"], "corp_code", [F.col("chunk_id")], F.length("text"), 4000).select("year", "corp_code", "chunk_id", "position")


@R.add("V8_historical_anchors", f"WITH {b.SQL_CHUNKS}, {_TOPICS.split(', te AS')[0]}, s AS (SELECT corp_code, year, report_type, chunk_id, max(score) AS score FROM tp WHERE score > 0 GROUP BY ALL), w AS (SELECT DISTINCT corp_code, report_type FROM s WHERE year = 2025 ORDER BY corp_code, report_type LIMIT 4) SELECT DISTINCT ON (corp_code, report_type) corp_code, report_type, year, chunk_id FROM s JOIN w USING (corp_code, report_type) WHERE year = 2024 ORDER BY corp_code, report_type, score DESC, chunk_id")
def v8(t: Tables) -> DataFrame:
    s = topic_scores(t).groupBy("corp_code", "year", "report_type", "chunk_id").agg(F.max("score").alias("score"))
    scopes = s.filter("year = 2025").select("corp_code", "report_type", "year").distinct()
    return rt.historical_anchors(s, scopes).select("corp_code", "report_type", "year", "chunk_id")


_V9 = """, m AS (SELECT chunk_id, text, string_split(text, '특허') AS parts FROM chunks WHERE contains(text, '특허')), e AS (SELECT chunk_id, text, parts, unnest(range(0, len(parts) - 1)) AS place FROM m),
p AS (SELECT chunk_id, text, place, length(array_to_string(parts[1:place + 1], '특허')) AS pos FROM e)"""


@R.add("V9_adjacent_context", f"WITH {b.SQL_CHUNKS}{_V9} SELECT chunk_id, place::INT AS place, substring(text, greatest(0, pos - 120) + 1, pos - greatest(0, pos - 120)) AS before, substring(text, pos + 3, 120) AS after FROM p")
def v9(t: Tables) -> DataFrame:
    """The context of every mention."""
    parts = F.split("text", "특허", -1)
    c = b.chunks(t, "text").filter(F.col("text").contains("특허")).withColumn("parts", parts)
    # mention i stands behind the first i + 1 parts and the i mentions between them
    at = F.transform(F.sequence(F.lit(0), F.size("parts") - 2), lambda i: F.length(F.array_join(F.slice("parts", 1, i + 1), "특허")))
    m = c.select("chunk_id", "text", F.posexplode(at).alias("place", "at"))
    return m.select("chunk_id", "place", rt.adjacent_context(F.col("text"), F.col("at"), F.col("at") + 2).alias("x")).select("chunk_id", "place", "x.before", "x.after")


@R.add("V10_hybrid_retrieve", f"""WITH {b.SQL_CHUNKS}, {_VEC}, {_SCOPE}, {b.SQL_SLOTS}, {_TOPICS.split(", te AS")[0]}, q AS (SELECT * FROM lens WHERE vector_id % 20 = 0 ORDER BY vector_id LIMIT 1),
v AS (SELECT corp_code, chunk_id, row_number() OVER (PARTITION BY corp_code ORDER BY {_COS} DESC, chunk_id) AS rank FROM sc JOIN lens h USING (vector_id), q),
l AS (SELECT corp_code, chunk_id, row_number() OVER (PARTITION BY corp_code ORDER BY max(score) DESC, chunk_id) AS rank FROM tp WHERE score > 0 AND year = 2024 GROUP BY 1, 2)
SELECT corp_code, 'fact' AS kind, metric || '/' || basis || '/' || value_type AS ref, 1 AS rank FROM slots WHERE report_type = 'FY' AND year = 2024 AND value IS NOT NULL
UNION ALL SELECT corp_code, 'vector', chunk_id, rank FROM v WHERE rank <= 3 UNION ALL SELECT corp_code, 'lexical', chunk_id, rank FROM l WHERE rank <= 3""")
def v10(t: Tables) -> DataFrame:
    """Per company of a year its facts, the chunks nearest to a query vector and those with most topic words, told apart by kind."""
    vectors = chunk_vectors(t)
    query = vectors.filter("vector_id % 20 = 0").orderBy("vector_id").limit(1).select(F.col("vector_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = rt.scoped_search(searchable(t), vectors, query, 3, ["corp_code"])
    words = rk.top_per_group(topic_scores(t).filter("year = 2024").groupBy("corp_code", "chunk_id").agg(F.max("score").alias("score")), ["corp_code"], [F.desc("score"), F.col("chunk_id")], 3)
    facts = b.slots(t).filter("report_type = 'FY' AND year = 2024 AND value IS NOT NULL")
    kind = lambda df, name, ref, rank: df.select("corp_code", F.lit(name).alias("kind"), ref.alias("ref"), rank.cast("bigint").alias("rank"))
    out = kind(facts, "fact", F.concat_ws("/", "metric", "basis", "value_type"), F.lit(1))
    return out.unionByName(kind(near, "vector", F.col("chunk_id"), F.col("rank"))).unionByName(kind(words, "lexical", F.col("chunk_id"), F.col("rank")))
