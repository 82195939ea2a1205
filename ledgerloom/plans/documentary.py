"""Documents, claims, validation and composite queries (D, Q, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import finance as fin
from ledgerloom.operators import documents as dx
from ledgerloom.operators import facts as fx
from ledgerloom.operators import market as mk
from ledgerloom.operators import nested
from ledgerloom.operators import quarters as qx
from ledgerloom.operators import ranking as rk
from ledgerloom.operators import releases as rl
from ledgerloom.plans import base as b
from ledgerloom.plans.registry import Registry, Tables
from ledgerloom.plans.signals import SQL_SECTOR
from ledgerloom.plans.windows import _POINTS, daily, point_rows

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("D1_decode", None)
def d1(t: Tables) -> DataFrame:
    return _decoded(t).select("document_id", F.length("text").alias("characters"))


def _raw(t: Tables) -> DataFrame:
    return t.filing_source_documents.groupBy("document_id").agg(F.min_by("raw_xml", "loaded_at").alias("raw_xml"))


def _decoded(t: Tables) -> DataFrame:
    def scan(frames):
        for pdf in frames:
            yield pdf[["document_id"]].assign(text=[nested.decode(r) if r else None for r in pdf["raw_xml"]])

    return _raw(t).mapInPandas(scan, "document_id string, text string")


@R.add("D2_repair", None)
def d2(t: Tables) -> DataFrame:
    """Documents with the number and places of the repairs; one with a type definition is refused and reported."""

    def scan(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for k, text in zip(pdf["document_id"], pdf["text"], strict=True):
                try:
                    _, ledger = dx.repair(text or "")
                    out.append((k, "repaired" if ledger else "well-formed", len(ledger), ledger[0][0] if ledger else None, ledger[-1][0] if ledger else None))
                except ValueError as refused:
                    out.append((k, str(refused), None, None, None))
            yield pd.DataFrame(out, columns=["document_id", "status", "repairs", "first_at", "last_at"]).astype({c: "Int32" for c in ("repairs", "first_at", "last_at")})

    return _decoded(t).mapInPandas(scan, "document_id string, status string, repairs int, first_at int, last_at int")


@R.add("D3_lossless_check", None)
def d3(t: Tables) -> DataFrame:
    """Whether the text of each document survived its repair, with its length and checksum; null for a refused one."""

    def scan(frames):
        import zlib

        import pandas as pd

        for pdf in frames:
            out = []
            for k, text in zip(pdf["document_id"], pdf["text"], strict=True):
                said = dx.lexical_text(text or "")
                try:
                    kept = dx.lexical_text(dx.repair(text or "")[0]) == said
                except ValueError:
                    kept = None
                out.append((k, kept, len(said), zlib.crc32(said.encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(out, columns=["document_id", "lossless", "characters", "checksum"]).astype({"lossless": "boolean"})

    return _decoded(t).mapInPandas(scan, "document_id string, lossless boolean, characters int, checksum bigint")


@R.add("D4_blocks", None)
def d4(t: Tables) -> DataFrame:
    return nested.cells(nested.parse(t.filing_source_documents)).select("document_id", "section_no", "table_no", "row_no", "cell_no", "tag", "text")


@R.add("D5_span_grid", None)
def d5(t: Tables) -> DataFrame:
    return dx.grid_cells(t.filing_source_documents).select("document_id", "table_no", F.col("row").alias("row_at"), F.col("column").alias("column_at"), "text", "valid")


@R.add("D6_carried_labels", None)
def d6(t: Tables) -> DataFrame:
    return dx.carried_labels(dx.grid_cells(t.filing_source_documents).filter("valid"), ["document_id", "table_no"]).select("document_id", "table_no", F.col("row").alias("row_at"), F.col("column").alias("column_at"), "label")


@R.add("D7_number_parse", "WITH s AS (SELECT chunk_id, regexp_extract_all(text, '([0-9]{1,3}(?:,[0-9]{3})+)천원', 1) AS f FROM (SELECT DISTINCT chunk_id, text FROM chunk_metadata WHERE chunk_id IS NOT NULL)), e AS (SELECT chunk_id, f, unnest(range(0, len(f))) AS place FROM s) SELECT chunk_id, place::INT AS place, replace(f[place + 1], ',', '')::BIGINT * 1000 AS amount FROM e")
def d7(t: Tables) -> DataFrame:
    """Every amount of the whole text."""
    found = F.regexp_extract_all("text", F.lit("([0-9]{1,3}(?:,[0-9]{3})+)천원"), 1)
    rows = b.chunks(t, "text").select("chunk_id", F.posexplode(found).alias("place", "s"))
    return rows.select("chunk_id", "place", dx.number_column(F.col("s"), 1000).alias("amount"))


@R.add("D8_account_label", "SELECT DISTINCT source_account_name, regexp_replace(regexp_replace(regexp_replace(source_account_name, '\\((?:주|Note)[^)]*\\)|주\\d+\\)?', '', 'g'), '^\\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX]+|[0-9]+|[가-하])[.)]\\s*', ''), '\\s+', '', 'g') AS label FROM financial_metric_values")
def d8(t: Tables) -> DataFrame:
    return t.financial_metric_values.select("source_account_name").distinct().select("source_account_name", dx.account_label(F.col("source_account_name")).alias("label"))


@R.add("D9_statement_cells", None)
def d9(t: Tables) -> DataFrame:
    def scan(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(k, *x) for k, raw in zip(pdf["document_id"], pdf["raw_xml"], strict=True) for x in dx.statement_facts(raw)]
            yield pd.DataFrame(rows, columns=["document_id", "statement", "basis", "label", "value", "column_at"])

    return _raw(t).mapInPandas(scan, "document_id string, statement string, basis string, label string, value bigint, column_at int")


@R.add("D10_tagged_facts", None)
def d10(t: Tables) -> DataFrame:
    return dx.tagged_facts(t.filing_source_documents)


@R.add("D11_receipt_proof", f"WITH {b.SQL_FACTS}, p AS (SELECT corp_code, year, report_type, basis, metric, rcept, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM facts WHERE rcept IS NOT NULL AND in_won GROUP BY ALL) SELECT corp_code, year, report_type, basis, metric, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(value) AS receipts, min(value) = max(value) AND count(value) >= 2 AS proven FROM p GROUP BY 1, 2, 3, 4, 5")
def d11(t: Tables) -> DataFrame:
    return dx.receipt_proof(b.won_facts(t).filter("rcept IS NOT NULL"), ["corp_code", "year", "report_type", "basis", "metric"])


_RECON = "st AS (SELECT metric_value_id, corp_code, year, report_type, basis, metric, review_status, value FROM facts WHERE source_kind = 'DERIVED' AND in_won), fo AS (SELECT corp_code, year, report_type, basis, metric, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS found FROM facts WHERE source_kind = 'DOCUMENT_EXTRACTED' AND in_won GROUP BY ALL), ac AS (SELECT st.*, found, CASE WHEN coalesce(review_status, '') <> 'approved' THEN 'drop' WHEN found IS NULL OR found = value THEN 'keep' ELSE 'replace' END AS action FROM st LEFT JOIN fo USING (corp_code, year, report_type, basis, metric))"


@R.add("D12_reconcile", f"WITH {b.SQL_FACTS}, {_RECON} SELECT metric_value_id, action, CASE action WHEN 'keep' THEN value WHEN 'replace' THEN found END AS result FROM ac")
def d12(t: Tables) -> DataFrame:
    keys = ["corp_code", "year", "report_type", "basis", "metric"]
    f = b.won_facts(t)
    found = f.filter("source_kind = 'DOCUMENT_EXTRACTED'").groupBy(*keys).agg(fin.unique_or_null(F.col("value")).alias("value"))
    return dx.reconcile(f.filter("source_kind = 'DERIVED'"), found, keys).select("metric_value_id", "action", "result")


@R.add("D13_fallback_routing", f"WITH {b.SQL_FACTS}, g AS (SELECT corp_code, year, report_type, basis, metric, count(DISTINCT value) FILTER (source_kind = 'DIRECT') AS n, min(value) FILTER (source_kind = 'DIRECT') AS d, CASE WHEN count(DISTINCT value) FILTER (source_kind = 'DOCUMENT_EXTRACTED') = 1 THEN min(value) FILTER (source_kind = 'DOCUMENT_EXTRACTED') END AS x FROM facts WHERE in_won GROUP BY 1, 2, 3, 4, 5) SELECT corp_code, year, report_type, basis, metric, CASE WHEN n = 1 THEN d ELSE x END AS value, CASE WHEN n = 1 THEN 'stored' WHEN x IS NOT NULL THEN 'document' END AS route FROM g")
def d13(t: Tables) -> DataFrame:
    of = lambda kind: fin.unique_or_null(F.when(F.col("source_kind") == kind, F.col("value")))
    g = b.won_facts(t).groupBy("corp_code", "year", "report_type", "basis", "metric").agg(of("DIRECT").alias("d"), of("DOCUMENT_EXTRACTED").alias("x"))
    return g.select("corp_code", "year", "report_type", "basis", "metric", F.coalesce("d", "x").alias("value"), F.when(F.col("d").isNotNull(), "stored").when(F.col("x").isNotNull(), "document").alias("route"))


@R.add("D14_passages", None)
def d14(t: Tables) -> DataFrame:
    return dx.passages(b.chunks(t, "text"))


@R.add("D15_prose_gate", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, coalesce(length(text) >= 20 AND NOT contains(text, '|') AND NOT regexp_matches(text, '(^|\\s)[0-9][0-9,.]*(\\s+[0-9][0-9,.]*){{2,}}') AND regexp_matches(text, '(다|요|음|함)\\.?$|[a-z][.!?]$'), false) AS prose FROM chunks")
def d15(t: Tables) -> DataFrame:
    return b.chunks(t, "text").select("chunk_id", dx.prose_gate(F.col("text")).alias("prose"))


@R.add("D16_citation_id", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, left(sha256('all' || chr(0) || chunk_id || chr(0) || '0' || chr(0) || left(text, 40)), 24) AS id FROM chunks WHERE text IS NOT NULL")
def d16(t: Tables) -> DataFrame:
    c = b.chunks(t, "text").filter("text IS NOT NULL")
    return c.select("chunk_id", dx.citation_id(F.lit("all"), F.col("chunk_id"), F.lit(0), F.substring("text", 1, 40)).alias("id"))


_GRADES = "SELECT p_partkey, p_size % 5 AS f, p_partkey % 5 AS u, (p_size + 2) % 5 AS c, (p_partkey + 1) % 5 AS t FROM part"


@R.add("D17_evidence_score", f"WITH g AS ({_GRADES}) SELECT p_partkey, round(25 * (0.4 * f + 0.3 * u + 0.2 * c + 0.1 * t) - 1, 6)::DOUBLE AS score, f >= 3 AND c >= 3 AND round(25 * (0.4 * f + 0.3 * u + 0.2 * c + 0.1 * t) - 1, 6) >= 75 AS suitable FROM g")
def d17(t: Tables) -> DataFrame:
    g = t.part.select("p_partkey", (F.col("p_size") % 5).alias("f"), (F.col("p_partkey") % 5).alias("u"), ((F.col("p_size") + 2) % 5).alias("c"), ((F.col("p_partkey") + 1) % 5).alias("t"))
    score = F.round(dx.evidence_score(F.col("f"), F.col("u"), F.col("c"), F.col("t"), F.lit(1)), 6)
    return g.select("p_partkey", score.alias("score"), dx.evidence_suitable(F.col("f"), F.col("c"), score).alias("suitable"))


@R.add("D18_claims", None)
def d18(t: Tables) -> DataFrame:
    return dx.claims(b.chunks(t, "text", "corp_code", "year"))


@R.add("D19_claim_check", None)
def d19(t: Tables) -> DataFrame:
    claimed = dx.claims(b.chunks(t, "text", "corp_code", "year").filter("corp_code IS NOT NULL AND year IS NOT NULL"))
    return dx.check_claims(claimed, b.won_facts(t).select("corp_code", "year", "value"), ["corp_code", "year"]).select("chunk_id", "place", "value", "supported")


@R.add("D20_located_quotes", None)
def d20(t: Tables) -> DataFrame:
    """Every passage of each chunk found again in its text, white space apart, with a 2,000 character window."""

    def scan(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for k, text in zip(pdf["chunk_id"], pdf["text"], strict=True):
                for start, stop in dx.located_passages(text):
                    out.append((k, start, stop, text[max(0, start - 1000) : start + 1000]))
                if len(out) > 5000:  # windows are many times their texts
                    yield pd.DataFrame(out, columns=["chunk_id", "start", "stop", "excerpt"])
                    out = []
            yield pd.DataFrame(out, columns=["chunk_id", "start", "stop", "excerpt"])

    return b.chunks(t, "text").filter("text IS NOT NULL").mapInPandas(scan, "chunk_id string, start int, stop int, excerpt string")


_TITLES = "titles AS (SELECT DISTINCT dart_report_name AS title FROM filings UNION SELECT DISTINCT section_name FROM chunk_metadata UNION SELECT DISTINCT subsection_name FROM chunk_metadata)"


@R.add("D22_filing_category", f"WITH {_TITLES} SELECT title, CASE WHEN title IS NULL THEN NULL WHEN regexp_matches(title, '시설|설비|공장|생산') THEN '설비·생산' WHEN regexp_matches(title, '공급|계약') THEN '공급·계약' WHEN regexp_matches(title, '연구|개발|특허') THEN '연구·제품' WHEN regexp_matches(title, '사업보고서|반기보고서|분기보고서') THEN '정기보고' WHEN regexp_matches(title, '영업.*실적|잠정|손익') THEN '실적' ELSE '기타 공시' END AS category FROM titles")
def d22(t: Tables) -> DataFrame:
    # report names are all periodic here, so headings are classed too
    titles = t.filings.select(F.col("dart_report_name").alias("title"))
    for c in ("section_name", "subsection_name"):
        titles = titles.unionByName(t.chunk_metadata.select(F.col(c).alias("title")))
    return titles.distinct().select("title", mk.filing_category(F.col("title")).alias("category"))


@R.add("D23_korean_cap", "SELECT s_suppkey, s_suppkey * 1000000000000 + s_nationkey::BIGINT * 100000000 AS cap FROM supplier")
def d23(t: Tables) -> DataFrame:
    text = F.concat(F.format_number("s_suppkey", 0), F.lit("조 "), F.format_number("s_nationkey", 0), F.lit("억원"))
    return t.supplier.select("s_suppkey", mk.cap_text(text).alias("cap"))


@R.add("D24_text_dedupe", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, min(chunk_id) OVER (PARTITION BY corp_code, text) AS same_as FROM chunks WHERE text IS NOT NULL AND corp_code IS NOT NULL")
def d24(t: Tables) -> DataFrame:
    c = b.chunks(t, "corp_code", "text").filter("text IS NOT NULL AND corp_code IS NOT NULL")
    return dx.dedupe_text(c, ["corp_code"], "text", "chunk_id").select("chunk_id", "same_as")


_REASONS = """reasons AS (SELECT DISTINCT reason FROM coverage UNION SELECT DISTINCT 'HTTP Error ' || (400 + o_orderkey % 110) FROM orders UNION SELECT DISTINCT '상태 코드: ' || (400 + o_orderkey % 110) || ' 응답' FROM orders
  UNION SELECT DISTINCT p_type || ' timeout' FROM part UNION SELECT DISTINCT '근거 ID ' || p_size FROM part UNION SELECT DISTINCT 'API key ' || p_size || ' 할당량' FROM part)"""


@R.add("D25_failure_class", f"""WITH {_REASONS}, c AS (SELECT reason, lower(reason) AS low, try_cast(regexp_extract(lower(reason), '(?:http\\s*(?:error\\s*)?|상태\\s*코드\\s*[:：]?\\s*)([0-9]{{3}})\\b', 1) AS INT) AS code FROM reasons)
SELECT reason, CASE WHEN reason IS NULL THEN NULL WHEN code IN (401, 403, 404) OR regexp_matches(low, '인증|권한|api key|안전 예산|단일 요청 입력') THEN 'configuration'
  WHEN code = 429 OR regexp_matches(low, '할당량|사용량 제한|rate limit') THEN 'rate_limit' WHEN code IN (408, 500, 502, 503, 504, 800) OR regexp_matches(low, '네트워크|연결 실패|timeout') THEN 'unavailable'
  WHEN regexp_matches(low, '검증|json|근거 id|응답') THEN 'verification' ELSE 'insufficient_evidence' END AS class FROM c""")
def d25(t: Tables) -> DataFrame:
    # reasons of the table, and texts made of keys that reach every code and class
    code = (400 + F.col("o_orderkey") % 110).cast("string")
    made = [
        t.coverage.select("reason"),
        t.orders.select(F.concat(F.lit("HTTP Error "), code).alias("reason")),
        t.orders.select(F.concat(F.lit("상태 코드: "), code, F.lit(" 응답")).alias("reason")),
        t.part.select(F.concat("p_type", F.lit(" timeout")).alias("reason")),
        t.part.select(F.concat(F.lit("근거 ID "), F.col("p_size").cast("string")).alias("reason")),
        t.part.select(F.concat(F.lit("API key "), F.col("p_size").cast("string"), F.lit(" 할당량")).alias("reason")),
    ]
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    return rows.distinct().select("reason", dx.failure_class(F.col("reason")).alias("class"))


# Validation


@R.add("Q1_current_release", "SELECT data_version, index_version FROM data_versions WHERE is_current = 1 AND validated = 1")
def q1(t: Tables) -> DataFrame:
    return rl.current_release(t.data_versions).select("data_version", "index_version")


_PRESENT = "present AS (SELECT data_version, sum(c)::BIGINT AS chunks, sum(v)::BIGINT AS periods FROM (SELECT data_version, 1 AS c, 0 AS v FROM chunk_metadata_history WHERE is_searchable = 1 UNION ALL SELECT data_version, 0, 1 FROM coverage) GROUP BY 1)"


@R.add("Q1_pinned_release", f"WITH cur AS (SELECT * FROM data_versions WHERE is_current = 1 AND validated = 1), {_PRESENT} SELECT r.data_version, CASE WHEN r.validated <> 1 THEN 'not validated' WHEN r.index_version IS DISTINCT FROM cur.index_version THEN 'index_version differs' WHEN coalesce(chunks, 0) = 0 OR coalesce(periods, 0) = 0 THEN 'absent' ELSE 'usable' END AS status FROM data_versions r CROSS JOIN cur LEFT JOIN present p ON p.data_version = r.data_version")
def q1_pinned(t: Tables) -> DataFrame:
    """What pinning each release would give."""
    chunks = t.chunk_metadata_history.filter("is_searchable = 1").groupBy("data_version").agg(F.count(F.lit(1)).alias("chunks"))
    periods = t.coverage.groupBy("data_version").agg(F.count(F.lit(1)).alias("periods"))
    return rl.pinned_status(t.data_versions, ["index_version"], [chunks, periods]).select("data_version", "status")


@R.add("Q2_release_equivalence", "WITH v AS (SELECT *, row_number() OVER (ORDER BY created_at) AS i FROM data_versions WHERE validated = 1), c AS (SELECT data_version, md5(string_agg(concat_ws('/', corp_code, year, report_type, fs_div, filing_exists, status), ';' ORDER BY corp_code, year, report_type, fs_div, filing_exists, status)) AS h FROM (SELECT DISTINCT data_version, corp_code, year, report_type, fs_div, filing_exists, status FROM coverage) GROUP BY 1) SELECT a.data_version AS registered, p.data_version AS selected, CASE WHEN ca.h = cp.h THEN 'same content' ELSE 'content differs' END AS equivalence FROM v a JOIN v p ON p.i = a.i - 1 LEFT JOIN c ca ON ca.data_version = a.data_version LEFT JOIN c cp ON cp.data_version = p.data_version")
def q2_equivalence(t: Tables) -> DataFrame:
    """Each validated release against the one before; there is no log of patches here, so nothing but equal content counts."""
    once = t.coverage.select("data_version", "corp_code", "year", "report_type", "fs_div", "filing_exists", "status").distinct()
    hashes = rl.fingerprint(once, ["data_version"]).select("data_version", F.concat_ws("-", "n", "xor", "total").alias("content_hash"))
    valid = t.data_versions.filter("validated = 1")
    pairs = rl.preceding(valid).filter("preceding IS NOT NULL").select(F.col("data_version").alias("registered"), F.col("preceding").alias("selected"))
    return rl.equivalence(pairs, valid.join(F.broadcast(hashes), "data_version", "left"), None)


@R.add("Q2_preceding_release", "SELECT a.data_version, (SELECT p.data_version FROM data_versions p WHERE p.created_at < a.created_at AND p.validated = 1 ORDER BY p.created_at DESC LIMIT 1) AS preceding FROM data_versions a")
def q2(t: Tables) -> DataFrame:
    return rl.preceding(t.data_versions).select("data_version", "preceding")


@R.add("Q3_compatible_releases", "SELECT a.data_version, b.data_version AS compatible FROM data_versions a JOIN data_versions b USING (index_version)")
def q3(t: Tables) -> DataFrame:
    return rl.compatible(t.data_versions)


@R.add("Q4_chunk_vector_integrity", "WITH m AS (SELECT DISTINCT chunk_id, vector_id FROM chunk_metadata WHERE is_active = 1 AND is_searchable = 1), e AS (SELECT DISTINCT embedding_id FROM chunk_embeddings WHERE is_active = 1) SELECT count(*) AS chunks, count(DISTINCT vector_id) AS vectors, count(*) FILTER (vector_id IS NULL OR vector_id NOT IN (SELECT embedding_id FROM e)) AS broken FROM m")
def q4(t: Tables) -> DataFrame:
    m = t.chunk_metadata.filter("is_active = 1 AND is_searchable = 1").select("chunk_id", "vector_id").distinct()
    e = t.chunk_embeddings.filter("is_active = 1").select(F.col("embedding_id").alias("vector_id")).distinct().withColumn("there", F.lit(True))
    return m.join(e, "vector_id", "left").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("vector_id").alias("vectors"), F.count_if(F.col("there").isNull()).alias("broken"))


@R.add("Q5_fingerprint", "WITH r AS (SELECT DISTINCT h.data_version, chunk_id, content_hash FROM chunk_metadata_history h), v AS (SELECT data_version, row_number() OVER (ORDER BY created_at) AS i FROM data_versions), f AS (SELECT i, data_version, list(coalesce(chunk_id, '') || '/' || coalesce(content_hash, '') ORDER BY chunk_id, content_hash) AS c FROM r JOIN v USING (data_version) GROUP BY 1, 2) SELECT b.data_version, len(b.c) AS n, coalesce(a.c = b.c, false) AS unchanged FROM f b LEFT JOIN f a ON a.i = b.i - 1")
def q5(t: Tables) -> DataFrame:
    """Releases whose content has the fingerprint of the release before."""
    once = t.chunk_metadata_history.select("data_version", "chunk_id", "content_hash").distinct()
    order = t.data_versions.select("data_version", F.row_number().over(Window.orderBy("created_at")).alias("i"))
    prints = rl.fingerprint(once, ["data_version"]).join(F.broadcast(order), "data_version")
    before = prints.select((F.col("i") + 1).alias("i"), F.struct("n", "xor", "total").alias("before"))
    return prints.join(before, "i", "left").select("data_version", "n", F.coalesce(F.struct("n", "xor", "total") == F.col("before"), F.lit(False)).alias("unchanged"))


@R.add("Q6_reconciled_counts", f"""WITH {b.SQL_CHUNKS}, kw AS (SELECT DISTINCT chunk_id, corp_code, trim(unnest(string_split(keyword, ',')), ' ') AS keyword FROM chunks WHERE keyword IS NOT NULL AND corp_code IS NOT NULL),
raw AS (SELECT trim(unnest(string_split(keyword, ',')), ' ') AS keyword FROM chunks WHERE keyword IS NOT NULL), a AS (SELECT keyword, count(*) AS by_company FROM kw WHERE keyword <> '' GROUP BY 1), r AS (SELECT keyword, count(*) AS mentions FROM raw WHERE keyword <> '' GROUP BY 1)
SELECT keyword, coalesce(by_company, 0) AS by_company, mentions, coalesce(by_company, 0) = mentions AS agrees FROM r LEFT JOIN a USING (keyword)""")
def q6(t: Tables) -> DataFrame:
    """Company sums per keyword against the mentions of the field itself: repeats in a chunk and chunks without a company do not reconcile."""
    from ledgerloom.plans.signals import hits

    per = hits(t).filter("corp_code IS NOT NULL").groupBy("keyword", "corp_code").agg(F.count(F.lit(1)).alias("n")).groupBy("keyword").agg(F.sum("n").alias("by_company"))
    raw = b.chunks(t, "keyword").select(F.explode(F.transform(F.split("keyword", ",", -1), lambda x: F.trim(x))).alias("keyword")).filter("keyword <> ''")
    mentions = raw.groupBy("keyword").agg(F.count(F.lit(1)).alias("mentions"))
    n = F.coalesce("by_company", F.lit(0))
    return mentions.join(per, "keyword", "left").select("keyword", n.alias("by_company"), "mentions", (n == F.col("mentions")).alias("agrees"))


# Composite queries


@R.add("X1_financials", f"WITH {b.SQL_SLOTS} SELECT corp_code, metric, basis, value_type, value FROM slots WHERE corp_code = '00000027' AND year = 2020 AND report_type = 'FY'")
def x1(t: Tables) -> DataFrame:
    return rl.financials(b.slots(t), "00000027", 2020).select("corp_code", "metric", "basis", "value_type", "value")


@R.add("X2_quarterly_trend", f"WITH {b.SQL_SLOTS} SELECT year, report_type, basis, value FROM slots WHERE corp_code = '00000025' AND metric = 'REVENUE' AND value_type = 'cumulative'")
def x2(t: Tables) -> DataFrame:
    return rl.trend(b.slots(t), "00000025", "REVENUE", "cumulative").select("year", "report_type", "basis", "value")


@R.add("X3_capex", f"WITH {b.SQL_FACTS}, {b.SQL_COMPANIES} SELECT metric_value_id, corp_name, year, report_type, value FROM facts JOIN companies USING (corp_code) WHERE metric = 'CAPEX'")
def x3(t: Tables) -> DataFrame:
    return b.facts(t).filter("metric = 'CAPEX'").join(b.companies(t), "corp_code").select("metric_value_id", "corp_name", "year", "report_type", "value")


@R.add("X4_coverage", f"WITH {b.SQL_COMPANIES} SELECT DISTINCT corp_name, year, report_type, upper(trim(status)) AS status FROM coverage JOIN companies USING (corp_code) WHERE data_version = 'v11'")
def x4(t: Tables) -> DataFrame:
    return t.coverage.filter("data_version = 'v11'").join(b.companies(t), "corp_code").select("corp_name", "year", "report_type", F.upper(F.trim("status")).alias("status")).distinct()


@R.add("X5_company_list", f"WITH {b.SQL_COMPANIES} SELECT corp_code, corp_name FROM companies ORDER BY corp_code")
def x5(t: Tables) -> DataFrame:
    return b.companies(t).orderBy("corp_code")


@R.add("X6_chunk_by_id", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, corp_code, year, section_name FROM chunks WHERE chunk_id = (SELECT min(chunk_id) FROM chunk_metadata)")
def x6(t: Tables) -> DataFrame:
    first = t.chunk_metadata.agg(F.min("chunk_id").alias("chunk_id"))
    return b.chunks(t, "corp_code", "year", "section_name").join(F.broadcast(first), "chunk_id", "left_semi").select("chunk_id", "corp_code", "year", "section_name")


@R.add("X7_analysis_years", "SELECT year, year IN (2023, 2024) AS requested FROM (SELECT DISTINCT year FROM filings WHERE is_active = 1)")
def x7(t: Tables) -> DataFrame:
    return rl.analysis_years(t.filings.filter("is_active = 1").select("year"), [2023, 2024])


@R.add("X8_documents", "SELECT DISTINCT rcept_no, corp_code, year::VARCHAR || ' ' || report_type AS period, coalesce(dart_report_name, report_type) AS report_name FROM filings WHERE is_active = 1")
def x8(t: Tables) -> DataFrame:
    return t.filings.filter("is_active = 1").select("rcept_no", "corp_code", F.concat(F.col("year").cast("string"), F.lit(" "), F.col("report_type")).alias("period"), F.coalesce("dart_report_name", "report_type").alias("report_name")).distinct()


@R.add("X9_hit_adapter", f"WITH {b.SQL_CHUNKS} SELECT chunk_id AS id, rcept_no, section_name, 0 AS start, length(text) AS stop, 1.0::DOUBLE AS score FROM chunks WHERE text IS NOT NULL")
def x9(t: Tables) -> DataFrame:
    c = b.chunks(t, "text", "section_name", "rcept_no").filter("text IS NOT NULL")
    return c.select(F.col("chunk_id").alias("id"), "rcept_no", "section_name", F.lit(0).alias("start"), F.length("text").alias("stop"), F.lit(1.0).alias("score"))


@R.add("X10_flow_reader", f"WITH {b.SQL_QUARTERS} SELECT corp_code, year, quarter, value FROM quarters WHERE basis = 'CFS' AND metric = 'REVENUE'")
def x10(t: Tables) -> DataFrame:
    return b.quarters(t).filter("basis = 'CFS' AND metric = 'REVENUE'").select("corp_code", "year", "quarter", "value")


@R.add("X11_widened_rows", f"WITH {_POINTS}, pw AS (SELECT * FROM pt WHERE year BETWEEN 2021 AND 2024), j AS (SELECT a.*, p.equity AS pe FROM pw a LEFT JOIN pw p ON a.corp_code = p.corp_code AND a.basis = p.basis AND p.year * 4 + p.quarter = a.year * 4 + a.quarter - 1) SELECT corp_code, basis, year, quarter, CASE WHEN equity + pe > 0 THEN round(net_income * 4 / ((equity + pe) / 2) * 100, 6) END AS roe FROM j WHERE year BETWEEN 2022 AND 2024")
def x11(t: Tables) -> DataFrame:
    """A year more is read than asked for, as the first quarter needs the one before."""
    wide = point_rows(t).filter("year BETWEEN 2021 AND 2024")
    return qx.bank_metrics(wide).filter("year BETWEEN 2022 AND 2024").select("corp_code", "basis", "year", "quarter", F.round("roe", 6).alias("roe"))


@R.add("X12_public_projection", f"WITH {b.SQL_QUARTERS} SELECT corp_code, basis, metric, year, quarter, value FROM quarters")
def x12(t: Tables) -> DataFrame:
    return b.quarters(t).drop("method", "inputs")


@R.add("X13_metric_catalog", "SELECT metric_code, metric_name, CASE period_nature WHEN 'flow' THEN 'per quarter' ELSE 'at period end' END AS note FROM metric_definitions")
def x13(t: Tables) -> DataFrame:
    return t.metric_definitions.select("metric_code", "metric_name", F.when(F.col("period_nature") == "flow", "per quarter").otherwise("at period end").alias("note"))


@R.add("X14_verified_or_document", f"WITH {b.SQL_FACTS} SELECT corp_code, year, report_type, basis, coalesce(CASE WHEN count(DISTINCT value) FILTER (source_kind = 'DIRECT' AND review_status = 'approved') = 1 THEN min(value) FILTER (source_kind = 'DIRECT' AND review_status = 'approved') END, CASE WHEN count(DISTINCT value) FILTER (source_kind = 'DOCUMENT_EXTRACTED') = 1 THEN min(value) FILTER (source_kind = 'DOCUMENT_EXTRACTED') END) AS value FROM facts WHERE metric = 'CAPEX' AND in_won GROUP BY 1, 2, 3, 4")
def x14(t: Tables) -> DataFrame:
    of = lambda test: fin.unique_or_null(F.when(test, F.col("value")))
    direct = of((F.col("source_kind") == "DIRECT") & (F.col("review_status") == "approved"))
    return b.won_facts(t).filter("metric = 'CAPEX'").groupBy("corp_code", "year", "report_type", "basis").agg(F.coalesce(direct, of(F.col("source_kind") == "DOCUMENT_EXTRACTED")).alias("value"))


@R.add("X18_context_normal_form", None)
def x18(t: Tables) -> DataFrame:
    from ledgerloom.operators.signals import context_signature

    return b.chunks(t, "text").filter("text IS NOT NULL").select("chunk_id", context_signature(F.col("text")).alias("context"))


@R.add("X19_company_corpus", f"WITH {b.SQL_CHUNKS} SELECT chunk_id FROM chunks WHERE corp_code = '00000990' AND is_active = 1 AND is_searchable = 1 AND year BETWEEN 2023 AND 2025")
def x19(t: Tables) -> DataFrame:
    return b.chunks(t, "corp_code", "is_active", "is_searchable", "year").filter("corp_code = '00000990' AND is_active = 1 AND is_searchable = 1 AND year BETWEEN 2023 AND 2025").select("chunk_id")


@R.add("X20_sector_driver", f"WITH {SQL_SECTOR} SELECT keyword, final_rank, round(weight, 6)::DOUBLE AS weight FROM wt")
def x20(t: Tables) -> DataFrame:
    from ledgerloom.plans.signals import sector_scores

    top = sector_scores(t).filter("final_rank <= 30")
    return top.select("keyword", "final_rank", F.round(rk.display_weight(F.col("final_score"), F.col("final_rank"), ["sector"]), 6).alias("weight"))


@R.add("X22_keyword_gate", f"WITH {SQL_SECTOR} SELECT keyword, chunk_id FROM hits WHERE keyword IN (SELECT keyword FROM cloud)")
def x22(t: Tables) -> DataFrame:
    from ledgerloom.plans.signals import hits, sector_scores

    cloud = sector_scores(t).filter("final_rank <= 30").select("keyword")
    return hits(t).select("keyword", "chunk_id").join(cloud, "keyword", "left_semi")


@R.add("X23_quarter_source_trace", f"WITH {b.SQL_QUARTERS} SELECT corp_code, basis, metric, year, quarter, method FROM quarters WHERE value IS NOT NULL")
def x23(t: Tables) -> DataFrame:
    return b.quarters(t).filter("value IS NOT NULL").select("corp_code", "basis", "metric", "year", "quarter", "method")


# which stored and cumulative figures each quarter was built from; the SQL of X23_quarter_source_trace names the method only
@R.add("X23_quarter_inputs", None)
def x23_inputs(t: Tables) -> DataFrame:
    return b.quarters(t).filter("value IS NOT NULL").select("corp_code", "basis", "metric", "year", "quarter", F.transform("inputs", lambda x: x["input"]).alias("inputs"))


@R.add("X24_ratio_source_trace", f"WITH {b.SQL_FACTS}, r AS (SELECT DISTINCT corp_code, basis, year, report_type, rcept FROM facts WHERE metric IN ('REVENUE', 'OPERATINGINCOME') AND rcept IS NOT NULL) SELECT corp_code, basis, year, report_type, string_agg(rcept, ',' ORDER BY rcept) AS receipts FROM r GROUP BY 1, 2, 3, 4")
def x24(t: Tables) -> DataFrame:
    r = b.facts(t).filter("metric IN ('REVENUE', 'OPERATINGINCOME') AND rcept IS NOT NULL").select("corp_code", "basis", "year", "report_type", "rcept").distinct()
    return r.groupBy("corp_code", "basis", "year", "report_type").agg(F.array_join(F.array_sort(F.collect_list("rcept")), ",").alias("receipts"))


@R.add("X25_source_excerpt", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, substring(text, 11, 20) = left(substring(text, 11), 20) AS agrees FROM chunks WHERE text IS NOT NULL")
def x25(t: Tables) -> DataFrame:
    c = b.chunks(t, "text").filter("text IS NOT NULL").withColumn("quote", F.substring(F.substring("text", 11, 2**30), 1, 20))
    return c.select("chunk_id", rl.excerpt_agrees(F.col("text"), F.lit(10), F.lit(30), F.col("quote")).alias("agrees"))


@R.add("X26_revenue_source", f"WITH {b.SQL_CHUNKS}, m AS (SELECT *, row_number() OVER (PARTITION BY corp_code, year ORDER BY CASE WHEN starts_with(section_name, 'III.') THEN 0 ELSE 1 END, chunk_id) AS r FROM chunks WHERE contains(text, '매출') AND corp_code IS NOT NULL) SELECT corp_code, year, chunk_id FROM m WHERE r = 1")
def x26(t: Tables) -> DataFrame:
    c = b.chunks(t, "text", "section_name", "corp_code", "year").filter(F.col("text").contains("매출") & F.col("corp_code").isNotNull())
    third = F.when(F.coalesce(F.col("section_name").startswith("III."), F.lit(False)), 0).otherwise(1)
    return rk.keep_first(c, ["corp_code", "year"], [third, F.col("chunk_id")]).select("corp_code", "year", "chunk_id")


@R.add("X27_evidence_assembly", None)
def x27(t: Tables) -> DataFrame:
    """Every passage of the selected filings' whole texts with its place, and every annual figure.

    Selected of a company's period are the first two (one before the latest year) of the chunks that are best for a topic; a period without any mention has its first chunks.
    """
    from ledgerloom.operators import retrieval as rt
    from ledgerloom.plans.signals import TERMS

    scope = ["corp_code", "year", "report_type"]
    chunks = b.chunks(t, "text", *scope).filter("text IS NOT NULL AND corp_code IS NOT NULL")
    scores = F.array(*(F.struct(F.lit(i).alias("topic"), rt.lexical_score(F.col("text"), [x]).alias("score")) for i, x in enumerate(TERMS)))
    chosen = rt.thin_evidence(rt.topic_evidence(chunks.select(*scope, "chunk_id", F.inline(scores)), scope, 8, len(TERMS)), scope, 2025)
    texts = chunks.join(chosen.select("chunk_id"), "chunk_id", "left_semi").select("corp_code", "text", F.lit("filing").alias("kind"), F.col("chunk_id").alias("source"))
    filings = dx.passages(texts)
    numbers = b.slots(t).filter("value IS NOT NULL AND report_type = 'FY'").select("corp_code", F.lit("financial").alias("kind"), F.concat_ws("/", "year", "basis", "metric", "value_type").alias("source"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.col("value").cast("string").alias("passage"))
    order = Window.partitionBy("corp_code", "kind").orderBy("source", "start")
    return filings.unionByName(numbers).withColumn("position", F.row_number().over(order))


@R.add("X29_provenance_only", f"WITH {b.SQL_CHUNKS}, kn AS (SELECT DISTINCT regexp_replace(rcept_no, '[^0-9]', '', 'g') AS r FROM filings WHERE is_active = 1 AND regexp_matches(rcept_no, '[1-9]')) SELECT coalesce(regexp_matches(rcept_no, '[1-9]') AND regexp_replace(rcept_no, '[^0-9]', '', 'g') IN (FROM kn), false) AS known, count(*) AS n FROM chunks GROUP BY 1")
def x29(t: Tables) -> DataFrame:
    """Passages of answers whose source is known; unknown ids leave a warning count."""
    said = b.chunks(t, "rcept_no").select("chunk_id", b.digits("rcept_no").alias("rcept"))
    known = t.filings.filter("is_active = 1").select(b.digits("rcept_no").alias("rcept")).distinct().withColumn("known", F.lit(True))
    return said.join(known, "rcept", "left").groupBy(F.coalesce("known", F.lit(False)).alias("known")).agg(F.count(F.lit(1)).alias("n"))


@R.add("X31_comparison_links", f"WITH {b.SQL_SLOTS} SELECT a.corp_code, a.year, a.basis, a.metric, p.value AS predecessor FROM slots a JOIN slots p ON a.corp_code = p.corp_code AND a.report_type = p.report_type AND a.basis = p.basis AND a.metric = p.metric AND a.value_type = p.value_type AND p.year = a.year - 1 WHERE a.report_type = 'FY' AND a.value_type = 'annual' AND a.value IS NOT NULL AND p.value IS NOT NULL")
def x31(t: Tables) -> DataFrame:
    a = b.slots(t).filter("report_type = 'FY' AND value_type = 'annual' AND value IS NOT NULL")
    return qx.previous_year(a, ["corp_code", "basis", "metric"], ["value"]).filter("prev_value IS NOT NULL").select("corp_code", "year", "basis", "metric", F.col("prev_value").alias("predecessor"))


@R.add("X32_document_financials", None)
def x32(t: Tables) -> DataFrame:
    intact = t.filing_source_documents.filter((F.sha2("raw_xml", 256) == F.col("sha256")) & (F.octet_length("raw_xml") == F.col("byte_size")))
    tagged = dx.tagged_facts(intact).join(intact.select("document_id", b.digits("rcept_no").alias("rcept")).distinct(), "document_id")
    return tagged.groupBy("rcept", "acode").agg(fin.unique_or_null(F.col("value")).alias("value"), F.count("value").alias("cells"))


@R.add("X35_two_session_collection", "WITH daily AS (SELECT event_type AS instrument, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS rn FROM daily WHERE day > DATE '2023-12-25' AND day < DATE '2024-01-25') SELECT c.instrument, c.day, c.close, p.close AS previous FROM r c JOIN r p ON c.instrument = p.instrument AND c.rn = 1 AND p.rn = 2")
def x35(t: Tables) -> DataFrame:
    return mk.close_snapshot(daily(t).filter("day > DATE '2023-12-25'"), "2024-01-25").select("instrument", "day", "close", "previous")


@R.add("X36_stale_carry_over", "WITH daily AS (SELECT event_type AS instrument, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2), o AS (SELECT instrument, day, close FROM daily WHERE day < DATE '2024-01-20'), n AS (SELECT instrument, day, close * 2 AS close FROM daily WHERE day > DATE '2024-01-10') SELECT coalesce(o.instrument, n.instrument) AS instrument, coalesce(o.day, n.day) AS day, coalesce(n.close, o.close) AS close, n.close IS NULL AS stale FROM o FULL JOIN n USING (instrument, day)")
def x36(t: Tables) -> DataFrame:
    d = daily(t)
    return mk.carry_over(d.filter("day < DATE '2024-01-20'"), d.filter("day > DATE '2024-01-10'").withColumn("close", F.col("close") * 2), ["instrument", "day"], "close")


@R.add("X37_company_projection", f"WITH {b.SQL_SERIES} SELECT corp_code, basis, max(year * 4 + quarter) AS latest, count(revenue) AS quarters FROM series GROUP BY 1, 2")
def x37(t: Tables) -> DataFrame:
    return b.series(t).groupBy("corp_code", "basis").agg(F.max(F.col("year") * 4 + F.col("quarter")).alias("latest"), F.count("revenue").alias("quarters"))


@R.add("X38_keyword_card", f"WITH {SQL_SECTOR} SELECT keyword, round(final_score, 4)::DOUBLE AS final_score, round(current_score, 4)::DOUBLE AS current_score, round(change_score, 4)::DOUBLE AS change_score, round(spread_score, 4)::DOUBLE AS spread_score, round(penalty, 4)::DOUBLE AS penalty FROM cloud")
def x38(t: Tables) -> DataFrame:
    from ledgerloom.plans.signals import sector_scores

    return sector_scores(t).filter("final_rank <= 30").select("keyword", *(F.round(c, 4).alias(c) for c in ("final_score", "current_score", "change_score", "spread_score", "penalty")))


@R.add("X39_period_union", f"WITH {b.SQL_SERIES}, p AS (SELECT DISTINCT year, quarter FROM series), c AS (SELECT DISTINCT corp_code, basis FROM series) SELECT c.corp_code, c.basis, p.year, p.quarter, s.revenue FROM c CROSS JOIN p LEFT JOIN series s USING (corp_code, basis, year, quarter)")
def x39(t: Tables) -> DataFrame:
    return rl.period_union(b.series(t), ["corp_code", "basis"], "revenue")


__all__ = ["QUERIES", "SQL", "fx"]
