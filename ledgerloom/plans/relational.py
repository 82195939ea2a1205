"""Sources, projections, joins, aggregations and set operations (S, P, J, A, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import finance as fin
from ledgerloom.operators import facts as fx
from ledgerloom.operators import ranking as rk
from ledgerloom.plans import base as b
from ledgerloom.plans.registry import Registry, Tables

R = Registry()
QUERIES, SQL = R.queries, R.sql


# Sources


@R.add("S1_read_only_scan", "SELECT rcept_no, corp_code, year, report_type FROM filings WHERE is_active = 1")
def s1(t: Tables) -> DataFrame:
    return t.filings.filter("is_active = 1").select("rcept_no", "corp_code", "year", "report_type")


@R.add("S2_parameterised_sql", "SELECT corp_code, count(*) AS n FROM filings WHERE year >= 2021 AND report_type = 'FY' GROUP BY 1")
def s2(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT corp_code, count(*) AS n FROM {filings} WHERE year >= :since AND report_type = :kind GROUP BY 1", args={"since": 2021, "kind": "FY"}, filings=t.filings)


@R.add("S4_partitioned_scan", "SELECT vector_id % 16 AS slice, count(*) AS n, min(vector_id) AS first_id, max(vector_id) AS last_id FROM chunk_metadata WHERE vector_id IS NOT NULL GROUP BY 1")
def s4(t: Tables) -> DataFrame:
    return t.chunk_metadata.filter("vector_id IS NOT NULL").groupBy((F.col("vector_id") % 16).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.min("vector_id").alias("first_id"), F.max("vector_id").alias("last_id"))


@R.add("S5_vector_decode", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding)::INT AS dim FROM embeddings")
def s5(t: Tables) -> DataFrame:
    from ledgerloom.sources.vectors import decode_vectors, encode_vectors

    blobs = t.embeddings.select("vec_id", encode_vectors("embedding").alias("blob"))
    vectors = blobs.select("vec_id", decode_vectors("blob", 64).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors.select("vec_id", F.round(total, 5).alias("total"), F.size("v").alias("dim"))


@R.add("S6_document_integrity", "SELECT DISTINCT document_id, coalesce(sha256(raw_xml) = sha256 AND octet_length(raw_xml) = byte_size, false) AS intact FROM filing_source_documents")
def s6(t: Tables) -> DataFrame:
    intact = (F.sha2("raw_xml", 256) == F.col("sha256")) & (F.octet_length("raw_xml") == F.col("byte_size"))
    return t.filing_source_documents.select("document_id", F.coalesce(intact, F.lit(False)).alias("intact")).distinct()


# Projections and predicates


@R.add("P1_value_selection", f"WITH {b.SQL_FACTS} SELECT metric_value_id, CASE WHEN source_kind = 'DERIVED' THEN value END AS calculated, CASE WHEN source_kind = 'DERIVED' THEN value ELSE -value END AS selected FROM facts")
def p1(t: Tables) -> DataFrame:
    derived = F.col("source_kind") == "DERIVED"
    return b.facts(t).select("metric_value_id", F.when(derived, F.col("value")).alias("calculated"), fx.selected_value(derived, F.col("value"), -F.col("value")).alias("selected"))


@R.add("P2_capex_selection", f"WITH {b.SQL_FACTS} SELECT metric_value_id, CASE WHEN source_kind = 'DERIVED' THEN value ELSE abs(value) END AS outflow FROM facts WHERE metric = 'CAPEX'")
def p2(t: Tables) -> DataFrame:
    return b.facts(t).filter("metric = 'CAPEX'").select("metric_value_id", fx.selected_value(F.col("source_kind") == "DERIVED", F.col("value"), F.abs("value")).alias("outflow"))


@R.add("P3_sector_scope", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND s_acctbal > 0")
def p3(t: Tables) -> DataFrame:
    # nation and region are fixed tables of 25 and 5 rows
    asia = t.nation.join(F.broadcast(t.region.filter("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.filter("s_acctbal > 0").join(F.broadcast(asia), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@R.add("P4_exactly_one", f"WITH {b.SQL_COMPANIES} SELECT corp_code, corp_name FROM companies WHERE corp_code = '00000990'")
def p4(t: Tables) -> DataFrame:
    return fx.exactly_one(b.companies(t), [F.col("corp_code") == "00000990", F.col("corp_name") == "00000990"])


@R.add("P5_fact_slice", f"WITH {b.SQL_FACTS} SELECT metric_value_id, metric, value FROM facts WHERE report_type = 'H1' AND basis = 'CFS' AND value_type IN ('cumulative', 'point_in_time')")
def p5(t: Tables) -> DataFrame:
    return fx.fact_slice(b.facts(t), "HY", "CFS").select("metric_value_id", "metric", "value")


@R.add("P6_type_default", "SELECT DISTINCT report_type, CASE WHEN report_type = 'HY' THEN 'H1' ELSE report_type END AS proper, CASE WHEN report_type = 'FY' THEN 'annual' ELSE 'cumulative' END AS kind FROM financial_metric_values")
def p6(t: Tables) -> DataFrame:
    return t.financial_metric_values.select("report_type").distinct().select("report_type", fx.report_alias(F.col("report_type")).alias("proper"), F.when(F.col("report_type") == "FY", "annual").otherwise("cumulative").alias("kind"))


@R.add("P7_chunk_filter", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, section_name FROM chunks WHERE is_active = 1 AND is_searchable = 1 AND data_version = 'v11' AND year = 2024 AND starts_with(section_name, 'II.')")
def p7(t: Tables) -> DataFrame:
    keep = "is_active = 1 AND is_searchable = 1 AND data_version = 'v11' AND year = 2024"
    return b.chunks(t, "section_name", "is_active", "is_searchable", "data_version", "year").filter(keep).filter(F.col("section_name").startswith("II.")).select("chunk_id", "section_name")


SECTIONS, PHRASES = ("II.", "IV."), ("위험관리", "연구개발")


@R.add("P8_section_policy", f"WITH {b.SQL_CHUNKS} SELECT chunk_id FROM chunks WHERE coalesce(starts_with(section_name, 'II.') OR starts_with(section_name, 'IV.'), false) OR coalesce(contains(subsection_name, '위험관리') OR contains(subsection_name, '연구개발'), false)")
def p8(t: Tables) -> DataFrame:
    c = b.chunks(t, "section_name", "subsection_name")
    return c.filter(section_policy(SECTIONS, PHRASES)).select("chunk_id")


def section_policy(sections: tuple[str, ...], phrases: tuple[str, ...]):
    test = F.lit(False)
    for s in sections:
        test = test | F.coalesce(F.col("section_name").startswith(s), F.lit(False))
    for p in phrases:
        test = test | F.coalesce(F.col("subsection_name").contains(p), F.lit(False))
    return test


@R.add("P9_text_search", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, vector_id, left(text, 300) AS excerpt FROM chunks WHERE is_active = 1 AND contains(text, '특허') ORDER BY vector_id NULLS FIRST, chunk_id LIMIT 50")
def p9(t: Tables) -> DataFrame:
    hits = b.chunks(t, "vector_id", "text", "is_active").filter((F.col("is_active") == 1) & F.col("text").contains("특허"))
    return hits.orderBy(F.asc_nulls_first("vector_id"), "chunk_id").limit(50).select("chunk_id", "vector_id", F.substring("text", 1, 300).alias("excerpt"))


@R.add("P10_finite_guard", "SELECT event_id, CASE WHEN isfinite(value / nullif(value - 5, 0)) THEN round(value / nullif(value - 5, 0), 6) END AS safe FROM events")
def p10(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(fin.finite(F.try_divide(F.col("value"), F.col("value") - 5)), 6).alias("safe"))


@R.add("P11_release_filter", "SELECT data_version, count(*) AS n FROM coverage WHERE data_version IN ('v9', 'v10') GROUP BY 1")
def p11(t: Tables) -> DataFrame:
    return t.coverage.filter(fx.release_filter("data_version", ["v9", "v10"])).groupBy("data_version").agg(F.count(F.lit(1)).alias("n"))


@R.add("P12_approved_metrics", f"WITH {b.SQL_FACTS} SELECT metric_value_id, value FROM facts WHERE review_status = 'approved' AND in_won AND value >= 0")
def p12(t: Tables) -> DataFrame:
    return b.facts(t).filter("review_status = 'approved' AND in_won AND value >= 0").select("metric_value_id", "value")


@R.add("P13_period_trim", f"WITH {b.SQL_SERIES}, l AS (SELECT *, max(year * 4 + quarter) FILTER (revenue IS NOT NULL OR capex IS NOT NULL) OVER (PARTITION BY corp_code, basis) AS last FROM series) SELECT corp_code, basis, year, quarter FROM l WHERE year * 4 + quarter <= last")
def p13(t: Tables) -> DataFrame:
    from ledgerloom.operators.quarters import trim_trailing

    return trim_trailing(b.series(t), ["corp_code", "basis"], F.col("year") * 4 + F.col("quarter"), ["revenue", "capex"]).select("corp_code", "basis", "year", "quarter")


@R.add("P14_first_filing_trim", f"WITH {b.SQL_SERIES}, f AS (SELECT corp_code, min(year) AS lo, max(year) AS hi FROM filings WHERE is_active = 1 GROUP BY 1) SELECT s.corp_code, basis, s.year, quarter FROM series s JOIN f USING (corp_code) WHERE s.year BETWEEN lo AND hi")
def p14(t: Tables) -> DataFrame:
    span = t.filings.filter("is_active = 1").groupBy("corp_code").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return b.series(t).join(span, "corp_code").filter("year BETWEEN lo AND hi").select("corp_code", "basis", "year", "quarter")


@R.add("P15_basis_choice", f"WITH {b.SQL_FACTS} SELECT corp_code, year, min(basis) AS basis FROM facts GROUP BY 1, 2")
def p15(t: Tables) -> DataFrame:
    return fx.basis_choice(b.facts(t), ["corp_code", "year"])


# Joins


@R.add("J1_inner_equi", f"WITH {b.SQL_COMPANIES} SELECT f.rcept_no, c.corp_name FROM (SELECT DISTINCT rcept_no, corp_code FROM filings) f JOIN companies c USING (corp_code)")
def j1(t: Tables) -> DataFrame:
    return t.filings.select("rcept_no", "corp_code").distinct().join(b.companies(t), "corp_code").select("rcept_no", "corp_name")


@R.add("J2_derived_key", f"WITH {b.SQL_FACTS} SELECT metric_value_id, metric_name FROM facts JOIN metric_definitions d ON metric = upper(replace(d.metric_code, '_', ''))")
def j2(t: Tables) -> DataFrame:
    d = t.metric_definitions.select(F.upper(F.replace("metric_code", F.lit("_"), F.lit(""))).alias("metric"), "metric_name")
    return b.facts(t).join(F.broadcast(d), "metric").select("metric_value_id", "metric_name")


@R.add("J3_theta_residual", f"WITH {b.SQL_FACTS} SELECT metric_value_id, d.metric_code FROM facts JOIN metric_definitions d ON metric = upper(replace(d.metric_code, '_', '')) AND (d.period_nature = 'flow' OR (d.common_unit = 'KRW' AND value > 1000000))")
def j3(t: Tables) -> DataFrame:
    d = t.metric_definitions.select(F.upper(F.replace("metric_code", F.lit("_"), F.lit(""))).alias("m"), "metric_code", "period_nature", "common_unit")
    f = b.facts(t)
    on = (f["metric"] == d["m"]) & ((d["period_nature"] == "flow") | ((d["common_unit"] == "KRW") & (f["value"] > 1000000)))
    return f.join(F.broadcast(d), on).select("metric_value_id", "metric_code")


@R.add("J4_guarded_left", f"WITH {b.SQL_FACTS}, s AS (SELECT DISTINCT corp_code, year, report_type, basis, metric FROM facts), c AS (SELECT corp_code, year, report_type, basis, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS capex FROM facts WHERE metric = 'CAPEX' AND in_won GROUP BY ALL) SELECT s.corp_code, s.year, s.report_type, s.basis, s.metric, c.capex FROM s LEFT JOIN c ON s.corp_code = c.corp_code AND s.year = c.year AND s.report_type = c.report_type AND s.basis = c.basis AND s.metric = 'CAPEX'")
def j4(t: Tables) -> DataFrame:
    f = b.facts(t)
    keys = ["corp_code", "year", "report_type", "basis"]
    s = f.select(*keys, "metric").distinct()
    c = f.filter("metric = 'CAPEX' AND in_won").groupBy(*keys).agg(fin.unique_or_null(F.col("value")).alias("capex")).withColumn("metric", F.lit("CAPEX"))
    return s.join(c, [*keys, "metric"], "left").select(*keys, "metric", "capex")


_RECEIPT = "rc AS (SELECT corp_code, year, report_type, CASE WHEN count(DISTINCT rcept_no) = 1 THEN min(rcept_no) END AS active_rcept FROM filings WHERE is_active = 1 GROUP BY 1, 2, 3)"


@R.add("J5_unique_receipt", f"WITH {b.SQL_FACTS}, {_RECEIPT} SELECT f.metric_value_id, (SELECT active_rcept FROM rc WHERE rc.corp_code = f.corp_code AND rc.year = f.year AND rc.report_type = f.report_type) AS active_rcept FROM facts f")
def j5(t: Tables) -> DataFrame:
    r = fx.active_receipts(t.filings).select("corp_code", "year", "report_type", "active_rcept")
    return b.facts(t).join(r, ["corp_code", "year", "report_type"], "left").select("metric_value_id", "active_rcept")


@R.add("J6_grouped_receipts", f"WITH {b.SQL_FACTS}, {_RECEIPT} SELECT f.metric_value_id, f.rcept = rc.active_rcept AS from_active FROM facts f LEFT JOIN rc USING (corp_code, year, report_type)")
def j6(t: Tables) -> DataFrame:
    r = fx.active_receipts(t.filings).select("corp_code", "year", "report_type", "active_rcept")
    return b.facts(t).join(r, ["corp_code", "year", "report_type"], "left").select("metric_value_id", (F.col("rcept") == F.col("active_rcept")).alias("from_active"))


@R.add("J7_anti_residual", f"WITH {b.SQL_FACTS} SELECT f.metric_value_id FROM facts f WHERE source_kind = 'DERIVED' AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.source_kind = 'DIRECT' AND d.corp_code = f.corp_code AND d.year = f.year AND d.report_type = f.report_type AND d.basis = f.basis AND d.metric = f.metric AND (d.value_type <> 'cumulative' OR d.value = f.value))")
def j7(t: Tables) -> DataFrame:
    keys = ["corp_code", "year", "report_type", "basis", "metric"]
    d = b.facts(t).filter("source_kind = 'DIRECT'").select(*(F.col(k).alias(f"d_{k}") for k in keys), F.col("value_type").alias("d_type"), F.col("value").alias("d_value"))
    f = b.facts(t).filter("source_kind = 'DERIVED'")
    on = (F.col("d_type") != "cumulative") | (F.col("d_value") == F.col("value"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"d_{k}"))
    return f.join(d, on, "left_anti").select("metric_value_id")


@R.add("J8_exists_or_exists", f"WITH {b.SQL_FACTS} SELECT DISTINCT f.corp_code, f.year, f.report_type FROM filings f WHERE EXISTS (SELECT 1 FROM facts x WHERE x.corp_code = f.corp_code AND x.year = f.year AND x.report_type = f.report_type) OR EXISTS (SELECT 1 FROM coverage c WHERE c.corp_code = f.corp_code AND c.year = f.year AND c.report_type = f.report_type AND c.filing_exists = 1)")
def j8(t: Tables) -> DataFrame:
    keys = ["corp_code", "year", "report_type"]
    either = b.facts(t).select(*keys).unionByName(t.coverage.filter("filing_exists = 1").select(*keys)).distinct()
    return t.filings.select(*keys).distinct().join(either, keys, "left_semi")


_PAIRS = "m AS (SELECT DISTINCT chunk_id, vector_id, index_version FROM chunk_metadata WHERE is_active = 1), e AS (SELECT embedding_id, any_value(chunk_id) AS e_chunk, any_value(index_version) AS e_index FROM chunk_embeddings WHERE is_active = 1 GROUP BY 1)"


def _vectors(t: Tables) -> DataFrame:
    return t.chunk_embeddings.filter("is_active = 1").groupBy("embedding_id").agg(F.min("chunk_id").alias("e_chunk"), F.min("index_version").alias("e_index"))


@R.add("J9_integrity_left_join", f"WITH {_PAIRS} SELECT count(*) AS chunks, count(*) FILTER (embedding_id IS NULL) AS without_vector, count(*) FILTER (e_chunk <> chunk_id) AS other_chunk, count(*) FILTER (e_index <> index_version) AS other_index FROM m LEFT JOIN e ON m.vector_id = e.embedding_id")
def j9(t: Tables) -> DataFrame:
    m = t.chunk_metadata.filter("is_active = 1").select("chunk_id", "vector_id", "index_version").distinct()
    j = m.join(_vectors(t), F.col("vector_id") == F.col("embedding_id"), "left")
    return j.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding_id").isNull()).alias("without_vector"), F.count_if(F.col("e_chunk") != F.col("chunk_id")).alias("other_chunk"), F.count_if(F.col("e_index") != F.col("index_version")).alias("other_index"))


@R.add("J10_provenance", f"WITH {b.SQL_CHUNKS}, d AS (SELECT DISTINCT document_id, rcept_no FROM filing_source_documents WHERE is_active = 1) SELECT c.chunk_id, d.document_id, f.corp_code FROM chunks c JOIN d USING (rcept_no) JOIN (SELECT DISTINCT rcept_no, corp_code FROM filings WHERE is_active = 1) f USING (rcept_no)")
def j10(t: Tables) -> DataFrame:
    d = t.filing_source_documents.filter("is_active = 1").select("document_id", "rcept_no").distinct()
    f = t.filings.filter("is_active = 1").select("rcept_no", "corp_code").distinct()
    return b.chunks(t, "rcept_no").join(d, "rcept_no").join(f, "rcept_no").select("chunk_id", "document_id", "corp_code")


@R.add("J11_series_anti", f"WITH {b.SQL_FACTS} SELECT DISTINCT corp_code, year, basis, metric FROM facts f WHERE source_kind <> 'DOCUMENT_EXTRACTED' AND NOT EXISTS (SELECT 1 FROM facts x WHERE x.source_kind = 'DOCUMENT_EXTRACTED' AND x.corp_code = f.corp_code AND x.year = f.year AND x.basis = f.basis AND x.metric = f.metric)")
def j11(t: Tables) -> DataFrame:
    primary = b.facts(t).filter("source_kind = 'DOCUMENT_EXTRACTED'").select("corp_code", "year", "basis", "metric").distinct()
    return b.facts(t).filter("source_kind <> 'DOCUMENT_EXTRACTED'").select("corp_code", "year", "basis", "metric").distinct().join(primary, ["corp_code", "year", "basis", "metric"], "left_anti")


@R.add("J12_previous_year", f"WITH {b.SQL_SLOTS} SELECT a.corp_code, a.year, a.report_type, a.basis, a.metric, a.value_type, a.value, p.value AS prev_value FROM slots a LEFT JOIN slots p ON a.corp_code = p.corp_code AND a.report_type = p.report_type AND a.basis = p.basis AND a.metric = p.metric AND a.value_type = p.value_type AND p.year = a.year - 1")
def j12(t: Tables) -> DataFrame:
    from ledgerloom.operators.quarters import previous_year

    keys = [c for c in fx.SLOT if c != "year"]
    return previous_year(b.slots(t), keys, ["value"]).select(*fx.SLOT, "value", "prev_value")


@R.add("J13_previous_quarter", f"WITH {b.SQL_SERIES} SELECT a.corp_code, a.basis, a.year, a.quarter, a.revenue, p.revenue AS prev_revenue FROM series a LEFT JOIN series p ON a.corp_code = p.corp_code AND a.basis = p.basis AND p.year * 4 + p.quarter = a.year * 4 + a.quarter - 1")
def j13(t: Tables) -> DataFrame:
    from ledgerloom.operators.quarters import previous_quarter

    return previous_quarter(b.series(t), ["revenue"]).select("corp_code", "basis", "year", "quarter", "revenue", "prev_revenue")


@R.add("J14_vector_contract", f"WITH {_PAIRS} SELECT chunk_id, vector_id, e_chunk = chunk_id AND e_index = index_version AS agrees FROM m JOIN e ON m.vector_id = e.embedding_id")
def j14(t: Tables) -> DataFrame:
    m = t.chunk_metadata.filter("is_active = 1").select("chunk_id", "vector_id", "index_version").distinct()
    return m.join(_vectors(t), F.col("vector_id") == F.col("embedding_id")).select("chunk_id", "vector_id", ((F.col("e_chunk") == F.col("chunk_id")) & (F.col("e_index") == F.col("index_version"))).alias("agrees"))


@R.add("J15_grouped_members", "SELECT n_name, count(s_suppkey) AS members, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS ids FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def j15(t: Tables) -> DataFrame:
    j = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",")
    return j.groupBy("n_name").agg(F.count("s_suppkey").alias("members"), ids.alias("ids"))


# Aggregations


@R.add("A1_unique_or_null", f"WITH {b.SQL_SLOTS} SELECT corp_code, year, report_type, basis, metric, value_type, value FROM slots")
def a1(t: Tables) -> DataFrame:
    return b.slots(t).select(*fx.SLOT, "value")


@R.add("A2_unique_in_sections", f"WITH {b.SQL_FACTS}, s AS (SELECT corp_code, year, report_type, basis, metric, source_kind, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS v, count(DISTINCT value) > 1 AS c FROM facts WHERE in_won GROUP BY ALL) SELECT corp_code, year, report_type, basis, metric, coalesce(max(v) FILTER (source_kind = 'DIRECT'), max(v) FILTER (source_kind = 'DOCUMENT_EXTRACTED'), max(v) FILTER (source_kind = 'DERIVED')) AS value, bool_or(c) AS conflict FROM s GROUP BY 1, 2, 3, 4, 5")
def a2(t: Tables) -> DataFrame:
    return fx.first_section_value(b.won_facts(t), ["corp_code", "year", "report_type", "basis", "metric"], "source_kind", ["DIRECT", "DOCUMENT_EXTRACTED", "DERIVED"])


@R.add("A3_period_counts", f"WITH {b.SQL_CHUNKS} SELECT year, report_type, count(*) AS n FROM chunks GROUP BY 1, 2")
def a3(t: Tables) -> DataFrame:
    return b.chunks(t, "year", "report_type").groupBy("year", "report_type").agg(F.count(F.lit(1)).alias("n"))


@R.add("A4_zero_filled", f"WITH {b.SQL_CHUNKS}, {b.SQL_COMPANIES} SELECT corp_code, count(chunk_id) AS n FROM companies LEFT JOIN (SELECT * FROM chunks WHERE year = 2025) c USING (corp_code) GROUP BY 1")
def a4(t: Tables) -> DataFrame:
    n = b.chunks(t, "year", "corp_code").filter("year = 2025").groupBy("corp_code").agg(F.count(F.lit(1)).alias("n"))
    return b.companies(t).select("corp_code").join(n, "corp_code", "left").select("corp_code", F.coalesce("n", F.lit(0)).alias("n"))


@R.add("A6_reindexed_totals", f"WITH {b.SQL_CHUNKS}, y AS (SELECT unnest(range(2016, 2028))::INT AS year) SELECT y.year, count(c.chunk_id) AS total, CASE WHEN count(c.chunk_id) > 0 THEN round(count(*) FILTER (contains(c.text, '특허')) / count(c.chunk_id), 9) END AS rate FROM y LEFT JOIN chunks c USING (year) GROUP BY 1")
def a6(t: Tables) -> DataFrame:
    years = t.spark.range(2016, 2028).select(F.col("id").cast("int").alias("year"))
    n = b.chunks(t, "year", "text").groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("text").contains("특허")).alias("hits"))
    j = years.join(n, "year", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return j.select("year", "total", F.when(F.col("total") > 0, F.round(F.col("hits") / F.col("total"), 9)).alias("rate"))


@R.add("A7_distinct_years", "SELECT DISTINCT year FROM filings WHERE is_active = 1 ORDER BY 1")
def a7(t: Tables) -> DataFrame:
    return t.filings.filter("is_active = 1").select("year").distinct().orderBy("year")


@R.add("A8_section_listing", f"WITH {b.SQL_CHUNKS} SELECT rcept_no, section_name, subsection_name, min(vector_id) AS first_vector FROM chunks WHERE corp_code = '00000990' GROUP BY 1, 2, 3")
def a8(t: Tables) -> DataFrame:
    rows = b.chunks(t, "corp_code", "rcept_no", "section_name", "subsection_name", "vector_id").filter("corp_code = '00000990'")
    return rows.groupBy("rcept_no", "section_name", "subsection_name").agg(F.min("vector_id").alias("first_vector")).orderBy("first_vector")


@R.add("A9_coverage_summary", "SELECT data_version, count(DISTINCT (corp_code, year, report_type)) AS periods, count(DISTINCT corp_code) AS companies, count(*) FILTER (chunk_exists = 0) AS without_chunks, count(*) FILTER (embedding_exists = 0) AS without_embeddings, count(*) FILTER (upper(trim(status)) <> 'PASS') AS not_pass FROM coverage GROUP BY 1")
def a9(t: Tables) -> DataFrame:
    return fx.coverage_summary(t.coverage)


@R.add("A10_integrity_counts", "SELECT index_version, count(*) AS n, count(DISTINCT vector_id) AS vectors, sum(CASE WHEN vector_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS without FROM chunk_metadata GROUP BY 1")
def a10(t: Tables) -> DataFrame:
    return t.chunk_metadata.groupBy("index_version").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vector_id").alias("vectors"), F.sum(F.when(F.col("vector_id").isNull(), 1).otherwise(0)).alias("without"))


@R.add("A11_industry_median", f"WITH {b.SQL_ANNUAL} SELECT basis, year, median(revenue) AS median_revenue, count(revenue) AS n FROM annual GROUP BY 1, 2")
def a11(t: Tables) -> DataFrame:
    return b.annual(t).groupBy("basis", "year").agg(F.median("revenue").alias("median_revenue"), F.count("revenue").alias("n"))


@R.add("A12_latest_common_median", f"WITH {b.SQL_SERIES}, p AS (SELECT basis, year * 4 + quarter AS period, count(revenue) AS n, median(revenue) AS median_revenue FROM series GROUP BY 1, 2), m AS (SELECT basis, max(period) AS period FROM p WHERE n >= 2 GROUP BY 1) SELECT p.* FROM p JOIN m USING (basis, period)")
def a12(t: Tables) -> DataFrame:
    p = b.series(t).groupBy("basis", (F.col("year") * 4 + F.col("quarter")).alias("period")).agg(F.count("revenue").alias("n"), F.median("revenue").alias("median_revenue"))
    last = p.filter("n >= 2").groupBy("basis").agg(F.max("period").alias("period"))
    return p.join(last, ["basis", "period"])


@R.add("A13_weighted_mean", "SELECT s_nationkey, CASE WHEN count(*) FILTER (s_acctbal <= 0) = 0 THEN round(sum(s_suppkey * s_acctbal) / sum(s_acctbal), 6) END AS mean FROM supplier GROUP BY 1")
def a13(t: Tables) -> DataFrame:
    return t.supplier.groupBy("s_nationkey").agg(F.round(fin.weighted_mean(F.col("s_suppkey"), F.col("s_acctbal")), 6).alias("mean"))


@R.add("A14_cap_weights", "SELECT s_suppkey, CASE WHEN min(s_acctbal) OVER (PARTITION BY s_nationkey) > 0 THEN round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 8) END AS weight FROM supplier")
def a14(t: Tables) -> DataFrame:
    return rk.capital_weights(t.supplier, ["s_nationkey"], "s_acctbal").select("s_suppkey", F.round("weight", 8).alias("weight"))


@R.add("A18_fact_groups", f"WITH {b.SQL_FACTS} SELECT corp_code, year, report_type, basis, value_type, count(*) AS facts, count(DISTINCT metric) AS metrics FROM facts GROUP BY ALL")
def a18(t: Tables) -> DataFrame:
    return b.facts(t).groupBy("corp_code", "year", "report_type", "basis", "value_type").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("metric").alias("metrics"))


@R.add("A20_presence_counts", "SELECT 'chunk_metadata' AS table_name, data_version, count(*) AS n FROM chunk_metadata GROUP BY 2 UNION ALL SELECT 'chunk_embeddings', data_version, count(*) FROM chunk_embeddings GROUP BY 2 UNION ALL SELECT 'filings', data_version, count(*) FROM filings GROUP BY 2")
def a20(t: Tables) -> DataFrame:
    parts = [getattr(t, n).groupBy("data_version").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "data_version", "n") for n in ("chunk_metadata", "chunk_embeddings", "filings")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Set operations


@R.add("U1_literal_relation", "SELECT * FROM (VALUES ('REVENUE', 'SALES', 1), ('OPERATINGINCOME', 'PROFIT', 1), ('NETINCOME', 'PROFIT', 2), ('CAPEX', 'INVESTMENT', 1), ('RNDEXPENSE', 'INVESTMENT', 2)) v(metric, account, priority)")
def u1(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(b.TAGS, "metric string, account string, priority int")


_TAGGED = b.SQL_FACTS + ", tags AS (SELECT * FROM (VALUES ('REVENUE', 'SALES', 1), ('OPERATINGINCOME', 'PROFIT', 1), ('NETINCOME', 'PROFIT', 2), ('CAPEX', 'INVESTMENT', 1), ('RNDEXPENSE', 'INVESTMENT', 2)) v(metric, account, priority)), cand AS (SELECT f.*, coalesce(t.account, f.metric) AS account, coalesce(t.priority, 9) AS priority FROM facts f LEFT JOIN tags t USING (metric))"


@R.add("U2_tagged_and_fallback", f"WITH {_TAGGED} SELECT metric_value_id, account, priority FROM cand")
def u2(t: Tables) -> DataFrame:
    return fx.tagged_candidates(b.facts(t), b.TAGS).select("metric_value_id", "account", "priority")


@R.add("U3_reported_and_capex", f"WITH {b.SQL_FACTS} SELECT metric_value_id, 'reported' AS part, value FROM facts WHERE metric <> 'CAPEX' UNION ALL SELECT metric_value_id, 'capex', abs(value) FROM facts WHERE metric = 'CAPEX'")
def u3(t: Tables) -> DataFrame:
    f = b.facts(t)
    return f.filter("metric <> 'CAPEX'").select("metric_value_id", F.lit("reported").alias("part"), "value").unionByName(f.filter("metric = 'CAPEX'").select("metric_value_id", F.lit("capex").alias("part"), F.abs("value").alias("value")))


@R.add("U4_view_and_fallback", f"WITH {b.SQL_FACTS} SELECT metric_value_id, 'view' AS part FROM facts WHERE source_kind = 'DIRECT' UNION ALL SELECT metric_value_id, 'fallback' FROM facts f WHERE source_kind <> 'DIRECT' AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.source_kind = 'DIRECT' AND d.corp_code = f.corp_code AND d.year = f.year AND d.report_type = f.report_type AND d.basis = f.basis AND d.metric = f.metric)")
def u4(t: Tables) -> DataFrame:
    keys = ["corp_code", "year", "report_type", "basis", "metric"]
    f = b.facts(t)
    view = f.filter("source_kind = 'DIRECT'")
    rest = f.filter("source_kind <> 'DIRECT'").join(view.select(*keys).distinct(), keys, "left_anti")
    return view.select("metric_value_id", F.lit("view").alias("part")).unionByName(rest.select("metric_value_id", F.lit("fallback").alias("part")))


@R.add("U5_keep_first", "SELECT rcept_no, min(loaded_at) AS first_loaded FROM filings GROUP BY 1")
def u5(t: Tables) -> DataFrame:
    return rk.keep_first(t.filings.select("rcept_no", "loaded_at"), ["rcept_no"], [F.col("loaded_at")]).select("rcept_no", F.col("loaded_at").alias("first_loaded"))


@R.add("U6_keyword_set_algebra", f"WITH {b.SQL_CHUNKS} SELECT chunk_id, len(list_distinct(string_split(keyword, ',')))::INT AS all_words, len(list_intersect(list_distinct(string_split(keyword, ',')), ['사업', '매출']))::INT AS common_words FROM chunks WHERE keyword IS NOT NULL")
def u6(t: Tables) -> DataFrame:
    words = F.array_distinct(F.split("keyword", ",", -1))
    return b.chunks(t, "keyword").filter("keyword IS NOT NULL").select("chunk_id", F.size(words).alias("all_words"), F.size(F.array_intersect(words, F.array(F.lit("사업"), F.lit("매출")))).alias("common_words"))


@R.add("U7_missing_members", "SELECT DISTINCT corp_code, year, report_type FROM filings f WHERE corp_code IS NOT NULL AND year IS NOT NULL AND report_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk_metadata c WHERE c.corp_code = f.corp_code AND c.year = f.year AND c.report_type = f.report_type)")
def u7(t: Tables) -> DataFrame:
    """Company periods that filed and are not built into chunks."""
    period = ["corp_code", "year", "report_type"]
    return t.filings.select(*period).dropna().distinct().join(t.chunk_metadata.select(*period), period, "left_anti")


@R.add("A5_document_frequency", f"WITH {b.SQL_CHUNKS}, k AS (SELECT DISTINCT chunk_id, year, trim(unnest(string_split(keyword, ',')), ' ') AS word FROM chunks WHERE keyword IS NOT NULL) SELECT word, year, count(*) AS n FROM k WHERE word <> '' GROUP BY 1, 2")
def a5(t: Tables) -> DataFrame:
    # words are unique within a chunk, so a count is a count of chunks
    w = F.array_distinct(F.transform(F.split("keyword", ",", -1), lambda x: F.trim(x)))
    return b.chunks(t, "keyword", "year").filter("keyword IS NOT NULL").select("year", F.explode(w).alias("word")).filter("word <> ''").groupBy("word", "year").agg(F.count(F.lit(1)).alias("n"))


_WORDS = b.SQL_CHUNKS + ", k AS (SELECT DISTINCT chunk_id, corp_code, year, trim(unnest(string_split(keyword, ',')), ' ') AS word FROM chunks WHERE keyword IS NOT NULL), n AS (SELECT word, corp_code, count(*)::DOUBLE AS n FROM k WHERE word <> '' GROUP BY 1, 2), tot AS (SELECT corp_code, count(*)::DOUBLE AS total FROM chunks GROUP BY 1)"


@R.add("A15_entropy", f"WITH {_WORDS}, r AS (SELECT word, n / total AS r, (SELECT count(*) FROM tot) AS c FROM n JOIN tot USING (corp_code)), p AS (SELECT word, r / sum(r) OVER (PARTITION BY word) AS p, c FROM r) SELECT word, round(greatest(0, least(100, -sum(p * ln(p)) / ln(max(c)) * 100)), 6) AS entropy FROM p GROUP BY 1")
def a15(t: Tables) -> DataFrame:
    j = _word_company(t)
    return j.groupBy("word").agg(F.round(fin.entropy_score(F.col("n"), F.col("total"), F.max("companies")), 6).alias("entropy"))


def _word_company(t: Tables) -> DataFrame:
    c = b.chunks(t, "keyword", "corp_code")
    w = F.array_distinct(F.transform(F.split("keyword", ",", -1), lambda x: F.trim(x)))
    n = c.filter("keyword IS NOT NULL").select("corp_code", F.explode(w).alias("word")).filter("word <> ''").groupBy("word", "corp_code").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tot = c.groupBy("corp_code").agg(F.count(F.lit(1)).cast("double").alias("total"))
    size = tot.agg(F.count(F.lit(1)).alias("companies"))
    # one row
    return n.join(tot, "corp_code").join(F.broadcast(size))


@R.add("A16_max_share", f"WITH {_WORDS} SELECT word, round(max(n) / sum(n), 9) AS max_share, sum(n) AS total FROM n WHERE corp_code IS NOT NULL GROUP BY 1")
def a16(t: Tables) -> DataFrame:
    return _word_company(t).groupBy("word").agg(F.round(F.max("n") / F.sum("n"), 9).alias("max_share"), F.sum("n").alias("total"))


@R.add("A17_mentions_per_receipt", f"WITH {b.SQL_CHUNKS} SELECT rcept_no, sum(len(regexp_extract_all(text, '설비')))::BIGINT AS mentions FROM chunks WHERE text IS NOT NULL GROUP BY 1 HAVING mentions > 0")
def a17(t: Tables) -> DataFrame:
    rows = b.chunks(t, "rcept_no", "text").filter("text IS NOT NULL")
    return rows.groupBy("rcept_no").agg(F.sum(F.regexp_count("text", F.lit("설비"))).alias("mentions")).filter("mentions > 0")


@R.add("A19_novelty", f"WITH {b.SQL_CHUNKS}, k AS (SELECT chunk_id, keyword, section_name, trim(unnest(string_split(keyword, ',')), ' ') AS word FROM chunks WHERE keyword IS NOT NULL) SELECT word, round(count(DISTINCT section_name) / count(DISTINCT chunk_id), 9) AS c2, round(count(DISTINCT keyword) / count(DISTINCT chunk_id), 9) AS c3 FROM k WHERE word <> '' GROUP BY 1")
def a19(t: Tables) -> DataFrame:
    w = F.array_distinct(F.transform(F.split("keyword", ",", -1), lambda x: F.trim(x)))
    rows = b.chunks(t, "keyword", "section_name").filter("keyword IS NOT NULL").select("chunk_id", "keyword", "section_name", F.explode(w).alias("word")).filter("word <> ''")
    n = F.count_distinct("chunk_id")
    return rows.groupBy("word").agg(F.round(F.count_distinct("section_name") / n, 9).alias("c2"), F.round(F.count_distinct("keyword") / n, 9).alias("c3"))


__all__ = ["QUERIES", "SQL", "Window"]
