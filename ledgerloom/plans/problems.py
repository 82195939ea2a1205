"""Queries of the general data problems (p2 to p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import integrity, nested, snapshots, units, wide
from ledgerloom.sources.tables import table


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.all_deltas({name: table(spark, sf, name) for name in integrity.disclosure_participants()})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    deltas = _deltas(spark, sf)
    return integrity.orphan_references(deltas, integrity.apply_deltas(deltas)).select("table_name", "column_name", "record_id")


def p2_per_period(spark: SparkSession, sf: str) -> DataFrame:
    deltas = _deltas(spark, sf)
    return integrity.orphans_per_period(integrity.orphan_references(deltas, integrity.apply_deltas(deltas)))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    versions = table(spark, sf, "data_versions")
    parts = [("chunk_metadata_history", snapshots.CHUNK_HISTORY), ("coverage", snapshots.COVERAGE)]
    found = [snapshots.snapshot_changes(table(spark, sf, name), versions, **how).select(F.lit(name).alias("table_name"), "data_version", "record_key", "change_kind") for name, how in parts]
    return found[0].unionByName(found[1])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    parsed = nested.parse(table(spark, sf, "filing_source_documents"))
    return nested.cells(parsed).select("document_id", "section_no", "parent_section_no", "table_no", "parent_table_no", "row_no", "cell_no")


def p4_sections(spark: SparkSession, sf: str) -> DataFrame:
    return nested.sections(nested.parse(table(spark, sf, "filing_source_documents")))


def p4_tables(spark: SparkSession, sf: str) -> DataFrame:
    return nested.tables(nested.parse(table(spark, sf, "filing_source_documents")))


def p4_rows(spark: SparkSession, sf: str) -> DataFrame:
    return nested.rows(nested.parse(table(spark, sf, "filing_source_documents")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return units.same_quantity(units.normalize_units(table(spark, sf, "financial_metric_values"), table(spark, sf, "metric_definitions")))


def p5_common_units(spark: SparkSession, sf: str) -> DataFrame:
    definitions = table(spark, sf, "metric_definitions")
    return units.one_per_record(units.normalize_units(table(spark, sf, "financial_metric_values"), definitions), definitions).drop("scaled")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return wide.filled_cells(wide.wide_table(table(spark, sf, "financial_metric_values"), table(spark, sf, "metric_definitions")))


def p6_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide.wide_table(table(spark, sf, "financial_metric_values"), table(spark, sf, "metric_definitions")).drop("filled_codes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_per_period, p3_found, p4_found, p4_sections, p4_tables, p4_rows, p5_found, p5_common_units, p6_found, p6_wide)
}

_ONCE = """
WITH cm AS (SELECT chunk_id AS id, vector_id, regexp_replace(rcept_no, '[^0-9]', '', 'g') AS r, is_active, min(loaded_at) AS since
            FROM chunk_metadata GROUP BY ALL),
ce AS (SELECT embedding_id AS id, is_active, min(loaded_at) AS since FROM chunk_embeddings GROUP BY ALL),
fi AS (SELECT regexp_replace(rcept_no, '[^0-9]', '', 'g') AS r, min(loaded_at) AS since FROM filings WHERE is_active = 1 GROUP BY 1),
sd AS (SELECT document_id AS id, regexp_replace(rcept_no, '[^0-9]', '', 'g') AS r, min(loaded_at) AS since FROM filing_source_documents GROUP BY 1, 2),
fm AS (SELECT metric_value_id AS id, regexp_replace(source_rcept_no, '[^0-9]', '', 'g') AS r, min(loaded_at) AS since FROM financial_metric_values GROUP BY 1, 2),
refs AS (
  SELECT 'chunk_metadata' AS table_name, 'vector_id' AS column_name, id AS record_id, since,
         (SELECT min(t.since) FROM ce t WHERE t.is_active = 1 AND t.id = cm.vector_id) AS found FROM cm WHERE vector_id IS NOT NULL
  UNION ALL SELECT 'chunk_metadata', 'rcept_no', id, since, (SELECT min(t.since) FROM fi t WHERE t.r = cm.r) FROM cm WHERE r SIMILAR TO '.*[1-9].*'
  UNION ALL SELECT 'chunk_embeddings', 'embedding_id', CAST(id AS VARCHAR), since,
         (SELECT min(t.since) FROM cm t WHERE t.is_active = 1 AND t.vector_id = ce.id) FROM ce WHERE id IS NOT NULL
  UNION ALL SELECT 'filing_source_documents', 'rcept_no', id, since, (SELECT min(t.since) FROM fi t WHERE t.r = sd.r) FROM sd WHERE r SIMILAR TO '.*[1-9].*'
  UNION ALL SELECT 'financial_metric_values', 'source_rcept_no', CAST(id AS VARCHAR), since, (SELECT min(t.since) FROM fi t WHERE t.r = fm.r) FROM fm WHERE r SIMILAR TO '.*[1-9].*'
),
orphans AS (SELECT *, CASE WHEN found IS NULL THEN 'missing' ELSE 'late' END AS reason FROM refs WHERE found IS NULL OR found > since + INTERVAL 24 HOURS)
"""

_CHANGES = """
WITH rel AS (SELECT data_version, row_number() OVER (ORDER BY created_at) - 1 AS i FROM data_versions WHERE validated = 1),
snap AS (
  SELECT DISTINCT 'chunk_metadata_history' AS table_name, i, chunk_id AS k,
    (rcept_no IS NULL, lower(regexp_replace(coalesce(rcept_no, ''), '\\s', '', 'g')), section_name IS NULL, lower(regexp_replace(coalesce(section_name, ''), '\\s', '', 'g')),
     content_hash IS NULL, lower(regexp_replace(coalesce(content_hash, ''), '\\s', '', 'g')), is_searchable)::VARCHAR AS h
  FROM chunk_metadata_history JOIN rel USING (data_version)
  UNION
  SELECT DISTINCT 'coverage', i, corp_code || '|' || year || '|' || report_type,
    (fs_div IS NULL, lower(regexp_replace(coalesce(fs_div, ''), '\\s', '', 'g')), filing_exists, chunk_exists, embedding_exists,
     status IS NULL, lower(regexp_replace(coalesce(status, ''), '\\s', '', 'g')))::VARCHAR
  FROM coverage JOIN rel USING (data_version)
)
SELECT coalesce(b.table_name, a.table_name) AS table_name, r.data_version, coalesce(b.k, a.k) AS record_key,
       CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT *, i + 1 AS n FROM snap WHERE i < (SELECT max(i) FROM rel)) a
FULL JOIN (SELECT * FROM snap WHERE i > 0) b ON a.n = b.i AND a.k = b.k AND a.table_name = b.table_name
JOIN rel r ON r.i = coalesce(b.i, a.n)
WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h
"""

_FILLED = """
WITH v AS (
  SELECT lpad(trim(corp_code), 8, '0') AS corp_code, year,
    CASE upper(trim(report_type)) WHEN '1Q' THEN 'Q1' WHEN '1분기' THEN 'Q1' WHEN 'HY' THEN 'H1' WHEN '반기' THEN 'H1' WHEN '3Q' THEN 'Q3'
      WHEN '3분기' THEN 'Q3' WHEN 'ANNUAL' THEN 'FY' WHEN '사업' THEN 'FY' ELSE upper(trim(report_type)) END AS report_type,
    CASE upper(trim(fs_div)) WHEN '연결' THEN 'CFS' WHEN '별도' THEN 'OFS' ELSE upper(trim(fs_div)) END AS fs_div,
    upper(regexp_replace(metric_code, '[^A-Za-z0-9]', '', 'g')) AS letters, value, value_text
  FROM financial_metric_values)
SELECT DISTINCT corp_code, year, report_type, fs_div, d.metric_code
FROM v JOIN metric_definitions d ON v.letters = upper(replace(d.metric_code, '_', ''))
WHERE corp_code IS NOT NULL AND year IS NOT NULL AND report_type IS NOT NULL AND fs_div IS NOT NULL
  AND (value IS NOT NULL OR regexp_matches(value_text, '[\\p{L}\\p{N}]'))
"""

# The definition table's metrics; all others are whole numbers.
_METRICS = ("REVENUE", "OPERATING_INCOME", "NET_INCOME", "CAPEX", "RND_EXPENSE", "EQUITY", "TOTAL_ASSETS", "OPERATING_CASH_FLOW", "NET_INTEREST_INCOME", "LOANS", "EMPLOYEES", "PRODUCTION_VOLUME", "POWER_CAPACITY", "FLOOR_AREA", "DEBT_RATIO", "AUDIT_OPINION", "CLOSING_DATE", "IS_GOING_CONCERN")
_NUMBER = "coalesce(value, try_cast(regexp_replace(text, '[, ]', '', 'g') AS BIGINT))"
_TYPED = {
    "AUDIT_OPINION": "coalesce(nullif(trim(text), ''), value::VARCHAR)",
    "CLOSING_DATE": """CASE WHEN regexp_full_match(text, '\\s*[0-9]{8}\\s*') THEN try_strptime(trim(text), '%Y%m%d')::DATE WHEN len(regexp_extract_all(text, '[0-9]+')) = 3
      THEN try_cast(lpad(regexp_extract_all(text, '[0-9]+')[1], 4, '0') || '-' || lpad(regexp_extract_all(text, '[0-9]+')[2], 2, '0') || '-' || lpad(regexp_extract_all(text, '[0-9]+')[3], 2, '0') AS DATE) END""",
    "IS_GOING_CONCERN": "CASE WHEN upper(trim(coalesce(text, value::VARCHAR))) IN ('1', 'Y', 'YES', 'TRUE', 'T', '예', '네') THEN true WHEN upper(trim(coalesce(text, value::VARCHAR))) IN ('0', 'N', 'NO', 'FALSE', 'F', '아니오', '아니요') THEN false END",
}
_WIDE = (
    _FILLED.split("SELECT DISTINCT corp_code, year, report_type, fs_div, d.metric_code")[0].replace("letters, value, value_text", """letters, value, value_text,
    (CASE WHEN lower(trim(review_status)) = 'approved' THEN 4 ELSE 0 END) + (CASE source_kind WHEN 'DIRECT' THEN 3 WHEN 'DOCUMENT_EXTRACTED' THEN 2 ELSE 1 END) AS place, loaded_at, metric_value_id""")
    + """, f AS (SELECT corp_code, year, report_type, fs_div, letters, value, CASE WHEN regexp_matches(value_text, '[\\p{L}\\p{N}]') THEN value_text END AS text, place, coalesce(loaded_at, TIMESTAMP '0001-01-01') AS seen, metric_value_id AS id
  FROM v WHERE corp_code IS NOT NULL AND year IS NOT NULL AND report_type IS NOT NULL AND fs_div IS NOT NULL),
b AS (SELECT DISTINCT ON (corp_code, year, report_type, fs_div, letters) * FROM f ORDER BY corp_code, year, report_type, fs_div, letters, (value IS NOT NULL OR text IS NOT NULL) DESC, place DESC, seen DESC, id DESC, value DESC NULLS LAST)
SELECT corp_code, year, report_type, fs_div, """
    + ", ".join(f"max(CASE WHEN letters = '{m.replace('_', '')}' THEN {_TYPED.get(m, _NUMBER)} END) AS \"{m}\"" for m in _METRICS)
    + " FROM b JOIN metric_definitions d ON b.letters = upper(replace(d.metric_code, '_', '')) GROUP BY 1, 2, 3, 4"
)

SQL = {
    "p6_wide": _WIDE,
    "p2_found": _ONCE + "SELECT table_name, column_name, record_id FROM orphans",
    "p2_per_period": _ONCE + "SELECT table_name, column_name, strftime(since, '%Y-%m') AS period, count(*) AS orphans, count(*) FILTER (reason = 'late') AS late FROM orphans GROUP BY ALL",
    "p3_found": _CHANGES,
    "p6_found": _FILLED,
}
