"""Shared relations of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import canonical
from ledgerloom.operators import facts as fx
from ledgerloom.operators import quarters as qx
from ledgerloom.plans.registry import Tables

TAGS = [("REVENUE", "SALES", 1), ("OPERATINGINCOME", "PROFIT", 1), ("NETINCOME", "PROFIT", 2), ("CAPEX", "INVESTMENT", 1), ("RNDEXPENSE", "INVESTMENT", 2)]
METRICS = {"revenue": "REVENUE", "operating_income": "OPERATINGINCOME", "net_income": "NETINCOME", "capex": "CAPEX", "rd": "RNDEXPENSE", "operating_cash_flow": "OPERATINGCASHFLOW", "net_interest_income": "NETINTERESTINCOME"}

SQL_FACTS = """facts AS (SELECT DISTINCT metric_value_id, lpad(trim(corp_code), 8, '0') AS corp_code, year,
  CASE upper(trim(report_type)) WHEN '1Q' THEN 'Q1' WHEN '1분기' THEN 'Q1' WHEN 'HY' THEN 'H1' WHEN '반기' THEN 'H1' WHEN '3Q' THEN 'Q3'
    WHEN '3분기' THEN 'Q3' WHEN 'ANNUAL' THEN 'FY' WHEN '사업' THEN 'FY' ELSE upper(trim(report_type)) END AS report_type,
  CASE upper(trim(fs_div)) WHEN '연결' THEN 'CFS' WHEN '별도' THEN 'OFS' ELSE upper(trim(fs_div)) END AS basis,
  upper(regexp_replace(metric_code, '[^A-Za-z0-9]', '', 'g')) AS metric, value_type, value,
  lower(trim(unit)) IN ('krw', 'won', '원', '₩') AS in_won, source_kind, review_status,
  CASE WHEN regexp_matches(source_rcept_no, '[1-9]') THEN regexp_replace(source_rcept_no, '[^0-9]', '', 'g') END AS rcept
  FROM financial_metric_values
  WHERE corp_code IS NOT NULL AND year IS NOT NULL AND report_type IS NOT NULL AND fs_div IS NOT NULL AND metric_code IS NOT NULL)"""

SQL_SLOTS = SQL_FACTS + """, slots AS (SELECT corp_code, year, report_type, basis, metric, value_type,
  CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict
  FROM facts WHERE in_won GROUP BY ALL)"""

_CELL = "CASE WHEN count(DISTINCT value) FILTER (report_type = '{}' AND value_type = '{}') = 1 THEN min(value) FILTER (report_type = '{}' AND value_type = '{}') END::DOUBLE AS {}"
_KINDS = ", ".join(_CELL.format(rt, kind, rt, kind, name) for (rt, kind), name in qx.KINDS.items())
SQL_QUARTERS = SQL_FACTS + f""", wide AS (SELECT corp_code, basis, metric, year, {_KINDS} FROM facts WHERE in_won GROUP BY 1, 2, 3, 4),
tot AS (SELECT *, coalesce(c1, q1) AS t1, coalesce(c2, q1 + q2) AS t2, coalesce(c3, q1 + q2 + q3) AS t3, coalesce(a, q1 + q2 + q3 + q4) AS t4 FROM wide),
quarters AS (
  SELECT corp_code, basis, metric, year, 1 AS quarter, coalesce(q1, t1, t4 - (q2 + q3 + q4)) AS value,
    CASE WHEN q1 IS NOT NULL THEN 'stored' WHEN t1 IS NOT NULL THEN 'cumulative difference' WHEN t4 - (q2 + q3 + q4) IS NOT NULL THEN 'annual minus others' END AS method FROM tot
  UNION ALL SELECT corp_code, basis, metric, year, 2, coalesce(q2, t2 - t1, t4 - (q1 + q3 + q4)),
    CASE WHEN q2 IS NOT NULL THEN 'stored' WHEN t2 - t1 IS NOT NULL THEN 'cumulative difference' WHEN t4 - (q1 + q3 + q4) IS NOT NULL THEN 'annual minus others' END FROM tot
  UNION ALL SELECT corp_code, basis, metric, year, 3, coalesce(q3, t3 - t2, t4 - (q1 + q2 + q4)),
    CASE WHEN q3 IS NOT NULL THEN 'stored' WHEN t3 - t2 IS NOT NULL THEN 'cumulative difference' WHEN t4 - (q1 + q2 + q4) IS NOT NULL THEN 'annual minus others' END FROM tot
  UNION ALL SELECT corp_code, basis, metric, year, 4, coalesce(q4, t4 - t3, t4 - (q1 + q2 + q3)),
    CASE WHEN q4 IS NOT NULL THEN 'stored' WHEN t4 - t3 IS NOT NULL THEN 'cumulative difference' WHEN t4 - (q1 + q2 + q3) IS NOT NULL THEN 'annual minus others' END FROM tot)"""
_COLS = ", ".join(f"max(value) FILTER (metric = '{code}') AS {name}" for name, code in METRICS.items())
SQL_SERIES = SQL_QUARTERS + f""", series AS (SELECT corp_code, basis, year, quarter, {_COLS} FROM quarters
  WHERE metric IN ({", ".join(repr(c) for c in METRICS.values())}) GROUP BY 1, 2, 3, 4)"""
_ANNUAL = ", ".join(f"max(value) FILTER (metric = '{code}')::DOUBLE AS {name}" for name, code in METRICS.items())
SQL_ANNUAL = SQL_SLOTS + f""", annual AS (SELECT corp_code, basis, year, {_ANNUAL} FROM slots WHERE report_type = 'FY' AND value_type = 'annual' GROUP BY 1, 2, 3)"""
SQL_COMPANIES = "companies AS (SELECT corp_code, max(corp_name) AS corp_name FROM chunk_metadata WHERE corp_code IS NOT NULL GROUP BY 1)"
SQL_CHUNKS = """chunks AS (SELECT DISTINCT ON (chunk_id) chunk_id, vector_id, corp_code, corp_name, year, report_type, rcept_no, section_name, subsection_name, text, keyword,
  content_hash, token_count, is_searchable, index_version, data_version, is_active FROM chunk_metadata WHERE chunk_id IS NOT NULL ORDER BY chunk_id, loaded_at)"""
CHUNK_COLUMNS = ["chunk_id", "vector_id", "corp_code", "corp_name", "year", "report_type", "rcept_no", "section_name", "subsection_name", "text", "keyword", "content_hash", "token_count", "is_searchable", "index_version", "data_version", "is_active"]


def facts(t: Tables) -> DataFrame:
    return fx.facts(t.financial_metric_values)


def won_facts(t: Tables) -> DataFrame:
    return facts(t).filter("in_won")


def slots(t: Tables) -> DataFrame:
    return fx.slots(won_facts(t))


def quarters(t: Tables) -> DataFrame:
    return qx.deaccumulate(qx.flow_columns(won_facts(t)))


def series(t: Tables) -> DataFrame:
    return qx.metric_columns(quarters(t), METRICS)


def annual(t: Tables) -> DataFrame:
    rows = slots(t).filter("report_type = 'FY' AND value_type = 'annual'")
    return rows.groupBy("corp_code", "basis", "year").agg(*(F.max(F.when(F.col("metric") == code, F.col("value"))).cast("double").alias(name) for name, code in METRICS.items()))


def companies(t: Tables) -> DataFrame:
    return t.chunk_metadata.filter("corp_code IS NOT NULL").groupBy("corp_code").agg(F.max("corp_name").alias("corp_name"))


def chunks(t: Tables, *columns: str) -> DataFrame:
    """Each chunk's first delivery, only the named columns."""
    names = [c for c in (columns or CHUNK_COLUMNS) if c != "chunk_id"]
    rows = t.chunk_metadata.filter("chunk_id IS NOT NULL")
    return rows.groupBy("chunk_id").agg(F.min_by(F.struct(*names), F.struct("loaded_at", *names)).alias("r")).select("chunk_id", *(F.col(f"r.{c}").alias(c) for c in names))


def digits(c: str):
    return canonical.receipt_digits(F.col(c))
