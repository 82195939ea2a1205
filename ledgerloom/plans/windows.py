"""Windows, ranking and time series (W, T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import finance as fin
from ledgerloom.operators import facts as fx
from ledgerloom.operators import market as mk
from ledgerloom.operators import quarters as qx
from ledgerloom.operators import ranking as rk
from ledgerloom.plans import base as b
from ledgerloom.plans.signals import SQL_SECTOR
from ledgerloom.plans.registry import Registry, Tables
from ledgerloom.plans.relational import _TAGGED

R = Registry()
QUERIES, SQL = R.queries, R.sql
PERIOD = ["corp_code", "basis", "year", "quarter"]
r6 = lambda c: F.round(c, 6)


# Ranking


@R.add("W1_slot_pick", f"WITH {_TAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY corp_code, year, report_type, basis, account, value_type ORDER BY priority, CASE source_kind WHEN 'DIRECT' THEN 1 WHEN 'DOCUMENT_EXTRACTED' THEN 2 ELSE 3 END, metric_value_id) AS rn FROM cand) SELECT metric_value_id, account FROM r WHERE rn = 1")
def w1(t: Tables) -> DataFrame:
    source = rk.ordinal(F.col("source_kind"), ["DIRECT", "DOCUMENT_EXTRACTED"])
    c = fx.tagged_candidates(b.facts(t), b.TAGS)
    return fx.slot_pick(c, ["corp_code", "year", "report_type", "basis", "account", "value_type"], [F.col("priority"), source, F.col("metric_value_id")]).select("metric_value_id", "account")


@R.add("W2_percentile_score", "SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand) * 100, 6)::DOUBLE AS score FROM part")
def w2(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r6(rk.percentile_score(F.col("p_size"), ["p_brand"])).alias("score"))


@R.add("W3_midrank_position", f"WITH {b.SQL_ANNUAL} SELECT corp_code, basis, year, CASE WHEN count(*) OVER (PARTITION BY basis, year) >= 2 THEN round((rank() OVER (PARTITION BY basis, year ORDER BY revenue) - 1 + 0.5 * count(*) OVER (PARTITION BY basis, year, revenue)) / count(*) OVER (PARTITION BY basis, year) * 100, 6)::DOUBLE END AS position FROM annual WHERE revenue IS NOT NULL")
def w3(t: Tables) -> DataFrame:
    return b.annual(t).filter("revenue IS NOT NULL").select("corp_code", "basis", "year", r6(rk.midrank_position(F.col("revenue"), ["basis", "year"])).alias("position"))


@R.add("W4_weight_ranking", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS weight FROM supplier ORDER BY weight IS NULL, weight DESC, s_suppkey LIMIT 20")
def w4(t: Tables) -> DataFrame:
    w = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("weight"))
    return w.orderBy(F.desc_nulls_last("weight"), "s_suppkey").limit(20)


@R.add("W5_configured_order", "SELECT n_name, row_number() OVER (ORDER BY CASE n_regionkey WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END, n_nationkey)::INT AS position FROM nation")
def w5(t: Tables) -> DataFrame:
    # a fixed table of 25 rows
    at = rk.ordinal(F.col("n_regionkey"), [2, 0])
    return t.nation.select("n_name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at, "n_nationkey")).alias("position"))


@R.add("W6_field_order", f"WITH {b.SQL_SLOTS} SELECT corp_code, year, report_type, row_number() OVER (PARTITION BY corp_code, year ORDER BY CASE report_type WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 ELSE 4 END)::INT AS position FROM (SELECT DISTINCT corp_code, year, report_type FROM slots)")
def w6(t: Tables) -> DataFrame:
    p = b.slots(t).select("corp_code", "year", "report_type").distinct()
    return p.withColumn("position", F.row_number().over(Window.partitionBy("corp_code", "year").orderBy(rk.ordinal(F.col("report_type"), fx.REPORT_ORDER))))


@R.add("W12_hot_flags", f"WITH {SQL_SECTOR} SELECT 'all' AS sector, keyword, final_rank, keyword IN (FROM hot) AS hot FROM sector")
def w12(t: Tables) -> DataFrame:
    from ledgerloom.plans.signals import sector_scores

    return rk.hot_flags(sector_scores(t), ["sector"], top_n=30).select("sector", "keyword", "final_rank", "hot")


@R.add("W13_final_rank", "SELECT p_brand, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey)::INT AS final_rank FROM part")
def w13(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_name", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_name", "p_partkey")).alias("final_rank"))


@R.add("W14_display_weight", "WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal AS score, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rk FROM supplier), m AS (SELECT *, min(score) OVER (PARTITION BY s_nationkey) AS lo, max(score) OVER (PARTITION BY s_nationkey) AS hi, count(*) OVER (PARTITION BY s_nationkey) AS n FROM s) SELECT s_suppkey, round(CASE WHEN n = 1 THEN 100.0 WHEN hi > lo THEN 30 + 70 * (0.7 * pow((score - lo) / (hi - lo), 2) + 0.3 * (1 - (rk - 1) / (n - 1))) ELSE 30 + 70 * (1 - (rk - 1) / (n - 1)) END, 6)::DOUBLE AS weight FROM m")
def w14(t: Tables) -> DataFrame:
    s = t.supplier.withColumn("rk", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return s.select("s_suppkey", r6(rk.display_weight(F.col("s_acctbal"), F.col("rk"), ["s_nationkey"])).alias("weight"))


@R.add("W15_best_filing", f"WITH {b.SQL_CHUNKS}, m AS (SELECT corp_code, rcept_no, sum(len(regexp_extract_all(text, '설비')))::BIGINT AS mentions FROM chunks WHERE text IS NOT NULL AND corp_code IS NOT NULL GROUP BY 1, 2) SELECT corp_code, max(mentions) AS mentions, arg_max(rcept_no, (mentions, rcept_no)) AS rcept_no FROM m WHERE rcept_no IS NOT NULL GROUP BY 1")
def w15(t: Tables) -> DataFrame:
    m = b.chunks(t, "corp_code", "rcept_no", "text").filter("text IS NOT NULL AND corp_code IS NOT NULL AND rcept_no IS NOT NULL").groupBy("corp_code", "rcept_no").agg(F.sum(F.regexp_count("text", F.lit("설비"))).alias("mentions"))
    return m.groupBy("corp_code").agg(F.max("mentions").alias("mentions"), F.max_by("rcept_no", F.struct("mentions", "rcept_no")).alias("rcept_no"))


_DAILY = "daily AS (SELECT event_type AS instrument, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


def daily(t: Tables) -> DataFrame:
    return mk.daily_closes(t.events, "event_type", "ts", "value", "event_id")


@R.add("W16_last_two_sessions", f"WITH {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS rn FROM daily WHERE day < DATE '2024-01-25') SELECT c.instrument, c.day, c.close, p.close AS previous, round((c.close - p.close) / p.close * 100, 6) AS change_percent, round(c.close - p.close, 6) AS change_points FROM r c JOIN r p ON c.instrument = p.instrument AND c.rn = 1 AND p.rn = 2")
def w16(t: Tables) -> DataFrame:
    return mk.close_snapshot(daily(t), "2024-01-25").select("instrument", "day", "close", "previous", r6("change_percent").alias("change_percent"), r6("change_points").alias("change_points"))


@R.add("W17_month_end", "WITH d AS (SELECT o_orderpriority AS instrument, o_orderdate::DATE AS day, max(o_totalprice) AS close FROM orders GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY instrument) AS points FROM d) SELECT instrument, day, close FROM n WHERE points <= 80 UNION ALL SELECT instrument, max(day), arg_max(close, day) FROM n WHERE points > 80 GROUP BY instrument, date_trunc('month', day)")
def w17(t: Tables) -> DataFrame:
    d = t.orders.groupBy(F.col("o_orderpriority").alias("instrument"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("close"))
    return mk.month_end(d, 80)


@R.add("W19_latest_history", f"WITH {_DAILY} SELECT instrument, day, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS rn FROM daily) WHERE rn <= 10")
def w19(t: Tables) -> DataFrame:
    return rk.top_per_group(daily(t), ["instrument"], [F.desc("day")], 10).select("instrument", "day", "close")


# Time series


@R.add("T1_ratio", f"WITH {b.SQL_SERIES} SELECT corp_code, basis, year, quarter, CASE WHEN revenue > 0 THEN round(operating_income / revenue * 100, 6) END AS margin FROM series")
def t1(t: Tables) -> DataFrame:
    return b.series(t).select(*PERIOD, r6(fin.ratio(F.col("operating_income"), F.col("revenue"))).alias("margin"))


@R.add("T2_growth", f"WITH {b.SQL_ANNUAL} SELECT a.corp_code, a.basis, a.year, CASE WHEN p.revenue > 0 THEN round((a.revenue - p.revenue) / p.revenue * 100, 6) END AS growth FROM annual a LEFT JOIN annual p ON a.corp_code = p.corp_code AND a.basis = p.basis AND p.year = a.year - 1")
def t2(t: Tables) -> DataFrame:
    return qx.previous_year(b.annual(t), ["corp_code", "basis"], ["revenue"]).select("corp_code", "basis", "year", r6(fin.growth(F.col("revenue"), F.col("prev_revenue"))).alias("growth"))


@R.add("T3_quarter_deaccumulate", f"WITH {b.SQL_QUARTERS} SELECT corp_code, basis, metric, year, quarter, value, method FROM quarters")
def t3(t: Tables) -> DataFrame:
    return b.quarters(t).select("corp_code", "basis", "metric", "year", "quarter", "value", "method")


@R.add("T4_verified_capex_quarter", None)
def t4(t: Tables) -> DataFrame:
    return qx.verified_flow(b.facts(t).filter("metric = 'CAPEX'"), fx.active_receipts(t.filings))


@R.add("T5_capex_gate", f"WITH {b.SQL_FACTS}, g AS (SELECT corp_code, year, report_type, basis, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS v, count(*) FILTER (NOT coalesce(review_status = 'approved' AND in_won AND value >= 0, false)) AS bad FROM facts WHERE metric = 'CAPEX' GROUP BY 1, 2, 3, 4) SELECT corp_code, year, report_type, basis, CASE WHEN bad = 0 THEN v END AS value FROM g")
def t5(t: Tables) -> DataFrame:
    ok = F.coalesce((F.col("review_status") == "approved") & F.col("in_won") & (F.col("value") >= 0), F.lit(False))
    g = b.facts(t).filter("metric = 'CAPEX'").groupBy("corp_code", "year", "report_type", "basis")
    return g.agg(F.when(F.count_if(~ok) == 0, fin.unique_or_null(F.col("value"))).alias("value"))


@R.add("T6_account_signature", "SELECT DISTINCT metric_value_id, CASE WHEN contains(source_account_name, '유형자산의 취득') THEN 'PPE' ELSE list_aggregate(list_sort(list_distinct(string_split(source_account_name, ' '))), 'string_agg', '|') END AS signature FROM financial_metric_values WHERE source_account_name IS NOT NULL")
def t6(t: Tables) -> DataFrame:
    name = F.col("source_account_name")
    words = F.array_join(F.array_sort(F.array_distinct(F.split(name, " ", -1))), "|")
    return t.financial_metric_values.filter(name.isNotNull()).select("metric_value_id", F.when(name.contains("유형자산의 취득"), "PPE").otherwise(words).alias("signature")).distinct()


@R.add("T7_base_index", f"WITH {b.SQL_SERIES} SELECT s.corp_code, s.basis, s.year, s.quarter, CASE WHEN x.revenue > 0 THEN round(s.revenue / x.revenue * 100, 6) END AS index FROM series s LEFT JOIN series x ON s.corp_code = x.corp_code AND s.basis = x.basis AND x.year = 2021 AND x.quarter = 1")
def t7(t: Tables) -> DataFrame:
    return qx.base_index(b.series(t), "revenue", 2021, 1).select(*PERIOD, r6("index").alias("index"))


@R.add("T8_company_rebase", f"WITH {b.SQL_SERIES}, f AS (SELECT corp_code, basis, min(year * 4 + quarter) AS since, arg_min(revenue, year * 4 + quarter) AS base FROM series WHERE revenue > 0 GROUP BY 1, 2) SELECT corp_code, basis, year, quarter, CASE WHEN year * 4 + quarter >= since THEN round(revenue / base * 100, 6) END AS index FROM series LEFT JOIN f USING (corp_code, basis)")
def t8(t: Tables) -> DataFrame:
    return qx.rebase_first_positive(b.series(t), "revenue").select(*PERIOD, r6("index").alias("index"))


_INDUSTRIAL = "SELECT corp_code, basis, year, quarter, CASE WHEN revenue > 0 THEN round(operating_income / revenue * 100, 6) END AS operating_margin, CASE WHEN revenue > 0 THEN round({0} / revenue * 100, 6) END AS invested_share, CASE WHEN revenue > 0 THEN round((operating_cash_flow - {0}) / revenue * 100, 6) END AS fcf_margin FROM series"


def _industrial(t: Tables, invested: str) -> DataFrame:
    return qx.industrial_metrics(b.series(t), invested).select(*PERIOD, *(r6(c).alias(c) for c in ("operating_margin", "invested_share", "fcf_margin")))


@R.add("T9_industrial_metrics", f"WITH {b.SQL_SERIES} " + _INDUSTRIAL.format("capex"))
def t9(t: Tables) -> DataFrame:
    return _industrial(t, "capex")


@R.add("T10_health_metrics", f"WITH {b.SQL_SERIES} " + _INDUSTRIAL.format("rd"))
def t10(t: Tables) -> DataFrame:
    return _industrial(t, "rd")


_POINTS = b.SQL_FACTS + ", pt AS (SELECT corp_code, basis, year, CASE report_type WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 ELSE 4 END AS quarter, CASE WHEN count(DISTINCT value) FILTER (metric = 'EQUITY') = 1 THEN min(value) FILTER (metric = 'EQUITY') END::DOUBLE AS equity, CASE WHEN count(DISTINCT value) FILTER (metric = 'LOANS') = 1 THEN min(value) FILTER (metric = 'LOANS') END::DOUBLE AS loans, CASE WHEN count(DISTINCT value) FILTER (metric = 'TOTALASSETS') = 1 THEN min(value) FILTER (metric = 'TOTALASSETS') END::DOUBLE AS assets, CASE WHEN count(DISTINCT value) FILTER (metric = 'NETINCOME') = 1 THEN min(value) FILTER (metric = 'NETINCOME') END::DOUBLE AS net_income, CASE WHEN count(DISTINCT value) FILTER (metric = 'NETINTERESTINCOME') = 1 THEN min(value) FILTER (metric = 'NETINTERESTINCOME') END::DOUBLE AS credit_loss FROM facts WHERE in_won GROUP BY 1, 2, 3, 4)"


def point_rows(t: Tables) -> DataFrame:
    cell = lambda m: fin.unique_or_null(F.when(F.col("metric") == m, F.col("value"))).cast("double")
    q = rk.ordinal(F.col("report_type"), ["Q1", "H1", "Q3"]).cast("int")
    names = {"equity": "EQUITY", "loans": "LOANS", "assets": "TOTALASSETS", "net_income": "NETINCOME", "credit_loss": "NETINTERESTINCOME"}
    return b.won_facts(t).groupBy("corp_code", "basis", "year", q.alias("quarter")).agg(*(cell(m).alias(n) for n, m in names.items()))


@R.add("T11_bank_metrics", f"WITH {_POINTS}, j AS (SELECT a.*, p.equity AS pe, p.loans AS pl FROM pt a LEFT JOIN pt p ON a.corp_code = p.corp_code AND a.basis = p.basis AND p.year * 4 + p.quarter = a.year * 4 + a.quarter - 1) SELECT corp_code, basis, year, quarter, CASE WHEN equity + pe > 0 THEN round(net_income * 4 / ((equity + pe) / 2) * 100, 6) END AS roe, CASE WHEN loans + pl > 0 THEN round(credit_loss * 4 / ((loans + pl) / 2) * 100, 6) END AS credit_cost, CASE WHEN assets > 0 THEN round(equity / assets * 100, 6) END AS equity_share FROM j")
def t11(t: Tables) -> DataFrame:
    return qx.bank_metrics(point_rows(t)).select(*PERIOD, *(r6(c).alias(c) for c in ("roe", "credit_cost", "equity_share")))


@R.add("T12_annual_history", f"WITH {b.SQL_ANNUAL}, j AS (SELECT a.*, p.revenue AS pr FROM annual a LEFT JOIN annual p ON a.corp_code = p.corp_code AND a.basis = p.basis AND p.year = a.year - 1) SELECT corp_code, basis, year, CASE WHEN revenue > 0 THEN round(operating_income / revenue * 100, 6) END AS operating_margin, operating_cash_flow - capex AS fcf, CASE WHEN revenue > 0 THEN round((operating_cash_flow - capex) / revenue * 100, 6) END AS fcf_margin, CASE WHEN pr > 0 THEN round((revenue - pr) / pr * 100, 6) END AS revenue_growth FROM j")
def t12(t: Tables) -> DataFrame:
    h = qx.annual_history(b.annual(t))
    return h.select("corp_code", "basis", "year", r6("operating_margin").alias("operating_margin"), "fcf", r6("fcf_margin").alias("fcf_margin"), r6("revenue_growth").alias("revenue_growth"))


@R.add("T13_series_precedence", f"WITH {b.SQL_FACTS}, d AS (SELECT DISTINCT corp_code, year, basis FROM facts WHERE metric = 'RNDEXPENSE' AND source_kind = 'DOCUMENT_EXTRACTED'), u AS (SELECT f.* FROM facts f WHERE metric = 'RNDEXPENSE' AND (source_kind = 'DOCUMENT_EXTRACTED' OR NOT EXISTS (SELECT 1 FROM d WHERE d.corp_code = f.corp_code AND d.year = f.year AND d.basis = f.basis))) SELECT corp_code, year, basis, report_type, CASE WHEN count(DISTINCT value) = 1 AND min(value) >= 0 THEN min(value) END AS value FROM u WHERE in_won GROUP BY 1, 2, 3, 4")
def t13(t: Tables) -> DataFrame:
    return qx.document_precedence(b.facts(t).filter("metric = 'RNDEXPENSE'"))


@R.add("T14_fallback_metric", f"WITH {_POINTS} SELECT corp_code, basis, year, quarter, coalesce(loans, assets) AS loans FROM pt")
def t14(t: Tables) -> DataFrame:
    return point_rows(t).select(*PERIOD, F.coalesce("loans", "assets").alias("loans"))


@R.add("T15_estimation_flags", f"WITH {b.SQL_FACTS} SELECT corp_code, basis, year, bool_or(source_kind = 'DERIVED') FILTER (metric IN ('OPERATINGINCOME', 'REVENUE')) AS margin_estimated, bool_or(source_kind = 'DERIVED') FILTER (metric IN ('CAPEX', 'REVENUE')) AS capex_estimated FROM facts GROUP BY 1, 2, 3")
def t15(t: Tables) -> DataFrame:
    est = lambda *m: F.bool_or(F.when(F.col("metric").isin(*m), F.col("source_kind") == "DERIVED"))
    return b.facts(t).groupBy("corp_code", "basis", "year").agg(est("OPERATINGINCOME", "REVENUE").alias("margin_estimated"), est("CAPEX", "REVENUE").alias("capex_estimated"))


@R.add("T16_comparison", f"WITH {b.SQL_ANNUAL} SELECT a.corp_code, a.basis, a.year, a.revenue - p.revenue AS difference, CASE WHEN p.revenue > 0 THEN round((a.revenue - p.revenue) / p.revenue * 100, 6) END AS growth, NULL::DOUBLE AS points FROM annual a LEFT JOIN annual p ON a.corp_code = p.corp_code AND a.basis = p.basis AND p.year = a.year - 1")
def t16(t: Tables) -> DataFrame:
    c = qx.comparison(b.annual(t), ["corp_code", "basis"], "revenue", F.lit(False))
    return c.select("corp_code", "basis", "year", "difference", r6("growth").alias("growth"), "points")


@R.add("T17_close_snapshot", f"WITH {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS rn FROM daily WHERE day < DATE '2024-01-15') SELECT instrument, max(close) FILTER (rn = 1) AS close, max(close) FILTER (rn = 2) AS previous FROM r WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2")
def t17(t: Tables) -> DataFrame:
    return mk.close_snapshot(daily(t), "2024-01-15").select("instrument", "close", "previous")


@R.add("T18_history_merge", f"WITH {_DAILY}, o AS (SELECT *, 0 AS gen FROM daily WHERE day <= DATE '2024-01-20'), n AS (SELECT instrument, day, close + 1 AS close, 1 AS gen FROM daily WHERE day >= DATE '2024-01-15') SELECT instrument, day, arg_max(close, gen) AS close FROM (SELECT * FROM o UNION ALL SELECT * FROM n) WHERE day > DATE '2021-01-30' GROUP BY 1, 2")
def t18(t: Tables) -> DataFrame:
    d = daily(t)
    old, new = d.filter("day <= DATE '2024-01-20'"), d.filter("day >= DATE '2024-01-15'").withColumn("close", F.col("close") + 1)
    return mk.merge_history(old, new, "2024-01-30", 36)


@R.add("T19_backfill_calendar", "WITH c AS (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day), f AS (SELECT DISTINCT ts::DATE AS day FROM events) SELECT day, day > DATE '2024-01-24' AS recheck FROM c WHERE isodow(day) <= 5 AND (day > DATE '2024-01-24' OR day NOT IN (SELECT day FROM f))")
def t19(t: Tables) -> DataFrame:
    return mk.backfill_days(t.events.select(F.to_date("ts").alias("day")), "2023-12-01", "2024-01-31", 7)


@R.add("T20_trend_sentence", f"WITH {b.SQL_ANNUAL}, r AS (SELECT *, row_number() OVER (PARTITION BY corp_code, basis ORDER BY year DESC) AS rn FROM annual WHERE revenue IS NOT NULL) SELECT c.corp_code, c.basis, printf('%d: %d (%d: %d)', c.year, c.revenue::BIGINT, p.year, p.revenue::BIGINT) AS sentence FROM r c JOIN r p ON c.corp_code = p.corp_code AND c.basis = p.basis AND c.rn = 1 AND p.rn = 2 AND p.year = c.year - 1")
def t20(t: Tables) -> DataFrame:
    a = qx.previous_year(b.annual(t).filter("revenue IS NOT NULL"), ["corp_code", "basis"], ["revenue"])
    last = rk.top_per_group(a, ["corp_code", "basis"], [F.desc("year")], 1).filter("prev_revenue IS NOT NULL")
    return last.select("corp_code", "basis", F.format_string("%d: %d (%d: %d)", "year", F.col("revenue").cast("bigint"), F.col("year") - 1, F.col("prev_revenue").cast("bigint")).alias("sentence"))


@R.add("T21_market_cap_gate", "SELECT n_nationkey, CASE WHEN count(*) = count(*) FILTER (s_acctbal > 0 AND isfinite(s_acctbal)) THEN round(sum(s_acctbal), 4) END AS cap FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def t21(t: Tables) -> DataFrame:
    good = F.coalesce(fin.finite(F.col("s_acctbal")) > 0, F.lit(False))
    j = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey").agg(F.when(F.count_if(~good) == 0, F.round(F.sum("s_acctbal"), 4)).alias("cap"))
