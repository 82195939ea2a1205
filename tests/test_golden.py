"""Known values of the financial, signal and document operators."""

import datetime as dt
import itertools
import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import finance as fin
from ledgerloom.operators import documents as dx
from ledgerloom.operators import market as mk
from ledgerloom.operators import quarters as qx
from ledgerloom.operators import ranking as rk
from ledgerloom.operators import releases as rl
from ledgerloom.operators import retrieval as rt
from ledgerloom.operators import signals as sg


def one(df):
    return df.first()


def flows(spark, cells):
    data = [("c", "CFS", "REVENUE", 2024, rt, kind, v) for rt, kind, v in cells]
    df = spark.createDataFrame(data, "corp_code string, basis string, metric string, year int, report_type string, value_type string, value bigint")
    return {r.quarter: (r.value, r.method) for r in qx.deaccumulate(qx.flow_columns(df)).collect()}


def test_quarters(spark):
    q = [("FY", "annual", 100), ("Q1", "quarterly", 10), ("Q3", "quarterly", 30), ("FY", "quarterly", 40)]
    assert flows(spark, q)[2] == (20.0, "annual minus others")
    assert flows(spark, [*q, ("H1", "quarterly", 25)])[2] == (25.0, "stored")
    assert flows(spark, [("Q1", "quarterly", 10), ("H1", "cumulative", 25)])[2] == (15.0, "cumulative difference")
    assert flows(spark, [("FY", "annual", 100)])[1] == (None, None)
    # disagreeing sources are no value
    assert flows(spark, [("Q1", "quarterly", 10), ("Q1", "quarterly", 11)])[1] == (None, None)


def test_quarters_add_up_for_every_presence_pattern(spark):
    names = list(qx.KINDS)
    data, truth = [], {"q1": 1.0, "q2": 2.0, "q3": 4.0, "q4": 8.0, "c1": 1.0, "c2": 3.0, "c3": 7.0, "a": 15.0}
    for i, mask in enumerate(itertools.product((0, 1), repeat=8)):
        data += [(str(i), "CFS", "M", 2024, *names[j], int(truth[qx.KINDS[names[j]]])) for j in range(8) if mask[j]]
    df = spark.createDataFrame(data, "corp_code string, basis string, metric string, year int, report_type string, value_type string, value bigint")
    for r in qx.deaccumulate(qx.flow_columns(df)).collect():
        assert r.value in (None, truth[f"q{r.quarter}"])


def test_industrial_and_index(spark):
    rows = spark.createDataFrame([("c", "CFS", 2023, 1, 100.0, 1.0, 1.0, 1.0), ("c", "CFS", 2024, 1, 125.0, -10.0, 30.0, 20.0)], "corp_code string, basis string, year int, quarter int, revenue double, operating_income double, capex double, operating_cash_flow double")
    r = one(qx.industrial_metrics(qx.base_index(rows, "revenue", 2023, 1)).filter("year = 2024"))
    assert (r["index"], r.operating_margin, r.invested_share, r.fcf_margin) == (125, -8, 24, -8)
    assert one(qx.base_index(rows.withColumn("revenue", F.lit(0.0)), "revenue", 2023, 1))["index"] is None


def test_bank(spark):
    rows = spark.createDataFrame([("c", "CFS", 2023, 4, 100.0, 1000.0, None, None, None), ("c", "CFS", 2024, 1, 140.0, 1200.0, 2000.0, 3.0, 2.0)], "corp_code string, basis string, year int, quarter int, equity double, loans double, assets double, net_income double, credit_loss double")
    r = one(qx.bank_metrics(rows).filter("year = 2024"))
    assert r.roe == 10 and math.isclose(r.equity_share, 7) and math.isclose(r.credit_cost, 8 / 1100 * 100)


def test_weighted_and_entropy(spark):
    df = spark.createDataFrame([(10.0, 0.8), (30.0, 0.2)], "x double, w double")
    assert one(df.agg(fin.weighted_mean(F.col("x"), F.col("w")).alias("m"))).m == 14
    assert one(df.union(spark.createDataFrame([(None, 0.5)], df.schema)).agg(fin.weighted_mean(F.col("x"), F.col("w")).alias("m"))).m is None
    for hit, expected in ((5, 100), (1, 0), (2, math.log(2) / math.log(5) * 100)):
        e = spark.createDataFrame([(1.0, 10.0)] * hit, "n double, total double").agg(fin.entropy_score(F.col("n"), F.col("total"), F.lit(5)).alias("e"))
        assert math.isclose(one(e).e, expected, abs_tol=1e-9)


def test_display_weights(spark):
    df = lambda s: spark.createDataFrame([(0, float(x), i + 1) for i, x in enumerate(s)], "g int, s double, r int")
    get = lambda s: [round(r.w, 6) for r in df(s).select("r", rk.display_weight(F.col("s"), F.col("r"), ["g"]).alias("w")).orderBy("r").collect()]
    assert get([90, 80, 70]) == [100, 52.75, 30] and get([5, 5, 5]) == [100, 65, 30] and get([1]) == [100]


def test_percentile_and_midrank_on_ties(spark):
    df = spark.createDataFrame([(0, v) for v in (1, 2, 2, 4)], "g int, v int")
    p = [r.p for r in df.select("v", rk.percentile_score(F.col("v"), ["g"]).alias("p")).orderBy("v").collect()]
    m = [r.p for r in df.select("v", rk.midrank_position(F.col("v"), ["g"]).alias("p")).orderBy("v").collect()]
    assert p == [25, 62.5, 62.5, 100] and m == [12.5, 50, 50, 87.5]


def test_change_blend(spark):
    years = [2021, 2022, 2023, 2024, 2025]
    rates = spark.createDataFrame([("k", y, r) for y, r in zip(years, (0.0, 0.2, 0.2, 0.2, 0.2), strict=True)], "keyword string, year int, rate double")
    assert math.isclose(one(sg.blended_change(rates, years)).change_raw, 0.4**3 * 0.2)


def test_concentration_penalty_and_hot(spark):
    assert one(spark.range(1).select(sg.concentration_penalty(F.lit(0.75)).alias("p"))).p == 7.5
    df = spark.createDataFrame([("s", f"k{i}", i, float(i), 95.0, 100.0 - i) for i in range(1, 8)], "sector string, keyword string, final_rank int, change_raw double, change_score double, final_score double")
    assert sorted(r.keyword for r in rk.hot_flags(df, ["sector"], 6).filter("hot").collect()) == ["k4", "k5", "k6"]


def test_context_diversity(spark):
    pairs = spark.createDataFrame([("k", "1"), ("k", "2")], "keyword string, chunk_id string")
    texts = spark.createDataFrame([("1", "매출 1,200 증가"), ("2", "매출 35  증가")], "chunk_id string, text string")
    r = one(sg.context_diversity(pairs, texts))
    assert (r.c2, r.c3, r.support, round(r.adjusted, 9)) == (0.5, 0.5, 0.2, 0.1)


def test_numbers_and_caps(spark):
    assert dx.number("1,200", 10**6) == 1_200_000_000 and dx.number("(20)", 10**6) == -20_000_000 and dx.number("△3") == -3 and dx.number("1.5") is None and dx.number("1.5", 10) == 15 and dx.number("x") is None
    df = spark.createDataFrame([("1,200",), ("(20)",), ("△3",), ("1.5",), ("x",), (None,)], "t string")
    assert [r.n for r in df.select(dx.number_column(F.col("t"), 10**6).alias("n")).collect()] == [1_200_000_000, -20_000_000, -3_000_000, 1_500_000, None, None]
    assert one(spark.range(1).select(mk.cap_text(F.lit("1,234조 5,678억")).alias("c"))).c == 1234 * 10**12 + 5678 * 10**8


def test_repair_grid_and_statement():
    fixed, ledger = dx.repair("<P>R&D 이자 < 이익 &nbsp;&lt;TD&gt; <주1></P>")
    assert fixed == "<P>R&amp;D 이자 &lt; 이익 &#160;&lt;TD&gt; &lt;주1></P>" and len(ledger) == 4
    with pytest.raises(ValueError):
        dx.repair("<!DOCTYPE x><P/>")
    cell = lambda t, r=1, c=1: {"text": t, "rowspan": r, "colspan": c}
    placed = {c["text"]: (c["row"], c["column"]) for c in dx.grid([[cell("a", 2), cell("b", 1, 2)], [cell("c"), cell("d")]])}
    assert placed == {"a": (0, 0), "b": (0, 1), "c": (1, 1), "d": (1, 2)}
    raw = "<TITLE>연결 재무상태표</TITLE><P>(단위: 백만원)</P><TABLE><TR><TD>자산총계</TD><TD>1,200</TD><TD>1,100</TD></TR><TR><TD>차이</TD><TD>(20)</TD></TR></TABLE>"
    assert dx.statement_facts(raw.encode("cp949")) == [("BS", "CFS", "자산총계", 1_200_000_000, 1), ("BS", "CFS", "차이", -20_000_000, 1)]
    assert dx.statement_facts(None) == []


def test_passages_claims_and_quotes(spark):
    text = "매출은 1조 2,000억원입니다. 전년 대비 3.5% 증가\n\n다음 줄"
    assert [text[a:b] == p for a, b, p in dx.passages_of(text)] == [True] * 3 and dx.passages_of(None) == []
    assert dx.claims_of(text) == [("money", 4, 1.2e12, 5e7), ("percent", text.index("3.5"), 3.5, 0.05)]
    assert dx.located("가 나다\n라", "나 다라") == (2, 6) and dx.located("x", "") is None
    c = dx.claims(spark.createDataFrame([("c", 2024, text), ("c", 2024, None)], "corp_code string, year int, text string"))
    f = spark.createDataFrame([("c", 2024, 1_200_030_000_000), ("c", 2023, 1)], "corp_code string, year int, value bigint")
    assert [r.supported for r in dx.check_claims(c, f, ["corp_code", "year"]).collect()] == [True]


def test_related_filings_and_lexical(spark):
    df = spark.createDataFrame([("c", "r1", "HBM HBM"), ("c", "r2", "HBM xHBM HBMs"), ("c", "r3", None)], "corp_code string, rcept_no string, text string")
    dates = {"r1": dt.date(2024, 1, 1), "r2": dt.date(2024, 2, 1), "r3": None}
    docs = spark.createDataFrame([("c", r, d) for r, d in dates.items()], "corp_code string, rcept_no string, rcept_dt date")
    best = one(sg.related_filings(df, docs, "HBM"))
    assert (best.corp_code, best.mentions, best.rcept_no) == ("c", 2, "r1")
    # letter case and width aside, an alias counts, and of equal counts the later filing is named
    aliased = spark.createDataFrame([("c", "r1", "ｈｂｍ hbm"), ("c", "r2", "고대역폭  메모리 HBM"), ("c", "r9", "HBM " * 9)], "corp_code string, rcept_no string, text string")
    best = one(sg.related_filings(aliased, docs, "HBM", {"고대역폭 메모리": "hbm"}))
    assert (best.mentions, best.rcept_no) == (2, "r2")
    assert [r.s for r in df.select(rt.lexical_score(F.col("text"), [("hbm",), ("x",)]).alias("s")).collect()] == [1.0, 2.0, 0.0]


def test_history_and_snapshot(spark):
    d = lambda n: dt.date(2024, 1, n)
    s = spark.createDataFrame([("i", d(1), 100.0), ("i", d(2), 110.0), ("i", d(2), 110.0), ("i", d(3), 1.0), ("j", d(1), 1.0)], "instrument string, day date, close double")
    r = mk.close_snapshot(s, "2024-01-03").collect()
    assert [(x.instrument, x.close, x.previous, x.change_percent) for x in r] == [("i", 110, 100, 10)]
    merged = {x.day: x.close for x in mk.merge_history(s.filter("close = 100"), s.filter("close = 110").limit(1).withColumn("day", F.lit(d(1))), "2024-01-03", 36).collect()}
    assert merged == {d(1): 110}


def test_round_robin_skips_what_overflows(spark):
    df = spark.createDataFrame([("s", "a", 1, 50), ("s", "b", 2, 60), ("s", "a", 3, 30), ("s", "b", 4, 20)], "s string, lane string, id int, n int")
    kept = rk.budgeted_round_robin(df, ["s"], "lane", [F.col("id")], F.col("n"), 100)
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]


def test_release_equivalence_and_pinning(spark):
    v = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1, "h1", "i", 0), ("b", dt.datetime(2024, 2, 1), 1, "h2", "i", 0), ("c", dt.datetime(2024, 3, 1), 1, "h2", "j", 0), ("d", dt.datetime(2024, 4, 1), 1, None, "i", 1), ("e", dt.datetime(2024, 5, 1), 0, "h1", "i", 0)], "data_version string, created_at timestamp_ntz, validated int, content_hash string, index_version string, is_current int")
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "a")], "registered string, selected string")
    run = ("financial_metric_values_document_id", "success", 5, 0, 5, 0, dt.datetime(2024, 1, 1))
    schema = "data_version string, table_name string, status string, rows_source int, rows_inserted int, rows_updated int, rows_deactivated int, finished_at timestamp_ntz"
    log = spark.createDataFrame([("b", *run), ("d", *run), ("d", "financial_metric_values_document_id", "success", 5, 1, 5, 0, dt.datetime(2024, 1, 1))], schema)
    got = {(r.registered, r.selected): r.equivalence for r in rl.equivalence(pairs, v, log).collect()}
    # a patch of ids only counts for the release just before; d's second run inserted a row
    assert got == {("b", "a"): "document ids only", ("c", "b"): "same content", ("c", "a"): "content differs", ("d", "c"): "content differs", ("d", "a"): "content differs"}
    rows = spark.createDataFrame([("a", 3), ("c", 1), ("d", 2), ("e", 1)], "data_version string, n bigint")
    status = {r.data_version: r.status for r in rl.pinned_status(v, ["index_version"], [rows]).collect()}
    assert status == {"a": "usable", "b": "absent", "c": "index_version differs", "d": "usable", "e": "not validated"}


def test_statement_cells_by_term_and_bad_tables(spark):
    table = lambda rows: "<TABLE>" + "".join("<TR>" + "".join(f"<TD>{c}</TD>" for c in r) + "</TR>" for r in rows) + "</TABLE>"
    good = "<P>연결 재무상태표 (단위: 천원)</P>" + table([["과목", "제 11 기", "제 12 기"], ["자산 총계", "1,000", "(2,000)"], ["비고", "x", "y"]])
    bad = "<P>손익계산서 (단위: 원)</P><TABLE><TR><TD ROWSPAN='2'>a</TD><TD>b</TD></TR><TR><TD>c</TD><TD COLSPAN='2'>d</TD></TR><TR><TD ROWSPAN='9'>e</TD></TR></TABLE>"
    assert dx.statement_facts((bad + good).encode()) [-1:] == [("BS", "CFS", "자산총계", -2_000_000, 2)]
    wide = dx.grid([[{"rowspan": 10**9, "colspan": 10**9, "text": "x"}], [{"rowspan": 1, "colspan": 1, "text": "y"}]])
    assert [(c["row"], c["column"]) for c in wide] == [(0, 0), (1, 10**9)]
