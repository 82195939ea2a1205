"""Queries that do the whole of a job whose fixed SQL or former code did a part of it."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.operators import documents as dx
from ledgerloom.operators import retrieval as rt
from ledgerloom.operators import signals as sg
from ledgerloom.plans import signals as plans
from ledgerloom.plans.registry import Tables

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@tables
def test_every_query_vector_is_answered(spark, monkeypatch):
    monkeypatch.setattr(rt, "MAX_QUERIES", 7)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    asked = sorted(i for i in ids if i % 20 == 0)
    assert len(asked) > 20
    got = {}
    for r in entry.queries()["V2_cosine_top_k"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in asked:
        score = x @ x[list(ids).index(q)]
        order = [i for _, i in sorted((-round(s, 12), i) for s, i in zip(score, ids, strict=True) if i != q)]
        assert [got[q][k] for k in range(1, 6)] == order[:5]
    assert set(got) == set(asked)
    best = {r.query_id: r.vec_id for r in entry.queries()["W7_exact_top_k"](spark, SF).collect()}
    assert best == {q: near[1] for q, near in got.items()}
    assert entry.queries()["J16_cosine_cross"](spark, SF).count() == len(asked) * (len(ids) - 1)
    by_group = entry.queries()["V2_cosine_top_k_by_group"](spark, SF).agg(F.count_distinct("query_id").alias("n")).first().n
    assert by_group == len(asked)


def chunk_rows(spark, path, rows):
    """chunk_metadata of (chunk_id, corp_code, year, report_type, text, keyword) in a directory."""
    full = "chunk_id string, vector_id bigint, corp_code string, corp_name string, year int, report_type string, rcept_no string, section_name string, subsection_name string, text string, keyword string, content_hash string, token_count int, is_searchable int, index_version string, data_version string, is_active int, loaded_at timestamp"
    given = spark.createDataFrame(rows, "chunk_id string, corp_code string, year int, report_type string, text string, keyword string")
    names = [c.strip().split(" ") for c in full.split(",")]
    given.select(*(F.col(n) if n in given.columns else F.lit(None).cast(kind).alias(n) for n, kind in names)).write.parquet(f"{path}/chunk_metadata.parquet")


@tables
def test_evidence_keeps_whole_texts_and_every_period(spark, tmp_path):
    long = "첫 문장입니다. " + "설비 투자가 이어집니다. " * 30 + "마지막 문장입니다."
    rows = [(f"{y}-{r}-{i}", "00000990", y, r, long, None) for y in (2023, 2024, 2025) for r in ("Q1", "H1", "Q3", "FY") for i in range(9)]
    chunk_rows(spark, str(tmp_path), [*rows, ("none", "00000001", 2025, "FY", "언급이 없습니다.", None)])
    spark.read.parquet("/root/testdata/sf0.1/financial_metric_values.parquet").write.parquet(f"{tmp_path}/financial_metric_values.parquet")
    found = entry.queries()["X27_evidence_assembly"](spark, str(tmp_path))
    filings = found.filter("kind = 'filing'").collect()
    texts = {r[0]: r[4] for r in rows} | {"none": "언급이 없습니다."}
    assert all(texts[r.source][r.start : r.stop] == r.passage for r in filings)
    per = {}
    for r in filings:
        per.setdefault(r.source, []).append(r.passage)
    assert all(len(p) == 32 and p[-1] == "마지막 문장입니다." for k, p in per.items() if k != "none") and "none" in per
    # four periods a year: two chunks of each in the latest, one before; the other company has one
    assert len(per) == 4 * (2 + 1 + 1) + 1
    assert found.filter("kind = 'financial'").groupBy("corp_code").count().agg(F.max("count")).first()[0] > 20


def changes(spark, corpus, years):
    """Change of keyword k in a corpus of (year, report_type, chunks, chunks with k)."""
    counts = spark.createDataFrame([("k", y, r, n) for y, r, _, n in corpus if n], "keyword string, year int, report_type string, df long")
    totals = spark.createDataFrame([(y, r, n) for y, r, n, _ in corpus], "year int, report_type string, total long")
    return sg.comparable_change(counts, totals, years).first().change_raw


def test_newest_year_is_compared_like_for_like(spark):
    corpus = [(2023, "FY", 10, 2), (2024, "FY", 10, 2), (2025, "Q1", 10, 2), (2025, "H1", 10, 2), (2025, "Q3", 10, 4), (2025, "FY", 10, 4), (2026, "Q1", 10, 4), (2026, "H1", 10, 4)]
    years = [2023, 2024, 2025, 2026]
    assert round(changes(spark, corpus, years), 9) == 0.144
    # a year without chunks is skipped: only 2025 to 2026 is left
    assert round(changes(spark, [x for x in corpus if x[0] != 2024], years), 9) == 0.2
    # no type in common: no comparison with the newest year
    assert round(changes(spark, [(2023, "FY", 10, 1), (2024, "FY", 10, 2), (2025, "H1", 10, 9)], [2023, 2024, 2025]), 9) == 0.1
    # a year with chunks but none with the keyword has rate 0
    assert round(changes(spark, [(2023, "FY", 10, 1), (2024, "FY", 10, 0), (2025, "FY", 10, 0)], [2023, 2024, 2025]), 9) == -0.04
    assert changes(spark, corpus, [2026]) == 0


def test_sector_scores_use_the_comparable_change(spark, tmp_path):
    parts = [(2023, "FY", 1), (2024, "FY", 1), (2024, "Q1", 5), (2025, "Q1", 2)]
    rows = [(f"{c}{y}{r}{i}", c, y, r, "x", "메모리" if i < n else "기판") for c in ("a", "b") for y, r, n in parts for i in range(5)]
    chunk_rows(spark, str(tmp_path), rows)
    got = {r.keyword: r.change_raw for r in plans.sector_scores(Tables(spark, str(tmp_path))).select("keyword", "change_raw").collect()}
    # 2023 to 2024: 0.2 to 0.6; Q1 of 2024 to Q1 of 2025: 1 to 0.4
    assert round(got["메모리"], 9) == round(0.4 * 0.4 + 0.6 * -0.6, 9)


def test_every_amount_of_a_text_is_parsed(spark, tmp_path):
    texts = {"a": "매출 1,200천원, 비용 3,400천원, 이익 1,200천원", "b": "없음 12천원", "c": None, "d": "10,000천원"}
    chunk_rows(spark, str(tmp_path), [(k, "x", 2025, "FY", v, None) for k, v in texts.items()])
    got = sorted(map(tuple, entry.queries()["D7_number_parse"](spark, str(tmp_path)).collect()))
    assert got == [("a", 0, 1_200_000), ("a", 1, 3_400_000), ("a", 2, 1_200_000), ("d", 0, 10_000_000)]


def test_every_passage_and_mention_is_located(spark, tmp_path):
    text = "첫 특허.  둘째 줄\n첫 특허. 특허특허 " + "긴 " * 2000 + "끝 특허"
    chunk_rows(spark, str(tmp_path), [("a", "x", 2025, "FY", text, None), ("b", "x", 2025, "FY", " \n", None), ("c", "x", 2025, "FY", None, None)])
    got = sorted((r.start, r.stop, r.excerpt) for r in entry.queries()["D20_located_quotes"](spark, str(tmp_path)).collect())
    assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in dx.passages_of(text)] and len(got) == 4
    assert all(x == text[max(0, s - 1000) : s + 1000] for s, _, x in got)
    mentions = sorted((r.place, r.before, r.after) for r in entry.queries()["V9_adjacent_context"](spark, str(tmp_path)).collect())
    at = [m.start() for m in re.finditer("특허", text)]
    assert mentions == [(i, text[max(0, p - 120) : p], text[p + 2 : p + 122]) for i, p in enumerate(at)] and len(at) == 5
