"""File sources, sinks, incremental ingest and the company signal rules."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import company_signals as cs
from ledgerloom.operators import documents as dx
from ledgerloom.sources import files, vectors
from ledgerloom.streaming import ingest


def test_daily_prices_and_filing_list(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/20240102.json").write_text(json.dumps({"output": [{"IDX_NM": "A", "BAS_DD": "20240102", "CLSPRC_IDX": "1,234.5", "MKTCAP": "10,000"}, {"IDX_NM": "B", "BAS_DD": "x", "CLSPRC_IDX": "-", "MKTCAP": ""}]}))
    assert sorted(tuple(r) for r in files.daily_prices(spark, f"{tmp_path}/d").collect()) == [("A", dt.date(2024, 1, 2), 1234.5, 10000), ("B", None, None, None)]
    (tmp_path / "f").mkdir()
    for page in (1, 2):
        (tmp_path / f"f/{page}.json").write_text(json.dumps({"status": "000", "page_no": page, "total_page": 2, "list": [{"corp_code": "00000001", "rcept_no": f"2024{page}", "report_nm": "n", "rcept_dt": "20240101"}]}))
    got = files.filing_list(spark, f"{tmp_path}/f").collect()
    assert {r.rcept_no for r in got} == {"20241", "20242"} and all(r.complete for r in got)


def test_zip_members(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.xml", "<A/>")
        z.writestr("b.txt", "no")
    (tmp_path / "x.zip").write_bytes(raw.getvalue())
    (tmp_path / "y.zip").write_bytes(b"not a zip")
    got = {(r.member, bytes(r.content) if r.content is not None else None) for r in files.zipped_documents(spark, str(tmp_path)).collect()}
    assert got == {("a.xml", b"<A/>"), (None, None)}


def test_publish_config_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "v1")], "id int, index_version string")
    files.publish(df, f"{tmp_path}/out", "v1", "abc")
    assert spark.read.parquet(f"{tmp_path}/out").first().fingerprint == "abc"
    with pytest.raises(Exception, match="(?i)exists"):
        files.publish(df, f"{tmp_path}/out", "v1")
    (tmp_path / "c.json").write_text('{"sector": "semis",\n "years": [2024]}')
    assert files.json_config(spark, f"{tmp_path}/c.json").first().sector == "semis"
    v = spark.createDataFrame([(1, [0.5], "i1"), (2, None, "i2")], "id bigint, embedding array<float>, index_version string")
    back = files.snapshot_cache(v, f"{tmp_path}/snap")
    assert sorted((r.id, r.index_version) for r in back.collect()) == [(1, "i1"), (2, "i2")]
    with pytest.raises(ValueError):
        files.by_parameters(spark, "DROP TABLE x")


def test_vector_blobs(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, v array<float>")
    b = v.select("id", vectors.encode_vectors("v").alias("b"))
    assert {r.id: r.v for r in b.select("id", vectors.decode_vectors("b", 2).alias("v")).collect()} == {1: [1.0, 2.0], 2: None}
    assert b.select(vectors.decode_vectors("b", 3).alias("v")).filter("v IS NOT NULL").count() == 0


def test_ingest_upserts_late_values_and_replays(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    write = lambda rows: spark.createDataFrame(rows, ingest.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    history = lambda: {(r.instrument, r.day): r.close for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    write([(i, t + dt.timedelta(days=i // 2, hours=i % 2), 1, "a", float(i), None) for i in range(80)])
    run()
    first = history()
    # the last days are there at once
    assert len(first) == 40 and first["a", dt.date(2024, 1, 1)] == 1.0 and first["a", dt.date(2024, 2, 9)] == 79.0
    # months late: a later event of the first day wins, an earlier one does not; a null value counts for nothing
    write([(100, t + dt.timedelta(hours=5), 1, "a", -1.0, None), (101, t + dt.timedelta(days=1), 1, "a", -2.0, None), (102, t + dt.timedelta(days=3, hours=9), 1, "a", None, None)])
    run()
    run()
    assert history() == first | {("a", dt.date(2024, 1, 1)): -1.0}


def observations(spark, rows):
    return spark.createDataFrame(rows, "corp_code string, chunk_id string, section_name string, year int, keyword string, kind string, left_word string, right_word string, number string")


def test_company_rules(spark):
    o = observations(spark, [("c", str(i), f"s{i % 2}", 2025, "HBM", "english", None, None, None) for i in range(4)] + [("c", str(i), "s", 2025, "AI", "english", None, "칩", None) for i in range(9)])
    assert {(r.keyword, r.rule) for r in cs.approved_english(o).collect()} == {("HBM", "section breadth")}
    assert [r.keyword for r in cs.suppressed_by_longer(o).collect()] == ["AI"]
    g = observations(spark, [("c", str(i), f"s{i % 2}", 2025, "DDR", "generation", None, None, str(i % 2)) for i in range(8)])
    assert [r.keyword for r in cs.approved_generations(g).collect()] == ["DDR"]
    p = observations(spark, [("c", str(i), "s", 2025, k, kind, None, None, None) for i in range(4) for k, kind in (("전고체", "direct"), ("전고체 전해질", "phrase"))])
    assert [(r.keyword, r.phrase) for r in cs.promotions(p, 2025).collect()] == [("전고체", "전고체 전해질")]
    assert [r.category for r in cs.provenance(p).orderBy("keyword").collect()] == ["direct", "phrase"]
    assert {r.keyword for r in cs.company_result(p, 2025).collect()} == {"전고체", "전고체 전해질"}
    texts = spark.createDataFrame([("c", "1", "당사는 설비를 증설하였습니다. 당사는 신제품을 개발하였습니다."), ("c", "2", "당사는 라인을 증설합니다."), ("c", "3", "경쟁사는 공장을 개발합니다.")], "corp_code string, chunk_id string, text string")
    assert [(r.action, r.own) for r in cs.owned_actions(texts).collect()] == [("증설", 2)]
    assert cs.promotion_forms("the AI Server Rack unit", 4, 6)[:2] == ["the AI", "AI Server"]
    assert cs.is_entity("주식회사 가나", 5, 7) and not cs.is_entity("그 가나", 2, 4)


def test_bound_claims_and_occurrences():
    assert dx.bound_claims("매출액과 영업이익은 각각 100억원, 20억원입니다.", ["매출액", "영업이익"]) == [("매출액", 1e10), ("영업이익", 2e9)]
    assert dx.bound_claims("매출액은 각각 1억원, 2억원", ["매출액"]) == [] and dx.bound_claims(None, []) == []
    assert dx.recovered_fragment("x" * 10 + "a quote that is long enough", "a quote that is long enough!") == (10, 37)
    assert dx.recovered_fragment("short", "other") is None
    assert dx.chosen_occurrence("q I. q", "q", "I.") == 5 and dx.chosen_occurrence("q", "q", None) == 0 and dx.chosen_occurrence("x", "q", None) is None


def test_observations_keep_places(spark):
    t = spark.createDataFrame([("1", "c", 2025, "s", "차량용 램프 HBM4 공급"), ("2", "c", 2025, "s", None)], "chunk_id string, corp_code string, year int, section_name string, text string")
    got = cs.observations(t)
    assert {"차량용 램프", "HBM"} <= {r.keyword for r in got.collect()} and got.filter(F.col("chunk_id") == "2").count() == 0
