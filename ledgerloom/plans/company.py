"""Company keyword signals and the remaining composite queries (K, X, S, D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import company_signals as cs
from ledgerloom.operators import documents as dx
from ledgerloom.operators import ranking as rk
from ledgerloom.plans import base as b
from ledgerloom.plans.registry import Registry, Tables
from ledgerloom.plans.signals import SQL_SECTOR, hits, sector_scores
from ledgerloom.sources.files import by_parameters

R = Registry()
QUERIES, SQL = R.queries, R.sql
LATEST = 2025


def corpus(t: Tables) -> DataFrame:
    return b.chunks(t, "text", "corp_code", "year", "report_type", "section_name").filter("text IS NOT NULL AND corp_code IS NOT NULL")


def observed(t: Tables) -> DataFrame:
    return cs.observations(corpus(t))


@R.add("S3_ad_hoc_query", "SELECT report_type, count(*) AS n FROM filings WHERE year = 2023 GROUP BY 1")
def s3(t: Tables) -> DataFrame:
    return by_parameters(t.spark, "SELECT report_type, count(*) AS n FROM {filings} WHERE year = :year GROUP BY 1", {"year": 2023}, filings=t.filings)


@R.add("S10_quote_history", "WITH daily AS (SELECT event_type AS instrument, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT instrument, day, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS r FROM daily) WHERE r <= 65")
def s10(t: Tables) -> DataFrame:
    from ledgerloom.plans.windows import daily

    return rk.top_per_group(daily(t), ["instrument"], [F.desc("day")], 65).select("instrument", "day", "close")


@R.add("K4_candidate_filters", None)
def k4(t: Tables) -> DataFrame:
    return observed(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("keyword").alias("keywords"))


@R.add("K12_candidate_evidence", None)
def k12(t: Tables) -> DataFrame:
    return observed(t).select("chunk_id", "corp_code", "keyword", "kind", "start", "stop")


@R.add("K13_english_approval", None)
def k13(t: Tables) -> DataFrame:
    return cs.approved_english(observed(t))


@R.add("K14_generation_approval", None)
def k14(t: Tables) -> DataFrame:
    return cs.approved_generations(observed(t), cs.Thresholds(generation_chunks=2))


@R.add("K15_longer_form_suppression", None)
def k15(t: Tables) -> DataFrame:
    return cs.suppressed_by_longer(observed(t))


@R.add("K16_action_ownership", None)
def k16(t: Tables) -> DataFrame:
    return cs.owned_actions(corpus(t))


@R.add("K17_promotion", None)
def k17(t: Tables) -> DataFrame:
    return cs.promotions(observed(t), LATEST)


@R.add("K19_entity_rejection", None)
def k19(t: Tables) -> DataFrame:
    return dx.per_text(corpus(t).select("chunk_id", "text"), "text", lambda x: [(w, cs.is_entity(x, s, e)) for w, s, e in cs.word_tokenizer(x or "")], "keyword string,entity boolean").filter("entity").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@R.add("K20_sector_unrelated", None)
def k20(t: Tables) -> DataFrame:
    return cs.without_sector_context(observed(t).select("chunk_id", "corp_code", "keyword"), corpus(t).select("chunk_id", "text"), "설비|소재|공정|반도체|전지", ["특허"])


@R.add("K22_provenance_category", None)
def k22(t: Tables) -> DataFrame:
    return cs.provenance(observed(t))


@R.add("X15_company_result", None)
def x15(t: Tables) -> DataFrame:
    return cs.company_result(observed(t), LATEST)


@R.add("X16_phrase_category", None)
def x16(t: Tables) -> DataFrame:
    p = observed(t).filter("kind = 'phrase'").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return p.withColumn("category", cs.phrase_category(["차량용", "의료용", "산업용", "정밀", "스마트"], ["램프", "카테터", "센서", "감속기", "계량기"]))


@R.add("X17_promotion_forms", None)
def x17(t: Tables) -> DataFrame:
    forms = lambda x: [(f,) for m in cs.LATIN.finditer(x or "") for f in cs.promotion_forms(x, m.start(), m.end())]
    return dx.per_text(corpus(t).select("chunk_id", "text"), "text", forms, "form string").groupBy("form").agg(F.count_distinct("chunk_id").alias("n"))


@R.add("K17_contained_spans", None)
def k17b(t: Tables) -> DataFrame:
    counts = observed(t).groupBy("corp_code", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return cs.contained_spans(counts)


@R.add("X21_signal_apply", f"WITH {SQL_SECTOR}, tp AS (SELECT corp_code FROM chunks WHERE year = 2025 AND corp_code IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, corp_code LIMIT 5) SELECT keyword, final_rank, count(DISTINCT chunk_id) AS n, count(DISTINCT corp_code) AS companies FROM hits JOIN sector USING (keyword) WHERE year = 2025 AND corp_code IN (FROM tp) AND final_rank <= 30 GROUP BY 1, 2")
def x21(t: Tables) -> DataFrame:
    """The cloud only where the latest year is there, for the companies with most chunks."""
    members = b.chunks(t, "corp_code", "year").filter(f"year = {LATEST} AND corp_code IS NOT NULL").groupBy("corp_code").agg(F.count(F.lit(1)).alias("weight"))
    top = members.orderBy(F.desc_nulls_last("weight"), "corp_code").limit(5).select("corp_code")
    h = hits(t).filter(f"year = {LATEST}").join(F.broadcast(top), "corp_code", "left_semi")
    return h.join(sector_scores(t).filter("final_rank <= 30").select("keyword", "final_rank"), "keyword").groupBy("keyword", "final_rank").agg(F.count_distinct("chunk_id").alias("n"), F.count_distinct("corp_code").alias("companies"))


@R.add("X28_keyword_statistics", f"WITH {SQL_SECTOR} SELECT keyword, current, change_raw, round(spread, 6) AS spread, companies, final_rank FROM sector")
def x28(t: Tables) -> DataFrame:
    return sector_scores(t).select("keyword", "current", F.round("change_raw", 9).alias("change_raw"), F.round("spread", 6).alias("spread"), "companies", "final_rank")


@R.add("X30_respectively_claims", None)
def x30(t: Tables) -> DataFrame:
    labels = ["매출액", "영업이익", "자산총계", "이자율"]
    return dx.per_text(b.chunks(t, "text"), "text", lambda x: dx.bound_claims(x, labels), "label string,value double")


@R.add("X34_repeated_quotes", None)
def x34(t: Tables) -> DataFrame:
    place = lambda x: [(p, dx.chosen_occurrence(x, p, None)) for _, _, p in dx.passages_of(x) if x.count(p) > 1]
    return dx.per_text(b.chunks(t, "text").filter("text IS NOT NULL"), "text", place, "passage string,first int")


@R.add("D21_partial_recovery", None)
def d21(t: Tables) -> DataFrame:
    """The first half of each chunk's text found in its second half's overlap, as a check of recovery on cut documents."""

    def recover(x: str | None) -> list[tuple]:
        if not x or len(x) < 80:
            return []
        at = dx.recovered_fragment(x[: len(x) * 2 // 3], x[len(x) // 3 :])
        return [at] if at else []

    return dx.per_text(b.chunks(t, "text"), "text", recover, "start int,stop int")
