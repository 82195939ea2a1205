"""Reported facts: one value per slot, scopes, receipts and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import canonical
from ledgerloom.functions.finance import conflicting, unique_or_null
from ledgerloom.operators.ranking import keep_first

REPORT_ORDER = ["Q1", "H1", "Q3", "FY"]
SLOT = ["corp_code", "year", "report_type", "basis", "metric", "value_type"]
# How the plain won is written.
WON = ("krw", "won", "원", "₩")


def facts(values: DataFrame) -> DataFrame:
    """The metric values as facts: keys in proper spelling, one row per record."""
    return (
        values.select(
            "metric_value_id",
            canonical.corp_code(F.col("corp_code")).alias("corp_code"),
            "year",
            canonical.report_type(F.col("report_type")).alias("report_type"),
            canonical.basis(F.col("fs_div")).alias("basis"),
            canonical.code_letters(F.col("metric_code")).alias("metric"),
            "value_type",
            "value",
            canonical.folded(F.col("unit")).isin(*WON).alias("in_won"),
            "source_kind",
            "review_status",
            canonical.receipt_digits(F.col("source_rcept_no")).alias("rcept"),
        )
        .distinct()
        .filter("corp_code IS NOT NULL AND year IS NOT NULL AND report_type IS NOT NULL AND basis IS NOT NULL AND metric IS NOT NULL")
    )


def selected_value(calculated: Column, derived: Column, reported: Column) -> Column:
    """The calculated value of a calculated fact, else the reported one."""
    return F.when(calculated, derived).otherwise(reported)


def slots(rows: DataFrame) -> DataFrame:
    """One value per slot or null where sources disagree, with a conflict flag."""
    return rows.groupBy(*SLOT).agg(unique_or_null(F.col("value")).alias("value"), conflicting(F.col("value")).alias("conflict"))


def slot_pick(rows: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """The first row of every slot in order of priority."""
    return keep_first(rows, keys, priority)


def tagged_candidates(rows: DataFrame, tags: list[tuple[str, str, int]]) -> DataFrame:
    """Rows of tagged metrics with their account and priority, united with all others as fallback (priority 9).

    The tag list is a literal relation and joins by broadcast.
    """
    relation = rows.sparkSession.createDataFrame(tags, "metric string, account string, priority int")
    tagged = rows.join(F.broadcast(relation), "metric")
    rest = rows.join(F.broadcast(relation.select("metric")), "metric", "left_anti").withColumn("account", F.col("metric")).withColumn("priority", F.lit(9))
    return tagged.unionByName(rest)


def report_alias(kind: Column) -> Column:
    """HY is H1."""
    return F.when(kind == "HY", "H1").otherwise(kind)


def default_value_type(report_type: Column) -> Column:
    return F.when(report_type == "FY", "annual").otherwise("cumulative")


def fact_slice(rows: DataFrame, report_type: str = "FY", basis: str = "CFS", value_type: str | None = None) -> DataFrame:
    """Facts of a report type and basis of the given kind, or at a point in time."""
    kind = value_type or ("annual" if report_type == "FY" else "cumulative")
    return rows.filter((F.col("report_type") == {"HY": "H1"}.get(report_type, report_type)) & (F.col("basis") == basis) & F.col("value_type").isin(kind, "point_in_time"))


def first_section_value(rows: DataFrame, keys: list[str], section: str, order: list[str]) -> DataFrame:
    """The unique value of the first section that has one; ``conflict`` where a section disagrees before that."""
    per = rows.groupBy(*keys, section).agg(unique_or_null(F.col("value")).alias("v"), conflicting(F.col("value")).alias("c"))
    pick = lambda s, c: F.max(F.when(F.col(section) == s, F.col(c)))
    return per.groupBy(*keys).agg(F.coalesce(*(pick(s, "v") for s in order)).alias("value"), F.max("c").alias("conflict"))


def active_receipts(filings: DataFrame) -> DataFrame:
    """The active receipt of every (company, year, type), null where there is more than one."""
    active = filings.filter("is_active = 1").select("corp_code", "year", "report_type", canonical.receipt_digits(F.col("rcept_no")).alias("rcept"))
    return active.groupBy("corp_code", "year", "report_type").agg(unique_or_null(F.col("rcept")).alias("active_rcept"), F.count_distinct("rcept").alias("receipts"))


def basis_choice(rows: DataFrame, keys: list[str], preferred: Column | None = None) -> DataFrame:
    """The preferred basis if it has any fact, else CFS, else OFS."""
    rank = F.when(F.col("basis") == "CFS", 1).otherwise(2)
    if preferred is not None:
        rank = F.when(F.col("basis") == preferred, 0).otherwise(rank)
    return rows.groupBy(*keys).agg(F.min_by("basis", rank).alias("basis"))


def release_filter(column: str, versions: list[str]) -> Column:
    return F.col(column).isin(*versions)


def exactly_one(rows: DataFrame, tests: list[Column]) -> DataFrame:
    """The one row matching any test; an error (raised by the query) unless there is exactly one."""
    hit = rows.filter(reduce(lambda a, b: a | b, tests))
    n = hit.agg(F.count(F.lit(1)).alias("_n"))
    checked = n.select(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("expected one row, found "), F.col("_n").cast("string"))).cast("boolean")).alias("_ok"))
    return hit.join(F.broadcast(checked.filter("_ok"))).drop("_ok")


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Per release: periods, companies, missing parts and rows that are not PASS."""
    state = F.upper(F.trim("status"))
    return coverage.groupBy("data_version").agg(
        F.count_distinct("corp_code", "year", "report_type").alias("periods"),
        F.count_distinct("corp_code").alias("companies"),
        F.count_if(F.col("chunk_exists") == 0).alias("without_chunks"),
        F.count_if(F.col("embedding_exists") == 0).alias("without_embeddings"),
        F.count_if(state != "PASS").alias("not_pass"),
    )
