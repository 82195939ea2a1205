"""Releases, validation and the composite read queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.facts import REPORT_ORDER, exactly_one
from ledgerloom.operators.ranking import ordinal


def current_release(versions: DataFrame) -> DataFrame:
    """The one current and validated release; the query fails unless there is exactly one."""
    return exactly_one(versions, [(F.col("is_current") == 1) & (F.col("validated") == 1)])


def pinned_status(versions: DataFrame, hashes: list[str], present: list[DataFrame]) -> DataFrame:
    """For every release what pinning it gives: usable, or why not.

    A pinned release must be validated, equal the registered (current) one in
    every column of ``hashes``, null equalling nothing, and have rows in each of
    ``present`` (data_version and a count).  There is a row per release, so all
    sides are tiny.
    """
    now = current_release(versions).select(*(F.col(c).alias(f"_{c}") for c in hashes))
    rows = versions.join(F.broadcast(now))
    counts = []
    for i, df in enumerate(present):
        name = next(c for c in df.columns if c != "data_version")
        counts.append(F.coalesce(F.col(f"_n{i}"), F.lit(0)))
        rows = rows.join(F.broadcast(df.select("data_version", F.col(name).alias(f"_n{i}"))), "data_version", "left")
    status = F.lit("usable")
    for n in counts:
        status = F.when(n == 0, "absent").otherwise(status)
    for c in reversed(hashes):
        status = F.when(~F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)), f"{c} differs").otherwise(status)
    return rows.select(*versions.columns, F.when(F.coalesce("validated", F.lit(0)) != 1, "not validated").otherwise(status).alias("status"))


def equivalence(pairs: DataFrame, releases: DataFrame, log: DataFrame | None) -> DataFrame:
    """How a selected release's financial content equals that of the registered one: registered, selected, equivalence.

    ``releases`` has data_version, created_at, validated and content_hash.  Equal
    hashes are the same content.  Otherwise only a logged patch counts that did
    nothing but set document ids: the selected release is the validated one just
    before the registered, and ``log`` (data_version, table_name, status,
    rows_source, rows_inserted, rows_updated, rows_deactivated, finished_at) has
    runs of the registered one, all of them finished and successful updates of
    every row of ``financial_metric_values_document_id`` without an insert or
    deactivation.
    """
    of = lambda name: releases.select(F.col("data_version").alias(name), F.col("content_hash").alias(f"_{name}"))
    rows = pairs.join(F.broadcast(of("registered")), "registered", "left").join(F.broadcast(of("selected")), "selected", "left")
    rows = rows.join(F.broadcast(preceding(releases).select(F.col("data_version").alias("registered"), "preceding")), "registered", "left")
    patch = F.lit(False)
    if log is not None:
        clean = (
            (F.col("table_name") == "financial_metric_values_document_id") & (F.col("status") == "success") & (F.col("rows_inserted") == 0) & (F.col("rows_deactivated") == 0) & (F.col("rows_updated") == F.col("rows_source")) & F.col("finished_at").isNotNull()
        )
        runs = log.groupBy(F.col("data_version").alias("registered")).agg(F.bool_and(F.coalesce(clean, F.lit(False))).alias("clean"))
        rows = rows.join(F.broadcast(runs), "registered", "left")
        patch = F.coalesce("clean", F.lit(False)) & F.coalesce(F.col("preceding") == F.col("selected"), F.lit(False))
    same = F.coalesce(F.col("_registered") == F.col("_selected"), F.lit(False))
    return rows.select("registered", "selected", F.when(same, "same content").when(patch, "document ids only").otherwise("content differs").alias("equivalence"))


def preceding(versions: DataFrame) -> DataFrame:
    """Each release with the validated one just before it (a row per release: tiny)."""
    a = versions.select("data_version", "created_at")
    p = versions.filter("validated = 1").select(F.col("data_version").alias("p_version"), F.col("created_at").alias("p_at"))
    j = a.join(F.broadcast(p), F.col("p_at") < F.col("created_at"), "left")
    return j.groupBy("data_version").agg(F.max_by("p_version", "p_at").alias("preceding"))


def compatible(versions: DataFrame) -> DataFrame:
    """Pairs of releases over the same index."""
    v = versions.select("index_version", F.col("data_version").alias("compatible"))
    return versions.select("data_version", "index_version").join(F.broadcast(v), "index_version").select("data_version", "compatible")


def fingerprint(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Rows and an order-free hash per scope: equal fingerprints mean an unchanged table."""
    h = F.xxhash64(*[c for c in rows.columns if c not in scope])
    return rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("total"))


def financials(slots: DataFrame, corp_code: str, year: int, report_type: str = "FY", accounts: list[str] | None = None, value_type: str | None = None) -> DataFrame:
    rows = slots.filter((F.col("corp_code") == corp_code) & (F.col("year") == year) & (F.col("report_type") == report_type))
    if accounts:
        rows = rows.filter(F.col("metric").isin(*accounts))
    if value_type:
        rows = rows.filter(F.col("value_type") == value_type)
    return rows.orderBy("metric", "basis", "value_type")


def trend(slots: DataFrame, corp_code: str, metric: str, value_type: str = "quarterly", years: list[int] | None = None) -> DataFrame:
    rows = slots.filter((F.col("corp_code") == corp_code) & (F.col("metric") == metric) & (F.col("value_type") == value_type))
    if years:
        rows = rows.filter(F.col("year").isin(*years))
    return rows.orderBy("year", ordinal(F.col("report_type"), REPORT_ORDER), "basis")


def analysis_years(rows: DataFrame, requested: list[int]) -> DataFrame:
    """The available years and whether each was requested; the query fails if a requested year is missing."""
    years = rows.distinct()
    missing = years.agg(F.array_except(F.array(*map(F.lit, requested)), F.collect_set("year")).alias("m"))
    ok = missing.select(F.when(F.size("m") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("years not in this release: "), F.array_join(F.transform("m", lambda x: x.cast("string")), ","))).cast("boolean")).alias("ok"))
    return years.join(F.broadcast(ok.filter("ok"))).select("year", F.col("year").isin(*requested).alias("requested"))


def excerpt_agrees(text: Column, start: Column, stop: Column, quote: Column) -> Column:
    """Whether a quote equals the stored text between two places (0-based, end exclusive)."""
    return F.substring(text, start + 1, stop - start) == quote


def period_union(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every series over the union of all periods, null where it has none.

    The list of periods is a calendar (four a year), collected into one bounded
    array and exploded per series.
    """
    periods = rows.select("year", "quarter").distinct().agg(F.array_sort(F.collect_list(F.struct("year", "quarter"))).alias("p"))
    grid = rows.select(*keys).distinct().join(F.broadcast(periods)).select(*keys, F.inline("p"))
    return grid.join(rows.select(*keys, "year", "quarter", value), [*keys, "year", "quarter"], "left")

