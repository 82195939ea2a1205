"""Single quarters from cumulative and annual figures, and the metrics built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.finance import average, finite, growth, ratio, unique_or_null

SERIES = ["corp_code", "basis", "metric"]
PERIOD = ["corp_code", "basis", "year", "quarter"]
KINDS = {("Q1", "quarterly"): "q1", ("H1", "quarterly"): "q2", ("Q3", "quarterly"): "q3", ("FY", "quarterly"): "q4", ("Q1", "cumulative"): "c1", ("H1", "cumulative"): "c2", ("Q3", "cumulative"): "c3", ("FY", "annual"): "a"}


def flow_columns(rows: DataFrame) -> DataFrame:
    """One row per series and year with q1..q4, c1..c3 and a; a conflict in a cell is null.

    Conditional min and max are fixed-width partial aggregates: one shuffle of
    a row per series and year and task.
    """
    cell = lambda rt, kind: unique_or_null(finite(F.when((F.col("report_type") == rt) & (F.col("value_type") == kind), F.col("value"))))
    return rows.groupBy(*SERIES, "year").agg(*(cell(rt, kind).alias(name) for (rt, kind), name in KINDS.items()))


def deaccumulate(wide: DataFrame) -> DataFrame:
    """One row per series, year and quarter: value and the method that gave it.

    Stored quarter; else the difference of cumulatives (a missing cumulative is
    rebuilt from stored quarters); else the year less the other three stored
    quarters; else null.  A year is never divided by four.
    """
    q = [F.col(f"q{i}") for i in range(1, 5)]
    totals = [
        F.lit(0.0),
        F.coalesce("c1", "q1"),
        F.coalesce(F.col("c2"), q[0] + q[1]),
        F.coalesce(F.col("c3"), q[0] + q[1] + q[2]),
        F.coalesce(F.col("a"), q[0] + q[1] + q[2] + q[3]),
    ]

    def cell(k: int) -> Column:
        others = [q[i] for i in range(4) if i != k - 1]
        difference = totals[k] - totals[k - 1]
        rest = totals[4] - (others[0] + others[1] + others[2])
        value = F.coalesce(q[k - 1], difference, rest)
        method = F.when(q[k - 1].isNotNull(), "stored").when(difference.isNotNull(), "cumulative difference").when(rest.isNotNull(), "annual minus others")
        sources = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("input"), F.col(c).alias("value"))) for c in ("q1", "q2", "q3", "q4", "c1", "c2", "c3", "a"))))
        return F.struct(F.lit(k).alias("quarter"), value.alias("value"), method.alias("method"), sources.alias("inputs"))

    return wide.select(*SERIES, "year", F.inline(F.array(*(cell(k) for k in range(1, 5)))))


def metric_columns(quarters: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """One row per company, basis and quarter with a column per metric (name -> metric code)."""
    return quarters.filter(F.col("metric").isin(*metrics.values())).groupBy(*PERIOD).agg(*(F.max(F.when(F.col("metric") == code, F.col("value"))).alias(name) for name, code in metrics.items()))


def base_index(rows: DataFrame, value: str, year: int, quarter: int) -> DataFrame:
    """value over the value of one fixed base quarter of the same basis, times 100.

    A base that is missing or not positive makes all null; it is never replaced.
    """
    base = rows.filter((F.col("year") == year) & (F.col("quarter") == quarter)).select("corp_code", "basis", F.col(value).alias("_base"))
    return rows.join(base, ["corp_code", "basis"], "left").withColumn("index", ratio(F.col(value), F.col("_base"))).drop("_base")


def rebase_first_positive(rows: DataFrame, value: str) -> DataFrame:
    """The first period with a positive value becomes 100."""
    at = F.struct("year", "quarter")
    base = rows.filter(F.col(value) > 0).groupBy("corp_code", "basis").agg(F.min_by(value, at).alias("_base"), F.min(at).alias("_at"))
    joined = rows.join(base, ["corp_code", "basis"], "left")
    return joined.withColumn("index", F.when(at >= F.col("_at"), ratio(F.col(value), F.col("_base")))).drop("_base", "_at")


def industrial_metrics(rows: DataFrame, invested: str = "capex") -> DataFrame:
    """Operating margin, investment share and free cash flow margin; ``invested`` is capex, or rd for health."""
    return rows.withColumns(
        {
            "operating_margin": ratio(F.col("operating_income"), F.col("revenue")),
            "invested_share": ratio(F.col(invested), F.col("revenue")),
            "fcf_margin": ratio(F.col("operating_cash_flow") - F.col(invested), F.col("revenue")),
        }
    )


def previous_quarter(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds prev_* of the quarter just before, same basis; a gap stays a gap (equality, not lag)."""
    at = F.col("year") * 4 + F.col("quarter")
    before = rows.select("corp_code", "basis", (at + 1).alias("_at"), *(F.col(c).alias(f"prev_{c}") for c in columns))
    return rows.withColumn("_at", at).join(before, ["corp_code", "basis", "_at"], "left").drop("_at")


def previous_year(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds prev_* of the same key a year before; a gap stays a gap."""
    before = rows.select(*keys, (F.col("year") + 1).alias("year"), *(F.col(c).alias(f"prev_{c}") for c in columns))
    return rows.join(before, [*keys, "year"], "left")


def bank_metrics(rows: DataFrame) -> DataFrame:
    """Return on average equity (annualised), credit cost on average loans (annualised), equity share."""
    w = previous_quarter(rows, ["equity", "loans"])
    return w.withColumns(
        {
            "roe": ratio(F.col("net_income") * 4, average(F.col("equity"), F.col("prev_equity"))),
            "credit_cost": ratio(F.col("credit_loss") * 4, average(F.col("loans"), F.col("prev_loans"))),
            "equity_share": ratio(F.col("equity"), F.col("assets")),
        }
    )


def comparison(rows: DataFrame, keys: list[str], value: str, is_ratio: Column) -> DataFrame:
    """Change against the year before: difference, growth in percent for amounts, points for ratios."""
    w = previous_year(rows, keys, [value])
    d = F.col(value) - F.col(f"prev_{value}")
    return w.withColumns({"difference": d, "growth": F.when(~is_ratio, growth(F.col(value), F.col(f"prev_{value}"))), "points": F.when(is_ratio, d)})


def trim_trailing(rows: DataFrame, scope: list[str], period: Column, metrics: list[str]) -> DataFrame:
    """Drops only the trailing periods of a scope in which every metric is null."""
    some = F.coalesce(*metrics).isNotNull()
    last = F.max(F.when(some, period)).over(Window.partitionBy(*scope))
    return rows.withColumn("_last", last).filter(period <= F.col("_last")).drop("_last")


def annual_history(wide: DataFrame) -> DataFrame:
    """Margin, investment share, free cash flow and yearly growth of annual figures on one basis."""
    rows = previous_year(wide, ["corp_code", "basis"], ["revenue"])
    fcf = F.col("operating_cash_flow") - F.col("capex")
    return rows.withColumns({"operating_margin": ratio(F.col("operating_income"), F.col("revenue")), "capex_share": ratio(F.col("capex"), F.col("revenue")), "fcf": fcf, "fcf_margin": ratio(fcf, F.col("revenue")), "revenue_growth": growth(F.col("revenue"), F.col("prev_revenue"))})


def document_precedence(rows: DataFrame) -> DataFrame:
    """A document series takes the whole (company, year, basis), even where it fails; negative values are null."""
    primary = rows.filter("source_kind = 'DOCUMENT_EXTRACTED'")
    rest = rows.filter("source_kind <> 'DOCUMENT_EXTRACTED'").join(primary.select("corp_code", "year", "basis").distinct(), ["corp_code", "year", "basis"], "left_anti")
    merged = primary.unionByName(rest).filter("in_won").groupBy("corp_code", "year", "basis", "report_type").agg(unique_or_null(F.col("value")).alias("v"))
    return merged.select("corp_code", "year", "basis", "report_type", F.when(F.col("v") >= 0, F.col("v")).alias("value"))


def verified_flow(rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """Single quarters whose inputs all pass the checks; else null with the reasons.

    Checks of an input: approved, in won, not negative, from the active receipt,
    one value.  Columns: corp_code, basis, year, quarter, value, reasons.
    """
    r = receipts.select("corp_code", "year", "report_type", "active_rcept")
    j = rows.join(r, ["corp_code", "year", "report_type"], "left")
    wrong = lambda test, name: F.when(~F.coalesce(test, F.lit(False)), name)
    checks = [wrong(F.col("review_status") == "approved", "review"), wrong(F.col("in_won"), "currency"), wrong(F.col("value") >= 0, "negative"), wrong(F.col("rcept").isNull() | (F.col("rcept") == F.col("active_rcept")), "receipt")]
    checked = j.withColumn("why", F.array_compact(F.array(*checks)))
    per = checked.groupBy("corp_code", "basis", "year", "report_type", "value_type").agg(unique_or_null(F.when(F.size("why") == 0, F.col("value"))).alias("value"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("why")))).alias("why"))
    good = per.withColumn("metric", F.lit("CAPEX"))
    flows = deaccumulate(flow_columns(good)).select("corp_code", "basis", "year", "quarter", "value", "method")
    reasons = per.groupBy("corp_code", "basis", "year").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("why")))).alias("all_why"))
    j2 = flows.join(reasons, ["corp_code", "basis", "year"], "left")
    return j2.select("corp_code", "basis", "year", "quarter", "value", F.when(F.col("value").isNull(), F.col("all_why")).otherwise(F.array().cast("array<string>")).alias("reasons"))
