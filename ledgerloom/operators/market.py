"""Daily market series: closes, snapshots, histories and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.finance import growth
from ledgerloom.operators.ranking import keep_first, top_per_group


def daily_closes(ticks: DataFrame, instrument: str, ts: str, value: str, tie: str) -> DataFrame:
    """The last value of every instrument and day."""
    return ticks.filter(F.col(value).isNotNull()).groupBy(F.col(instrument).alias("instrument"), F.to_date(ts).alias("day")).agg(F.max_by(value, F.struct(ts, tie)).alias("close"))


def close_snapshot(days: DataFrame, as_of: str) -> DataFrame:
    """The last two sessions before ``as_of`` with the change; instruments with fewer than two are left out."""
    once = keep_first(days, ["instrument", "day"], [F.col("close").asc_nulls_last()])
    last = top_per_group(once.filter(F.col("day") < F.lit(as_of).cast("date")), ["instrument"], [F.desc("day")], 2, "n")
    at = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    pair = last.groupBy("instrument").agg(at(1, "day").alias("day"), at(1, "close").alias("close"), at(2, "close").alias("previous"), F.count(F.lit(1)).alias("sessions")).filter("sessions = 2")
    return pair.withColumns({"change_percent": growth(F.col("close"), F.col("previous")), "change_points": F.col("close") - F.col("previous")})


def month_end(days: DataFrame, most: int) -> DataFrame:
    """A series of more than ``most`` points by its last point a month, others as they are."""
    size = days.groupBy("instrument").agg(F.count(F.lit(1)).alias("points"))
    sized = days.join(size, "instrument")
    period = F.when(F.col("points") > most, F.trunc("day", "month")).otherwise(F.col("day"))
    return sized.groupBy("instrument", period.alias("period")).agg(F.max("day").alias("day"), F.max_by("close", "day").alias("close")).select("instrument", "day", "close")


def merge_history(old: DataFrame, new: DataFrame, as_of: str, months: int) -> DataFrame:
    """New over old by day, inside a window of months before ``as_of``."""
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1))).filter(F.col("day") > F.add_months(F.lit(as_of).cast("date"), -months))
    return both.groupBy("instrument", "day").agg(F.max_by("close", "_g").alias("close"))


def backfill_days(fetched: DataFrame, since: str, until: str, recheck: int) -> DataFrame:
    """Weekdays not fetched yet, and the last ``recheck`` days again."""
    spark = fetched.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("day"))
    again = F.col("day") > F.date_sub(F.lit(until).cast("date"), recheck)
    known = fetched.select("day").distinct().withColumn("known", F.lit(True))
    weekdays = days.filter(F.dayofweek("day").between(2, 6))
    return weekdays.join(known, "day", "left").filter(again | F.col("known").isNull()).select("day", again.alias("recheck"))


def cap_text(text: Column) -> Column:
    """Won of a text like 1,234조 5,678억; null if there is neither unit."""
    part = lambda unit: F.regexp_replace(F.nullif(F.regexp_extract(text, rf"([0-9][0-9,]*)\s*{unit}", 1), F.lit("")), ",", "").try_cast("bigint")
    tera, oku = part("조"), part("억")
    return F.when(tera.isNotNull() | oku.isNotNull(), F.coalesce(tera, F.lit(0)) * 10**12 + F.coalesce(oku, F.lit(0)) * 10**8)


# Filing categories and the words that tell them, first match wins.
CATEGORIES = (("설비·생산", "시설|설비|공장|생산"), ("공급·계약", "공급|계약"), ("연구·제품", "연구|개발|특허"), ("정기보고", "사업보고서|반기보고서|분기보고서"), ("실적", "영업.*실적|잠정|손익"))


def filing_category(title: Column) -> Column:
    chain = F.lit("기타 공시")
    for name, pattern in reversed(CATEGORIES):
        chain = F.when(title.rlike(pattern), name).otherwise(chain)
    return F.when(title.isNotNull(), chain)


def carry_over(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The new value, or the old one marked stale where the new is missing."""
    j = old.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new")), keys, "full")
    return j.select(*keys, F.coalesce("_new", "_old").alias(value), F.col("_new").isNull().alias("stale"))
