"""Ranking, top-k and score operators.

All windows are partitioned by the caller's scope; where a rank over a whole
result is asked for, the result is an aggregate (keywords, companies), not rows.
Every order ends in a unique key, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.finance import finite


def ordinal(value: Column, order: list) -> Column:
    """Place of a value in a configured order, unknown last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; the limit is applied before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Deterministic deduplication: the first row of every key."""
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def percentile_score(value: Column, scope: list[str]) -> Column:
    """Average rank of ties as a percentage of the group's size."""
    ordered = Window.partitionBy(*scope).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*scope, value))
    size = F.count(F.lit(1)).over(Window.partitionBy(*scope))
    return (F.rank().over(ordered) + (ties - 1) / F.lit(2).cast("double")) / size * 100


def midrank_position(value: Column, scope: list[str]) -> Column:
    """100 * (smaller + half of equal) / n where n is at least 2, else null."""
    ordered = Window.partitionBy(*scope).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*scope, value))
    size = F.count(F.lit(1)).over(Window.partitionBy(*scope))
    return F.when(size >= 2, (F.rank().over(ordered) - 1 + ties * F.lit(0.5)) / size * 100)


def display_weight(score: Column, rank: Column, scope: list[str]) -> Column:
    """30 + 70 * (0.7 * minmax squared + 0.3 * rank share); equal scores go by rank only, a single item is 100."""
    w = Window.partitionBy(*scope)
    low, high, n = F.min(score).over(w), F.max(score).over(w), F.count(F.lit(1)).over(w)
    by_rank = F.when(n > 1, 1 - (rank - 1) / (n - 1)).otherwise(F.lit(1.0))
    spread = F.when(high > low, (score - low) / F.nullif(high - low, F.lit(0.0)))
    mixed = F.when(high > low, 0.7 * spread * spread + 0.3 * by_rank).otherwise(by_rank)
    return F.when(n == 1, F.lit(100.0)).otherwise(30 + 70 * mixed)


def hot_flags(df: DataFrame, scope: list[str], top_n: int, score_floor: float = 90.0, limit: int = 3) -> DataFrame:
    """Adds ``hot``: the first ``limit`` rising keywords among the top ``top_n`` of a scope.

    Needs keyword, final_rank, change_raw, change_score and final_score.
    """
    able = (F.col("final_rank") <= top_n) & (F.col("change_score") >= score_floor) & (F.col("change_raw") > 0)
    w = Window.partitionBy(*scope, able).orderBy(F.desc("change_raw"), F.desc("change_score"), F.desc("final_score"), "final_rank", "keyword")
    return df.withColumn("hot", F.coalesce(able, F.lit(False)) & (F.row_number().over(w) <= limit))


def budgeted_round_robin(df: DataFrame, scope: list[str], lane: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows picked lane by lane in turn under a size budget; a row that would overflow is skipped and later ones may still fit.

    The fold runs over the ordered sizes of one scope (a report's evidence, at
    most a few hundred rows), inside the JVM.
    """
    turns = df.withColumn("_turn", F.row_number().over(Window.partitionBy(*scope, lane).orderBy(*order))).withColumn("_size", size.cast("long"))
    ranked = turns.withColumn("_at", F.row_number().over(Window.partitionBy(*scope).orderBy("_turn", lane)))
    lists = ranked.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("_at", "_size"))).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["_size"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["_size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["_at"]))).otherwise(acc["kept"]).alias("kept"))

    kept = lists.select(*scope, F.explode(F.aggregate("_all", start, step)["kept"]).alias("_at"))
    return ranked.join(kept, [*scope, "_at"]).drop("_turn", "_size").withColumnRenamed("_at", "position")


def capital_weights(df: DataFrame, scope: list[str], cap: str) -> DataFrame:
    """Adds ``weight``: cap over the scope's total, null for all if any cap is missing or not positive."""
    w = Window.partitionBy(*scope)
    bad = F.max(F.when(F.coalesce(finite(F.col(cap)) > 0, F.lit(False)), 0).otherwise(1)).over(w)
    return df.withColumn("weight", F.when(bad == 0, F.col(cap) / F.sum(cap).over(w)))
