"""References to records that do not exist.

Every table contributes *deltas*: a referring record adds +1 to the reference
count of the key it names, a live target adds +1 to the existence count of its
own key and carries the time it became known, a withdrawn one -1.  Summing the
deltas per key and time gives a state that can be kept and moved forward by later
deltas (``apply_deltas``).  Keys with positive references and zero existence are
the orphan report; where a key does exist, only the references older by more than
the grace period than the time since when it has existed are orphans.

Scale: the state is a partial (map-side) aggregation, so a key that holds a
third of all references reaches the shuffle as one row per task; all its
references are one row of the state, its targets one row a time.  References
join the state once; a hot key in that join is one right row against many left
rows, which AQE splits (nothing after the join needs its partitioning).  Only
ids, keys and times are read and shuffled, never texts or vectors.

Defined results: null keys are no references; repeated deliveries are one
record with its first ``loaded_at``; a null ``loaded_at`` counts as known from
the start on the target side and as never too early on the referring side; empty
tables give an empty report; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import canonical

GRACE = "INTERVAL 24 HOURS"
STATE = ["space", "key"]


@dataclass(frozen=True)
class Link:
    """``column`` of the referring table, read by ``key``, points into ``space``."""

    space: str
    column: str
    key: Column


@dataclass(frozen=True)
class Participant:
    """A table that refers (``links``), is referred to (``target``: space and key), or both."""

    name: str
    record_id: Column
    links: tuple[Link, ...] = ()
    target: tuple[str, Column] | None = None


def table_deltas(df: DataFrame, part: Participant) -> DataFrame:
    """Signed deltas of one table, one scan for both its roles.

    Columns: space, key, table_name, column_name, record_id, at, refs, found.
    """
    keys = [x.key.cast("string").alias(f"_k{i}") for i, x in enumerate(part.links)]
    own = part.target[1].cast("string") if part.target else F.lit(None).cast("string")
    once = (
        df.select(part.record_id.cast("string").alias("record_id"), *keys, own.alias("_own"), F.col("is_active").cast("int").alias("_active") if part.target else F.lit(0).alias("_active"), F.col("loaded_at").alias("_at"))
        .groupBy("record_id", *(f"_k{i}" for i in range(len(keys))), "_own", "_active")
        .agg(F.min("_at").alias("at"))
    )
    rows = [F.struct(F.lit(x.space).alias("space"), F.col(f"_k{i}").alias("key"), F.lit(x.column).alias("column_name"), F.lit(1).alias("refs"), F.lit(0).alias("found")) for i, x in enumerate(part.links)]
    if part.target:
        rows.append(F.struct(F.lit(part.target[0]).alias("space"), F.col("_own").alias("key"), F.lit(None).cast("string").alias("column_name"), F.lit(0).alias("refs"), F.when(F.col("_active") == 1, 1).otherwise(0).alias("found")))
    return (
        once.select("record_id", "at", F.explode(F.array(*rows)).alias("d"))
        .select("d.space", "d.key", F.lit(part.name).alias("table_name"), "d.column_name", "record_id", "at", "d.refs", "d.found")
        .filter("key IS NOT NULL AND (refs <> 0 OR found <> 0)")
    )


def apply_deltas(deltas: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after ``deltas``: signed counts refs and found per key, and of the targets per time they changed.

    Columns: space, key, at (null in the row that counts the references), refs,
    found.  ``state`` is an earlier result; counts add up in any order, so
    deltas may be negative: a withdrawn record is -1 at the time of its withdrawal.
    """
    since = F.when(F.col("found") != 0, F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")))
    parts = deltas.select(*STATE, since.alias("at"), "refs", "found")
    if state is not None:
        parts = parts.unionByName(state.select(*STATE, "at", "refs", "found"))
    return parts.groupBy(*STATE, "at").agg(F.sum("refs").alias("refs"), F.sum("found").alias("found"))


def current(state: DataFrame) -> DataFrame:
    """One row per key: refs, found, and found_at, since when the key has existed without a break.

    A key exists while the running sum of its targets' changes is positive; a
    withdrawal that brings it to zero ends that, and a later arrival begins anew.
    """
    history = Window.partitionBy(*STATE).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = state.withColumn("n", F.sum("found").over(history))
    begins = (F.col("n") > 0) & (F.col("n") - F.col("found") <= 0)
    return running.groupBy(*STATE).agg(F.sum("refs").alias("refs"), F.sum("found").alias("found"), F.max(F.when(begins, F.col("at"))).alias("found_at"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current orphan report by key: positive references, zero existence."""
    return current(state).filter("refs > 0 AND found <= 0")


def orphan_references(deltas: DataFrame, state: DataFrame, grace: str = GRACE) -> DataFrame:
    """Referring records without a live target in time: table_name, column_name, record_id, space, key, at, reason."""
    refs = deltas.filter("refs > 0").select(*STATE, "table_name", "column_name", "record_id", "at")
    known = current(state).filter("found > 0").select(*STATE, "found_at")
    late = F.col("found_at") > F.col("at") + F.expr(grace)
    return (
        refs.join(known, STATE, "left")
        .filter(F.col("found_at").isNull() | late)
        .select("table_name", "column_name", "record_id", *STATE, "at", F.when(F.col("found_at").isNull(), "missing").otherwise("late").alias("reason"))
    )


def orphans_per_period(orphans: DataFrame) -> DataFrame:
    """Orphans per table, column and month of the referring record."""
    return orphans.groupBy("table_name", "column_name", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("orphans"), F.count_if(F.col("reason") == "late").alias("late"))


def disclosure_participants() -> dict[str, Participant]:
    """The reference relations of the disclosure tables."""
    receipt = lambda c: canonical.receipt_digits(F.col(c))
    return {
        "chunk_metadata": Participant("chunk_metadata", F.col("chunk_id"), (Link("embedding", "vector_id", F.col("vector_id")), Link("filing", "rcept_no", receipt("rcept_no"))), ("chunk", F.col("vector_id"))),
        "chunk_embeddings": Participant("chunk_embeddings", F.col("embedding_id"), (Link("chunk", "embedding_id", F.col("embedding_id")),), ("embedding", F.col("embedding_id"))),
        "filing_source_documents": Participant("filing_source_documents", F.col("document_id"), (Link("filing", "rcept_no", receipt("rcept_no")),)),
        "financial_metric_values": Participant("financial_metric_values", F.col("metric_value_id"), (Link("filing", "source_rcept_no", receipt("source_rcept_no")),)),
        "filings": Participant("filings", F.col("rcept_no"), (), ("filing", receipt("rcept_no"))),
    }


def all_deltas(tables: dict[str, DataFrame]) -> DataFrame:
    parts = disclosure_participants()
    return reduce(DataFrame.unionByName, [table_deltas(df, parts[name]) for name, df in tables.items()])
