"""What changed between full snapshots.

Each row becomes (key, snapshot index, hash of the compared fields).  One window
per key over the snapshot index compares neighbours: a lagged hash that differs
is a change, a gap in the index is a removal followed by a later addition.  All
snapshots are handled in one pass, however many there are.

Scale: the fields are reduced to a 64-bit hash before the first shuffle.
Duplicate rows inside a snapshot are merged by a fixed-width partial
aggregation, so a key that holds a third of all rows is one row per task and
snapshot; the window then sees at most one row per key and snapshot.  The list
of snapshots is one row per release and its broadcast is bounded by that.

Defined results: null fields are values of their own; of several deliveries of
a key in one snapshot the last ``loaded_at`` counts (ties: the larger hash); rows
with a null key part form the key with that part empty; snapshots not in the
list (or not validated) are left out; the first snapshot has no cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import canonical


def snapshot_order(versions: DataFrame) -> DataFrame:
    """Validated releases with their place in time (data_version, idx, last).

    ``versions`` holds a row per release, so its one-partition window is tiny.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("created_at", "data_version")
    valid = versions.filter("validated = 1").groupBy("data_version").agg(F.min("created_at").alias("created_at"))
    return valid.select("data_version", (F.row_number().over(order) - 1).alias("idx"), (F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) - 1).cast("int").alias("last"))


def snapshot_changes(snapshots: DataFrame, versions: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Added, removed and changed records: data_version, record_key, change_kind."""
    order = F.broadcast(snapshot_order(versions))
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    # A null and the text that could stand for it must not hash alike.
    fields = [F.struct(F.col(c).isNull(), canonical.folded(F.col(c))) for c in compared]
    state = (
        snapshots.select("data_version", key.alias("record_key"), F.xxhash64(*fields).alias("hash"), "loaded_at")
        .join(order.select("data_version", "idx", "last"), "data_version")
        .groupBy("record_key", "idx", "last")
        .agg(F.max(F.struct("loaded_at", "hash"))["hash"].alias("hash"))
    )
    w = Window.partitionBy("record_key").orderBy("idx")
    seen = state.select("record_key", "idx", "last", "hash", F.lag("idx").over(w).alias("before"), F.lag("hash").over(w).alias("old"), F.lead("idx").over(w).alias("after"))
    case = lambda at, kind: F.struct(at.cast("int").alias("idx"), F.lit(kind).alias("change_kind"))
    fresh = (F.col("idx") > 0) & (F.col("before").isNull() | (F.col("before") < F.col("idx") - 1))
    changed = (F.col("before") == F.col("idx") - 1) & (F.col("old") != F.col("hash"))
    gone = F.coalesce(F.col("after") > F.col("idx") + 1, F.col("idx") < F.col("last"))
    cases = F.array_compact(F.array(F.when(fresh, case(F.col("idx"), "added")), F.when(changed, case(F.col("idx"), "changed")), F.when(gone, case(F.col("idx") + 1, "removed"))))
    return (
        seen.filter(fresh | changed | gone)
        .select("record_key", F.explode(cases).alias("c"))
        .select("record_key", "c.idx", "c.change_kind")
        .join(order.select("data_version", "idx"), "idx")
        .select("data_version", "record_key", "change_kind")
    )


#: Compared fields and keys of the two snapshot tables.
CHUNK_HISTORY = {"keys": ["chunk_id"], "compared": ["rcept_no", "section_name", "content_hash", "is_searchable"]}
COVERAGE = {"keys": ["corp_code", "year", "report_type"], "compared": ["fs_div", "filing_exists", "chunk_exists", "embedding_exists", "status"]}
