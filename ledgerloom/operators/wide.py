"""Attribute-value rows into one typed row per entity.

The entity-by-attribute grid is completed inside each entity: the attribute
positions (a literal array as long as the definition table) are left joined with
the entity's values by position, which gives its cells as an array in order of
attribute position; fixed indices are projected through a try cast per type.

Scale: one scan.  Values are first reduced to one row per entity and attribute
by a fixed-width partial aggregation (hot entities shrink before the shuffle),
then collected by entity, and the array of an entity has exactly one element per
attribute, so the join of the grid needs neither a second scan nor a shuffle.  The
definition table is metadata (one row per output column) and is read to the
driver because the output schema depends on it; ``MAX_ATTRIBUTES`` bounds it.

Defined results: of several records of a cell the approved before the pending,
then the direct before the extracted and derived source, then the latest
``loaded_at``, then the larger id gives the value; a cell is *filled* if any of
its records has a value or a text with a letter or digit, even where the text
does not parse as the column's type (then the typed column is null); records
whose keys have no proper spelling are in no entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import canonical

ENTITY = ["corp_code", "year", "report_type", "fs_div"]
MAX_ATTRIBUTES = 2000
REPORTS = ("Q1", "H1", "Q3", "FY")
BASES = ("CFS", "OFS")
#: Room for every int as a year.
YEARS = 1 << 32

# How yes and no are written.
YES = ("1", "Y", "YES", "TRUE", "T", "예", "네")
NO = ("0", "N", "NO", "FALSE", "F", "아니오", "아니요")


def canonical_metrics(values: DataFrame, **more: Column) -> DataFrame:
    """The values with keys in proper spelling, and ``more`` columns; ``metric_letters`` identifies the metric.

    They are emitted by a generator of one row, as the optimizer would otherwise
    copy the expressions into every filter on them and spell each key several times.
    """
    keys = {
        "corp_code": canonical.corp_code(F.col("corp_code")),
        "report_type": canonical.report_type(F.col("report_type")),
        "fs_div": canonical.basis(F.col("fs_div")),
        "metric_letters": canonical.code_letters(F.col("metric_code")),
    } | more
    return values.select(*(c for c in values.columns if c not in keys), F.inline(F.array(F.struct(*(c.alias(name) for name, c in keys.items())))))


def typed(cell: Column, kind: str) -> Column:
    """A cell (value bigint, text string) as the type of its attribute."""
    value, text = cell["value"], cell["text"]
    if kind == "long":
        return F.coalesce(value, F.regexp_replace(text, "[, ]", "").try_cast("bigint"))
    if kind == "date":
        parts = F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1))
        compact = F.when(text.rlike(r"^\s*[0-9]{8}\s*$"), F.try_to_date(F.trim(text), "yyyyMMdd"))
        apart = F.when(F.size(parts) == 3, F.concat_ws("-", F.lpad(parts[0], 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")).try_cast("date"))
        return F.coalesce(compact, apart)
    if kind == "boolean":
        word = F.upper(F.trim(F.coalesce(text, value.cast("string"))))
        return F.when(word.isin(*YES), True).when(word.isin(*NO), False)
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), value.cast("string"))


def attributes(definitions: DataFrame) -> list[tuple[str, str]]:
    """Code and type of every attribute in order of code; bounded metadata."""
    rows = definitions.select("metric_code", "data_type").filter("metric_code IS NOT NULL").distinct().orderBy("metric_code").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes: a wide table is the wrong form")
    seen: dict[str, str] = {}
    for r in rows:
        seen.setdefault(r.metric_code, r.data_type or "string")
    return list(seen.items())


def wide_cells(values: DataFrame, codes: list[str]) -> DataFrame:
    """One row per entity with ``cells``: an array of (filled, value, text) in order of ``codes``."""
    position = F.lit(None).cast("int")
    letters = [("".join(ch for ch in c if ch.isalnum()).upper(), i) for i, c in enumerate(codes)]
    position = F.create_map(*[x for word, i in letters for x in (F.lit(word), F.lit(i))])
    approved = F.when(F.lower(F.trim("review_status")) == "approved", 4).otherwise(0)
    rank = F.struct(
        (approved + F.when(F.col("source_kind") == "DIRECT", 3).when(F.col("source_kind") == "DOCUMENT_EXTRACTED", 2).otherwise(1)).alias("a"),
        F.col("loaded_at").alias("c"),
        F.col("metric_value_id").alias("d"),
    )
    # the entity in one number, as rows are sorted by it: company and kinds above the year
    kind = (F.array_position(F.array(*map(F.lit, REPORTS)), F.col("report_type")) - 1) * 2 + F.array_position(F.array(*map(F.lit, BASES)), F.col("fs_div")) - 1
    packed = (F.col("corp_code").cast("bigint") * 8 + kind) * YEARS + F.col("year") + YEARS // 2
    has_text = F.coalesce(F.col("value_text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    rows = (
        canonical_metrics(values, pos=F.try_element_at(position, canonical.code_letters(F.col("metric_code"))))
        .filter(" AND ".join(f"{c} IS NOT NULL" for c in [*ENTITY, "pos"]))
        .select(packed.alias("entity"), "pos", F.struct((F.col("value").isNotNull() | has_text).alias("filled"), rank.alias("rank"), F.col("value"), F.when(has_text, F.col("value_text")).alias("text")).alias("v"))
    )
    best = rows.groupBy("entity", "pos").agg(F.max("v").alias("v"))
    # at most one element per attribute
    entity = best.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("values"))
    grid = F.sequence(F.lit(0), F.lit(len(codes) - 1))
    cell = lambda i, v: F.struct(i.alias("pos"), F.coalesce(v["filled"], F.lit(False)).alias("filled"), v["value"].alias("value"), v["text"].alias("text"))
    head = F.floor(F.col("entity") / YEARS)
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    keys = [
        F.lpad(F.floor(head / 8).cast("string"), 8, "0").alias("corp_code"),
        (F.pmod("entity", F.lit(YEARS)) - YEARS // 2).cast("int").alias("year"),
        pick(REPORTS, F.floor(F.pmod(head, F.lit(8)) / 2)).alias("report_type"),
        pick(BASES, F.pmod(head, F.lit(2))).alias("fs_div"),
    ]
    return entity.select(*keys, F.transform(grid, lambda i: cell(i, F.try_element_at("values", i))).alias("cells"))


def wide_table(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per entity, one typed column per attribute, and ``filled_codes``."""
    columns = attributes(definitions)
    if not columns:
        return values.select(*ENTITY, F.array().cast("array<string>").alias("filled_codes")).limit(0)
    cells = wide_cells(values, [c for c, _ in columns])
    names = F.array(*(F.lit(c) for c, _ in columns))
    filled = F.transform(F.filter("cells", lambda c: c["filled"]), lambda c: F.element_at(names, c["pos"] + 1))
    return cells.select(*ENTITY, *(typed(F.col("cells")[i], kind).alias(code) for i, (code, kind) in enumerate(columns)), filled.alias("filled_codes"))


def filled_cells(wide: DataFrame) -> DataFrame:
    """One row per filled cell of a wide table."""
    return wide.select(*ENTITY, F.explode("filled_codes").alias("metric_code"))
