"""Frequency of every distinct value or term.

Heavy-light aggregation.  A first pass finds the terms that make up much of the
collection with a bounded sketch over all rows; they are broadcast (at most
``HEAVY`` terms, whatever the collection's size).  In the second pass every task
counts the heavy terms in exact local arrays, one number per term, and combines
the others in a local table that is handed on when it is full.  The light counts
are shuffled by term, of the heavy arrays one number a term and task is; both are
added up in tables of their own, and the two tables are united.  The sketch only decides where a term is counted:
every count is exact.

Terms of a record are counted where the record stands, so a record's text is
never exploded over the network; the record's own repeats are folded first,
which gives occurrences and records in the same pass.

Defined results: each record id counts once (its first delivery); a null or
empty field counts for nothing, also not towards the share; marks are ``rare``
(in fewer than ``min_records`` records), ``common`` (in more than
``max_share`` of the records whose field is neither null nor empty) or null.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 2048
LIGHT_TABLE = 200_000

WORD = re.compile("[가-힣a-z0-9]+")
SEPARATOR = re.compile("[;,|/]")


def text_terms(text: str) -> list[str]:
    """Maximal runs of Hangul syllables, a-z and 0-9 that are not digits only."""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    return [w for w in WORD.findall(folded) if not w.isdigit()]


def list_entries(text: str) -> list[str]:
    """Entries between the separators, trimmed, inner white space made one blank."""
    folded = unicodedata.normalize("NFKC", text).lower()
    return [e for e in (" ".join(part.split()) for part in SEPARATOR.split(folded)) if e]


SPLITTERS: dict[str, Callable[[str], list[str]]] = {"text": text_terms, "keyword": list_entries}


def once_per_record(rows: DataFrame, id_column: str, fields: list[str]) -> DataFrame:
    """The fields of each record's first delivery; copies are combined before the shuffle."""
    first = F.min_by(F.struct(*fields), F.struct(F.col("loaded_at").isNull(), F.col("loaded_at"), *fields))
    return rows.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(first.alias("r")).select("r.*")


def heavy_terms(records: DataFrame, splitters: dict[str, Callable[[str], list[str]]], heavy: int = HEAVY) -> list[tuple[str, str]]:
    """At most ``heavy`` (field, term) that may be frequent: the merged leaders of a bounded counter per task.

    Every task keeps a space-bounded counter over all its rows (lossy counting:
    when it exceeds 8 x ``heavy`` terms all counts lose the smallest kept one),
    so the result is bounded by ``heavy`` however large the collection is.
    """

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: Counter = Counter()
        for pdf in frames:
            for field, split in splitters.items():
                for text in pdf[field]:
                    if text:
                        for term in split(text):
                            kept[field, term] += 1
                if len(kept) > 8 * heavy:
                    least = sorted(kept.values(), reverse=True)[4 * heavy]
                    kept = Counter({k: n - least for k, n in kept.items() if n > least})
        top = kept.most_common(heavy)
        yield pd.DataFrame({"field_name": [f for (f, _), _ in top], "term": [t for (_, t), _ in top], "n": [n for _, n in top]})

    leaders = records.mapInPandas(lead, "field_name string, term string, n bigint").groupBy("field_name", "term").agg(F.sum("n").alias("n"))
    return [(r.field_name, r.term) for r in leaders.filter(F.length("term") <= 200).orderBy(F.desc("n"), "field_name", "term").limit(heavy).collect()]


def term_counts(records: DataFrame, raw: DataFrame, splitters: dict[str, Callable[[str], list[str]]] = SPLITTERS, heavy: int = HEAVY, light_table: int = LIGHT_TABLE) -> DataFrame:
    """(field_name, term, occurrences, records, total) of every term; the null term of a field (total true) counts its non-empty records.

    ``raw`` holds the fields before deliveries are merged; heavy terms are found
    in it, by a job that runs while the plan is built.
    """
    hot = records.sparkSession.sparkContext.broadcast(heavy_terms(raw, splitters, heavy))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*((f, None) for f in splitters), *hot.value]
        place = {name: i for i, name in enumerate(names)}
        occurrences = np.zeros(len(names), dtype=np.int64)
        records_of = np.zeros(len(names), dtype=np.int64)
        light: dict[tuple[str, str], list[int]] = {}

        def part(keys: list[tuple[str, str | None]], occ: list[int], rec: list[int], is_heavy: bool) -> pd.DataFrame:
            return pd.DataFrame({"field_name": [f for f, _ in keys], "term": pd.Series([t for _, t in keys], dtype=object), "occurrences": occ, "records": rec, "heavy": is_heavy})

        for pdf in frames:
            for field, split in splitters.items():
                filled = 0
                for text in pdf[field]:
                    if not text:
                        continue
                    filled += 1
                    for term, n in Counter(split(text)).items():
                        at = place.get((field, term))
                        if at is not None:
                            occurrences[at] += n
                            records_of[at] += 1
                        else:
                            c = light.get((field, term))
                            if c is None:
                                light[field, term] = [n, 1]
                            else:
                                c[0] += n
                                c[1] += 1
                records_of[place[field, None]] += filled
                if len(light) > light_table:
                    yield part(list(light), [c[0] for c in light.values()], [c[1] for c in light.values()], False)
                    light = {}
        if light:
            yield part(list(light), [c[0] for c in light.values()], [c[1] for c in light.values()], False)
        at = np.nonzero(records_of)[0]
        yield part([names[i] for i in at], occurrences[at].tolist(), records_of[at].tolist(), True)

    counted = records.mapInPandas(count, "field_name string, term string, occurrences bigint, records bigint, heavy boolean")
    # One exchange serves both tables, a heavy term being one row per task in it.  Whether a term
    # is heavy is asked after the sums, so that nothing is pushed below the exchange and the texts are read once.
    met = counted.repartition("field_name", "term")

    def table(of_kind: Column) -> DataFrame:
        sums = [F.sum(F.when(of_kind, F.col(c))).alias(c) for c in ("occurrences", "records")]
        return met.groupBy("field_name", "term").agg(*sums, F.bool_or(F.col("term").isNull()).alias("total")).filter("records IS NOT NULL")

    return table(F.col("heavy")).unionByName(table(~F.col("heavy")))


def marked(counts: DataFrame, min_records: int = 3, max_share: float = 0.3) -> DataFrame:
    """The terms with their mark; the totals are one row per field and joined by broadcast."""
    totals = counts.groupBy("field_name").agg(F.max(F.when(F.col("total"), F.col("records"))).alias("filled"))
    share = F.col("records") > F.lit(max_share) * F.col("filled")
    mark = F.when(F.col("records") < min_records, "rare").when(share, "common")
    return counts.filter("NOT total").join(F.broadcast(totals), "field_name").select("field_name", "term", "occurrences", "records", mark.alias("mark"))
