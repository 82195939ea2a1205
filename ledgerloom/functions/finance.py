"""Financial column expressions; absence is null and never zero, conflict is null and never a pick."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value where it is a finite number, else null (NaN and infinities included)."""
    d = x.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b in percent where both are finite and b is positive."""
    x, y = finite(a), finite(b)
    return F.when(y > 0, x / y * 100)


def growth(a: Column, b: Column) -> Column:
    """(a - b) / b in percent where both are finite and b is positive."""
    x, y = finite(a), finite(b)
    return F.when(y > 0, (x - y) / y * 100)


def average(a: Column, b: Column) -> Column:
    """The mean of two values, null if either is missing."""
    return (finite(a) + finite(b)) / 2


def unique_or_null(c: Column) -> Column:
    """Aggregate: the value if exactly one distinct non-null value exists, else null.

    Min and max are fixed-width partial aggregates, unlike a distinct count.
    """
    return F.when(F.min(c) == F.max(c), F.min(c))


def conflicting(c: Column) -> Column:
    """Aggregate: whether more than one distinct non-null value exists."""
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean, null if any value or weight is missing or a weight is not positive."""
    bad = finite(value).isNull() | finite(weight).isNull() | ~F.coalesce(weight > 0, F.lit(False))
    return F.when(F.count_if(bad) == 0, F.sum(finite(value) * finite(weight)) / F.sum(finite(weight)))


def entropy_score(count: Column, total: Column, companies: Column) -> Column:
    """Aggregate: normalised entropy (0 to 100) of per-company rates; 0 with at most one company.

    Computed from sums, H = ln R - (sum r ln r) / R, so it needs one pass.
    """
    r = F.when((count > 0) & (total > 0), count / total)
    whole = F.sum(r)
    h = F.ln(whole) - F.sum(r * F.ln(r)) / whole
    score = F.when((companies > 1) & (whole > 0), h / F.ln(companies.cast("double")) * 100).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
