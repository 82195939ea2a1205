"""Proper spellings of the keys that sources write in more than one way.

All functions are built-in column expressions; null, blank or unknown input
gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the four report types.
REPORT_TYPES = {
    "Q1": ("Q1", "1Q", "1분기"),
    "H1": ("H1", "HY", "반기", "2분기", "2Q"),
    "Q3": ("Q3", "3Q", "3분기"),
    "FY": ("FY", "ANNUAL", "사업", "연간", "4분기", "4Q"),
}

# Spellings of the two bases.
BASES = {"CFS": ("CFS", "연결"), "OFS": ("OFS", "별도", "개별")}

#: White space in the sense of every comparison here, Unicode included.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"
SPACES = "\t\n\x0b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def spaceless(value: Column) -> Column:
    """Text without white space, character by character: several times as fast as a pattern."""
    return F.translate(value, SPACES, "")


def one_of(value: Column, spellings: dict[str, tuple[str, ...]]) -> Column:
    """The proper form of a value by a literal map, so the value is folded once."""
    proper = F.create_map(*[F.lit(x) for form, words in spellings.items() for word in words for x in (word, form)])
    return F.try_element_at(proper, F.upper(spaceless(value)))


def report_type(value: Column) -> Column:
    return one_of(value, REPORT_TYPES)


def basis(value: Column) -> Column:
    return one_of(value, BASES)


def corp_code(value: Column) -> Column:
    """Eight digits with leading zeros; null if it is no number of at most eight digits."""
    digits = spaceless(value)
    return F.when(digits.rlike("^[0-9]{1,8}$"), F.lpad(digits, 8, "0"))


def code_letters(value: Column) -> Column:
    """Letters and digits of a code in upper case: what its spellings have in common."""
    return F.nullif(F.upper(F.regexp_replace(value, r"[^A-Za-z0-9]", "")), F.lit(""))


def receipt_digits(value: Column) -> Column:
    """The digits of a receipt number; null where there is no digit other than 0."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return F.when(digits.rlike("[1-9]"), digits)


def folded(value: Column) -> Column:
    """Text without white space in lower case, for comparisons that ignore both."""
    return F.lower(spaceless(value.cast("string")))
