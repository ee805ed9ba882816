"""Variants of numbers in surfaces, as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MONTHS

# Fixed value: the pattern of a number.
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def first_number(x: Column) -> Column:
    """The first number as written, null without one."""
    return F.nullif(F.regexp_extract(x, NUMBER, 0), F.lit(""))


def number_value(x: Column) -> Column:
    return F.regexp_replace(first_number(x), ",", "").try_cast("decimal(38,6)")


def signature(x: Column) -> Column:
    """All numbers of a text without their commas, in order."""
    return F.transform(F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, ",", ""))


def with_commas(digits: Column) -> Column:
    """A string of digits in groups of three."""
    return F.reverse(F.regexp_replace(F.reverse(digits), r"(\d{3})(?=\d)", "$1,"))


def swapped_currency(x: Column) -> Column:
    """The same amount in another currency: a changed value."""
    return F.when(x.contains("$"), F.replace(x, F.lit("$"), F.lit("€"))).when(x.contains("€"), F.replace(x, F.lit("€"), F.lit("$"))).when(x.contains("£"), F.replace(x, F.lit("£"), F.lit("$")))


def next_month(x: Column) -> Column:
    """The first month name, in the order of the calendar, replaced by the next one; null without a month."""
    out = None
    for i, month in enumerate(MONTHS):
        hit, put = F.contains(F.lower(x), F.lit(month)), MONTHS[(i + 1) % 12].capitalize()
        changed = F.regexp_replace(x, f"(?i){month}", put)
        out = F.when(hit, changed) if out is None else out.when(hit, changed)
    return out
