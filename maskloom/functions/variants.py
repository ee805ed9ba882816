"""Changed and equivalent ways to write numbers, dates, shares and amounts, by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import with_commas
from .text import normalize_space

# Patterns of a signed number, and of one whose commas stand between digits.
SIGNED = r"[-+]?\d[\d,]*(?:\.\d+)?"
GROUPED = r"[-+]?\d(?:[\d,]*\d)?(?:\.\d+)?"
# Month names before a day.
MONTH_DAY = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+"
# Number words and their neighbours.
NEIGHBOURS = {
    "zero": "one", "one": "two", "two": "three", "three": "four", "four": "five", "five": "six", "six": "seven", "seven": "eight",
    "eight": "nine", "nine": "ten", "ten": "eleven", "eleven": "twelve", "twelve": "thirteen", "thirteen": "fourteen", "fourteen": "fifteen",
    "fifteen": "sixteen", "sixteen": "seventeen", "seventeen": "eighteen", "eighteen": "nineteen", "nineteen": "twenty", "twenty": "thirty",
    "thirty": "forty", "forty": "fifty", "fifty": "sixty", "sixty": "seventy", "seventy": "eighty", "eighty": "ninety", "ninety": "one hundred",
    "hundred": "thousand", "thousand": "million", "million": "billion",
}
# Currencies that stand for one another, symbols and the words for them, month abbreviations.
SWAPS = {"$": "€", "€": "$", "£": "$"}
MORE_SWAPS = {**SWAPS, "percent": "points", "%": " percent"}
CURRENCY_WORDS = {"$": " dollars", "£": " pounds", "€": " euros"}
SHORT_MONTHS = {
    "January": "Jan.", "February": "Feb.", "March": "Mar.", "April": "Apr.", "June": "Jun.", "July": "Jul.",
    "August": "Aug.", "September": "Sept.", "October": "Oct.", "November": "Nov.", "December": "Dec.",
}

_D = "decimal(38,6)"


def _dec(x) -> Column:
    return F.lit(x).cast(_D)


def _replace_once(x: Column, a: str, b: str) -> Column:
    at = F.position(F.lit(a), x)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit(b), F.substring(x, at + len(a), F.length(x))))


def _put(x: Column, raw: Column, text: Column) -> Column:
    at = F.position(raw, x)
    return F.concat(F.substring(x, F.lit(1), at - 1), text, F.substring(x, at + F.length(raw), F.length(x)))


def _whole(v: Column, raw: Column) -> Column:
    digits = v.cast("decimal(38,0)").cast("string")
    grouped = F.when(v < 0, F.concat(F.lit("-"), with_commas(F.regexp_replace(digits, "-", "")))).otherwise(with_commas(digits))
    return F.when(raw.contains(","), grouped).otherwise(digits)


def _distinct(found: list[Column], x: Column) -> Column:
    return F.array_distinct(F.filter(F.array_compact(F.array(*found)), lambda v: v != x))


def perturbed(surface: Column, years: tuple[int, int] = (1900, 2100), swaps: dict[str, str] = SWAPS, every_swap: bool = False) -> Column:
    """Changed values of a surface, in order: its first number moved up and down, then the currency swapped.

    Days after a month move by one within 1 to 28, 0 becomes 1 and 10, years move by one, whole numbers by a tenth, at
    least 1, others by a tenth, at least 1, with two places; commas are kept. ``every_swap`` applies all swaps that fit instead of the first.
    """
    x = normalize_space(surface)
    raw = F.nullif(F.regexp_extract(x, SIGNED, 0), F.lit(""))
    value = F.regexp_replace(raw, ",", "").try_cast(_D)
    point = raw.contains(".")
    integer = value == F.floor(value)
    day = F.rlike(x, F.concat(F.lit(MONTH_DAY), F.lit("\\Q"), raw, F.lit("\\E\\b"))) & integer
    tenth = F.abs(value) * F.lit(0.1).cast("decimal(2,1)")
    step = F.when(point, F.greatest(_dec(1), tenth.cast(_D))).otherwise(F.greatest(_dec(1), F.bround(tenth, 0).cast(_D)))
    pair = (
        F.when(day, F.array(F.greatest(_dec(1), value - 1).cast(_D), F.least(_dec(28), value + 1).cast(_D)))
        .when(value == 0, F.array(_dec(1), _dec(10)))
        .when(value.between(*years) & integer, F.array((value - 1).cast(_D), (value + 1).cast(_D)))
        .otherwise(F.array((value + step).cast(_D), F.greatest(_dec(0), value - step).cast(_D)))
    )

    def written(v: Column) -> Column:
        return _put(x, raw, F.when(~point | (v == F.floor(v)), _whole(v, raw)).otherwise(v.cast("decimal(38,2)").cast("string")))

    moved = [F.when(value.isNotNull(), written(pair[i])) for i in range(2)]
    if every_swap:
        swapped = [_replace_once(x, a, b) for a, b in swaps.items()]
    else:
        swapped = [F.coalesce(*[_replace_once(x, a, b) for a, b in swaps.items()])]
    return _distinct(moved + swapped, x)


def changed(surface: Column, kind: Column) -> Column:
    """Close but different values by type: years and days of dates, percentages and ordinals by one, others by a tenth, number words to their neighbour."""
    x = normalize_space(surface)
    raw = F.nullif(F.regexp_extract(x, GROUPED, 0), F.lit(""))
    value = F.regexp_replace(raw, ",", "").try_cast(_D)
    date, integer = kind.eqNullSafe("DATE"), value == F.floor(value)
    step = F.greatest(_dec(1), F.bround(F.abs(value) * F.lit(0.1).cast("decimal(2,1)"), 2).cast(_D))
    none = _dec(0)
    pair = (
        F.when(date & integer & value.between(1500, 2200), F.array((value - 1).cast(_D), (value + 1).cast(_D)))
        .when(date & integer & value.between(1, 31), F.array(F.greatest(_dec(1), value - 1).cast(_D), F.least(_dec(31), value + 1).cast(_D)))
        .when(kind.isin("PERCENT", "ORDINAL"), F.array(F.greatest(none, value - 1).cast(_D), (value + 1).cast(_D)))
        .when(value == 0, F.array(_dec(1), _dec(2)))
        .otherwise(F.array(F.greatest(none, value - step).cast(_D), (value + step).cast(_D)))
    )
    places = F.length(F.substring_index(raw, ".", -1))

    def written(v: Column) -> Column:
        text = F.when(raw.contains(".") & (places == 1), v.cast("decimal(38,1)").cast("string"))
        for k in (2, 3, 4):
            text = text.when(raw.contains(".") & (places == k), v.cast(f"decimal(38,{k})").cast("string"))
        text = text.when(raw.contains("."), v.cast("string")).otherwise(_whole(F.bround(v, 0), raw))
        return _put(x, raw, text)

    moved = [F.when(value.isNotNull(), written(pair[i])) for i in range(2)]
    word = None
    for a, b in NEIGHBOURS.items():
        hit, put = F.lower(x).rlike(rf"\b{a}\b"), F.regexp_replace(x, rf"(?i)^(.*?)\b{a}\b", f"$1{b}")
        word = F.when(hit, put) if word is None else word.when(hit, put)
    money = [F.when(kind.eqNullSafe("MONEY"), _replace_once(x, a, b)) for a, b in SWAPS.items()]
    return _distinct([*moved, F.when(value.isNull(), word), *money], x)


def equivalents(surface: Column, kind: Column) -> Column:
    """Other ways to write the same value, by type: without commas or ``.0``, percent signs and words, currency words, month abbreviations."""
    x = normalize_space(surface)
    percent, money, date = (kind.eqNullSafe(k) for k in ("PERCENT", "MONEY", "DATE"))
    sign = x.contains("%")
    low = F.lower(x)
    found = [
        F.when(x.rlike(r"\d,\d"), F.regexp_replace(x, r"(?<=\d),(?=\d)", "")),
        F.when(x.rlike(r"\b\d+\.0\b"), F.regexp_replace(x, r"\b(\d+)\.0\b", "$1")),
        F.when(percent & sign, F.replace(x, F.lit("%"), F.lit(" percent"))),
        F.when(percent & sign, F.replace(x, F.lit("%"), F.lit(" per cent")))
        .when(percent & low.rlike(r"\bpercent\b"), F.regexp_replace(x, r"(?i)\s*percent\b", "%"))
        .when(percent & low.rlike(r"\bper cent\b"), F.regexp_replace(x, r"(?i)\s*per cent\b", "%")),
    ]
    for symbol, word in CURRENCY_WORDS.items():
        found.append(F.when(money & x.contains(symbol), F.concat(F.trim(_replace_once(x, symbol, "")), F.lit(word))))
    for full, short in SHORT_MONTHS.items():
        stem = short.rstrip(".")
        found.append(
            F.when(date & low.rlike(rf"\b{full.lower()}\b"), F.regexp_replace(x, rf"(?i)^(.*?)\b{full}\b", f"$1{short}"))
            .when(date & low.rlike(rf"\b{stem.lower()}"), F.regexp_replace(x, rf"(?i)^(.*?)\b{stem}\.?", f"$1{full}"))
        )
    return _distinct([normalize_space(c) for c in found], x)
