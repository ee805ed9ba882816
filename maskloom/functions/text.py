"""Text functions as column expressions; nothing here leaves the JVM except ``nfkc_casefold``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MASK = r"(?i)[<\[](?:ent_)?mask[>\]]"
_SPACE = r"[\s ]+"
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def normalize_space(x: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def norm_key(x: Column) -> Column:
    """Inventory key: lower case, only letters, digits, _ and % $ £ €."""
    return F.regexp_replace(F.lower(normalize_space(x)), r"[^\p{L}\p{N}_%$£€]+", "")


def compact(x: Column) -> Column:
    """Lower case, only letters, digits and _."""
    return F.regexp_replace(F.lower(x), _NOT_WORD, "")


def article_free(x: Column) -> Column:
    """Identity key: & as and, no leading article, no possessive, only a-z and 0-9."""
    low = F.regexp_replace(F.lower(normalize_space(x)), "&", " and ")
    low = F.regexp_replace(low, r"^\s*(the|an|a)\s+", "")
    return F.regexp_replace(F.regexp_replace(low, r"['’]s?\s*$", ""), "[^a-z0-9]+", "")


def nfkc_casefold(x: Column) -> Column:
    """Compatibility normal form and full case folding, which Spark lacks."""

    def fold(batch: pd.Series) -> pd.Series:
        return batch.str.normalize("NFKC").str.casefold()

    return F.pandas_udf(fold, StringType())(x)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def count_masks(x: Column) -> Column:
    return F.regexp_count(x, F.lit(MASK))


def masks(x: Column) -> Column:
    """The mask tokens as written, in order."""
    return F.regexp_extract_all(x, F.lit(MASK), F.lit(0))


def replace_nth_mask(x: Column, n: Column, value: Column) -> Column:
    """The n-th mask (from 0) replaced, the others left as written; the text itself if there is no such mask."""
    parts, found = F.split(x, MASK, -1), masks(x)
    filled = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.when(i == n, value), F.get(found, i), F.lit(""))))
    return F.when(n < F.size(found), F.array_join(filled, "")).otherwise(x)


def fill_masks(x: Column, values: Column) -> Column:
    """Every mask filled from a map of mask number to value; masks without a value stay."""
    parts, found = F.split(x, MASK, -1), masks(x)
    filled = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.when(i < F.size(found), F.try_element_at(values, i.cast("long"))), F.get(found, i), F.lit(""))))
    return F.array_join(filled, "")


def crop(x: Column, needle: Column, window: int) -> Column:
    """``window`` characters on both sides of the first occurrence, case-insensitive; else the first 2 * window."""
    at = F.position(F.lower(needle), F.lower(x))
    begin = F.greatest(F.lit(1), at - window)
    return F.when(at > 0, F.trim(F.substring(x, begin, at + F.length(needle) + window - begin))).otherwise(F.trim(F.substring(x, F.lit(1), F.lit(2 * window))))


def window_words(x: Column, k: int) -> Column:
    """Up to ``k`` words before and after the first mask, joined by the mask."""
    parts = F.split(x, MASK, 2)
    words = F.lit(r"[\p{L}\p{N}]+")
    left, right = F.regexp_extract_all(parts[0], words, F.lit(0)), F.regexp_extract_all(F.get(parts, F.lit(1)), words, F.lit(0))
    tail = F.when(F.size(left) > k, F.slice(left, -k, k)).otherwise(left)
    return F.when(F.size(parts) > 1, F.concat_ws(" ", F.array_join(tail, " "), F.lit("[X]"), F.array_join(F.slice(right, 1, k), " ")))


def stable_id(length: int, *parts: Column) -> Column:
    """Prefix of the SHA-1 of the parts joined by the unit separator; null is written None."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary")), 1, length)


def surface_variants(x: Column) -> Column:
    """Other ways to write a surface: without dots in initialisms, Jr./Sr. without dot, without commas; in order, distinct."""
    tried = [
        F.when(x.rlike(r"^([A-Za-z]\.){2,}$"), F.regexp_replace(x, r"\.", "")),
        F.when(x.rlike(r"\b(Jr|Sr)\."), F.regexp_replace(x, r"\b(Jr|Sr)\.", "$1")),
        F.when(x.rlike(r"\bProp\. \d"), F.regexp_replace(x, r"\bProp\. ", "Prop ")),
        F.when(x.contains(",") & ~x.contains("."), F.regexp_replace(x, ",", "")),
    ]
    return F.array_distinct(F.filter(F.array_compact(F.array(*tried)), lambda v: v != x))


def _around(x: Column, needle: Column) -> tuple[Column, Column, Column]:
    """The text before, at and after the first case-insensitive occurrence; the middle is null without one."""
    at = F.position(F.lower(needle), F.lower(x))
    found = F.when((at > 0) & (F.length(needle) > 0), F.substring(x, at, F.length(needle)))
    return F.substring(x, F.lit(1), at - 1), found, F.substring(x, at + F.length(needle), F.length(x))


def replace_first(x: Column, needle: Column, value: Column) -> Column:
    """The first occurrence replaced, case-insensitively; the text itself without one."""
    before, found, after = _around(x, needle)
    return F.when(found.isNotNull(), F.concat(before, value, after)).otherwise(x)


def mark_first(x: Column, needle: Column) -> Column:
    """The first occurrence in brackets."""
    before, found, after = _around(x, needle)
    return F.when(found.isNotNull(), F.concat(before, F.lit("["), found, F.lit("]"), after)).otherwise(x)


def tagged_first(x: Column, needle: Column, start: str, end: str) -> Column:
    """The first occurrence between two tags; the text itself without one."""
    before, found, after = _around(x, needle)
    return F.when(found.isNotNull(), F.concat(before, F.lit(start + " "), found, F.lit(" " + end), after)).otherwise(x)


def replace_nth(x: Column, needle: Column, n: Column, value: Column) -> Column:
    """The n-th exact occurrence (from 0) replaced; null if there are fewer."""
    parts = F.split(x, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i == n, value).when(i < F.size(parts) - 1, needle).otherwise(""))), "")
    return F.when((n >= 0) & (n < F.size(parts) - 1), joined)


def differing_span(a: Column, b: Column) -> Column:
    """Struct ``left, right``: what remains of two texts without their common prefix and suffix; linear in their length."""
    n = F.least(F.length(a), F.length(b))

    def agreeing(x: Column, y: Column, most: Column) -> Column:
        """How many letters at the beginning are the same, at most ``most``."""
        same = F.zip_with(F.slice(F.split(x, ""), F.lit(1), most), F.slice(F.split(y, ""), F.lit(1), most), lambda p, q: p == q)
        at = F.array_position(same, F.lit(False))
        return F.when(at > 0, (at - 1).cast("int")).otherwise(most)

    prefix = agreeing(a, b, n)
    suffix = agreeing(F.reverse(a), F.reverse(b), n - prefix)
    return F.struct(F.substring(a, prefix + 1, F.length(a) - prefix - suffix).alias("left"), F.substring(b, prefix + 1, F.length(b) - prefix - suffix).alias("right"))


def folded_space(x: Column) -> Column:
    """Lower case, runs of white space to one space: by which model inputs are compared."""
    return F.lower(normalize_space(x))


def matching_occurrence(x: Column, needle: Column, value: Column, target: Column) -> Column:
    """The first exact occurrence replaced with which the text becomes ``target`` but for case and spaces; null if none does."""
    parts = F.split(x, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    want = folded_space(target)

    def filled(i: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.when(k == i, value).when(k < F.size(parts) - 1, needle).otherwise(""))), "")

    tried = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.size(parts) - 2)).otherwise(F.array().cast("array<int>")), filled)
    found = F.get(F.filter(tried, lambda t: folded_space(t) == want), F.lit(0))
    return F.when(needle != "", found)


def window_around(x: Column, needle: Column, size: Column) -> Column:
    """``size`` characters with the first occurrence of ``needle`` in the middle; the beginning without one."""
    at = F.position(F.lower(needle), F.lower(x))
    begin = F.greatest(F.lit(1), F.least(at + F.floor(F.length(needle) / 2).cast("int") - F.floor(size / 2).cast("int"), F.length(x) - size + 1))
    return F.when(at > 0, F.substring(x, begin, size)).otherwise(F.substring(x, F.lit(1), size))


def crop_span(x: Column, begin: Column, end: Column, window: int) -> Column:
    """Struct ``text, begin, end``: the span (from 0, end exclusive) with ``window`` characters on both sides, and where it lies there."""
    low = F.greatest(F.lit(0), begin - window)
    return F.struct(F.substring(x, low + 1, end + window - low).alias("text"), (begin - low).alias("begin"), (end - low).alias("end"))


def clip(x: Column, most: int) -> Column:
    """At most ``most`` characters."""
    return F.substring(x, F.lit(1), F.lit(most))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_budget(x: Column, needle: Column, budget: Column) -> Column:
    """The words around the bracketed ``needle``, at most ``budget`` in all with the span; the first words if it does not fit or is not there."""

    def words_of(c: Column) -> Column:
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    before, found, after = _around(x, needle)
    span = F.when(found.isNotNull(), words_of(F.concat(F.lit("["), found, F.lit("]"))))
    parts = F.struct(words_of(before).alias("left"), span.alias("span"), words_of(after).alias("right"), budget.alias("budget"))

    def chosen(p: Column) -> Column:
        room = p["budget"] - F.size(p["span"])
        head = F.least(F.size(p["left"]), F.greatest(F.floor(room / 2).cast("int"), room - F.size(p["right"])))
        tail = F.when(head > 0, F.slice(p["left"], F.size(p["left"]) - head + 1, head)).otherwise(F.array().cast("array<string>"))
        return F.when(p["span"].isNotNull() & (room >= 0), F.concat(tail, p["span"], F.slice(p["right"], F.lit(1), F.least(F.size(p["right"]), room - head))))

    return let(parts, lambda p: F.array_join(F.coalesce(chosen(p), F.slice(words_of(x), F.lit(1), p["budget"])), " "))
