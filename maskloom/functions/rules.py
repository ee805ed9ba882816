"""Rule tables: types, groups, domains, labels and relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of corpus paths and their domain, first match first.
DOMAINS = {
    "billsum": "legal", "samsum": "dialogue", "multi_news": "multi_news", "cnn_dailymail": "news",
    "mars_test_200": "news", "xsum": "news_short",
}
# Month names.
MONTHS = "january february march april may june july august september october november december".split()


def domain_of(path: Column) -> Column:
    out = None
    for part, domain in DOMAINS.items():
        hit = path.contains(part)
        out = F.when(hit, domain) if out is None else out.when(hit, domain)
    return out.otherwise("unknown")


# Types and the patterns of lower-case surfaces that show them, first match first.
TYPE_PATTERNS = (
    ("MONEY", r"[$£€]\s*\d|\b(dollars?|euros?|pounds?)\b"),
    ("PERCENT", r"%|\bpercent\b"),
    ("DATE", r"\b(19|20)\d{2}\b"),
    ("DATE", "january|february|march|april|may|june|july|august|september|october|november|december"),
    ("DATE", r"^(today|yesterday|tomorrow|tonight|last month|next month)$"),
    ("CARDINAL", r"^[\d,.\s]+$"),
)


def inferred_type(surface: Column, given: Column | None = None) -> Column:
    """The given type unless it is null or UNKNOWN, else the first that the writing shows, else the given one or UNTYPED."""
    low = F.lower(surface)
    shown = F.coalesce(*[F.when(low.rlike(pattern), kind) for kind, pattern in TYPE_PATTERNS])
    if given is None:
        return F.coalesce(shown, F.lit("UNTYPED"))
    return F.coalesce(F.nullif(given, F.lit("UNKNOWN")), shown, given, F.lit("UNTYPED"))


def surface_group(surface: Column) -> Column:
    """numeric, junk, upper, capitalized, multiword or lower, by the writing."""
    return (
        F.when(surface.rlike(r"\d"), "numeric")
        .when(~surface.rlike(r"\p{L}"), "junk")
        .when((F.upper(surface) == surface) & (F.length(surface) > 1), "upper")
        .when(surface.rlike(r"(^| )\p{Lu}"), "capitalized")
        .when(surface.contains(" "), "multiword")
        .otherwise("lower")
    )


def vote(label: Column) -> Column:
    """preserved, changed, uncertain; missing for anything else."""
    word = F.regexp_replace(F.lower(label), "[^a-z]", "")
    return (
        F.when(word.startswith("preserv"), "preserved").when(word.startswith("change"), "changed")
        .when(word.startswith("uncertain") | word.startswith("unsure"), "uncertain").otherwise("missing")
    )


def band(score: Column, low: float = 0.1, high: float = 0.9) -> Column:
    """Score to label; between the bounds, and for null, uncertain."""
    return F.when(score >= high, "preserved").when(score <= low, "changed").otherwise("uncertain")


def relation(a_to_b: Column, b_to_a: Column) -> Column:
    """The relation that two directions amount to."""
    unsure = (a_to_b == "uncertain") | (b_to_a == "uncertain") | a_to_b.isNull() | b_to_a.isNull()
    return (
        F.when(unsure, "uncertain")
        .when((a_to_b == "contradiction") | (b_to_a == "contradiction"), "contradiction")
        .when((a_to_b == "entailment") & (b_to_a == "entailment"), "equivalence")
        .when(a_to_b == "entailment", "generalization")
        .when(b_to_a == "entailment", "specialization")
        .otherwise("substitution")
    )
