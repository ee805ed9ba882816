"""Filters of proper-name candidates: trivial, ambiguous and suspicious aliases, and close but different names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Head words of organisations, prefixes of legal references, words without content.
HEADS = (
    "administration agency association authority bank board bureau college commission committee company corporation "
    "council department foundation institute ministry office school union university"
).split()
SCHOOLS = ("university", "college", "institute", "school")
LEGAL_PREFIX = r"(?i)^(section|subsection|paragraph|title|chapter|article|clause|part|funds?\s+of)\b"
STOPS = "the of and for in to a an on at by".split()
# Roles and the patterns that show them.
ROLES = {
    "university": r"\b(university|college|school|institute|campus)\b",
    "police_law_enforcement": r"\b(police|sheriff|patrol|marshal|marshals|fbi|dea|atf|secret service|customs|border protection|law enforcement|public safety)\b",
    "health_agency": r"\b(health|medical|medicare|medicaid|disease|hospital|clinic|public health|human services)\b",
    "department_agency": r"\b(department|agency|administration|bureau|office|ministry|authority|commission)\b",
    "committee": r"\b(committee|subcommittee|caucus)\b",
    "court_judiciary": r"\b(court|judiciary|judicial|justice|attorney|prosecutor)\b",
    "financial": r"\b(bank|banking|finance|financial|mortgage|reserve|treasury|securities|credit)\b",
    "sports_event": r"\b(cup|league|championship|grand prix|open|tournament|football|basketball|athletic|olympic|games)\b",
    "law_act": r"\b(act|code|statute|law|amendment|constitution|title|public law|u\.s\.c|usc)\b",
    "nonprofit_association": r"\b(association|foundation|society|council|union)\b",
}
BROAD = ("department_agency", "nonprofit_association")
CLOSE = 0.35


def _set(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal(x: Column) -> Column:
    return F.lower(T.normalize_space(x))


def trivial(a: Column, b: Column) -> Column:
    """The same name in another spelling of spaces, case, signs or articles."""
    return (literal(a) == literal(b)) | (T.compact(a) == T.compact(b)) | (T.article_free(a) == T.article_free(b))


def content_tokens(x: Column) -> Column:
    """Distinct words of two letters or more that carry content."""
    found = F.regexp_extract_all(F.replace(literal(x), F.lit("u.s."), F.lit("us")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOPS)))


def overlap(a: Column, b: Column) -> Column:
    x, y = content_tokens(a), content_tokens(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def roles(x: Column) -> Column:
    """The roles that a name shows, in the order of the table; other without any."""
    low = literal(x)
    found = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in ROLES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(_set(["other"]))


def negative_score(a: Column, b: Column, kind: Column) -> Column:
    """How close two names are in words and roles; laws only among themselves."""
    shared = overlap(a, b)
    ra, rb = roles(a), roles(b)
    both = F.array_intersect(ra, rb)
    specific = F.size(F.array_except(both, _set([*BROAD, "other"]))) > 0
    broad = (F.size(both) > 0) & ~F.array_contains(both, "other")
    other = _set(["other"])
    score = (
        shared + F.when(specific, 0.45).when(broad, 0.18).otherwise(0.0)
        - F.when(kind.eqNullSafe("ORG") & (F.size(F.array_except(both, _set(["department_agency"]))) == 0), 0.2).otherwise(0.0)
        - F.when((ra == other) & (rb == other) & (shared < 0.18), 0.2).otherwise(0.0)
    )
    law = F.array_contains(ra, "law_act") & F.array_contains(rb, "law_act")
    return F.when(kind.eqNullSafe("LAW"), F.when(law, shared + F.when(shared >= 0.1, 0.55).otherwise(-0.2)).otherwise(-0.5)).otherwise(score)


def _words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[A-Za-zА-Яа-я0-9]+"), F.lit(0))


def acronym(x: Column) -> Column:
    letters = F.regexp_replace(x, "[^A-Za-z]", "")
    return F.length(letters).between(2, 12) & (F.upper(letters) == letters)


def heads(x: Column) -> Column:
    return F.array_intersect(F.array_distinct(F.transform(_words(x), lambda w: F.lower(w))), _set(HEADS))


def alias_verdict(a: Column, b: Column, kind: Column, relation: Column) -> Column:
    """Why an alias is not taken: trivial, ambiguous_person or suspicious; good otherwise.

    A single word names no person surely. Abbreviations and acronyms are never suspicious; legal references are, and
    organisations whose head words differ, and a single word for a school.
    """
    ha, hb = heads(a), heads(b)
    one = F.size(_words(b)) == 1
    organisation = kind.isin("ORG", "FAC") & (
        ((F.size(ha) > 0) & (F.size(hb) > 0) & ~F.arrays_overlap(ha, hb)) | (F.arrays_overlap(ha, _set(SCHOOLS)) & one & (F.size(hb) == 0))
    )
    short = F.coalesce(relation.isin("abbreviation", "acronym"), F.lit(False)) | acronym(b)
    return (
        F.when(trivial(a, b), "trivial")
        .when(kind.eqNullSafe("PERSON") & (F.size(_words(a)) <= 1), "ambiguous_person")
        .when(~short & (literal(b).rlike(LEGAL_PREFIX) | F.coalesce(organisation, F.lit(False))), "suspicious")
        .otherwise("good")
    )


def same_entity_surface(a: Column, b: Column, kind: Column) -> Column:
    """The names may be of one entity: words of one within the other (persons), or one within the other and half of the words shared."""
    x, y = (F.array_distinct(F.transform(_words(c), lambda w: F.lower(w))) for c in (a, b))
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    p, q = T.article_free(a), T.article_free(b)
    contained = (p != "") & (q != "") & (F.contains(p, q) | F.contains(q, p)) & (overlap(a, b) >= 0.5)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((kind.eqNullSafe("PERSON") & within) | contained)


def hard_negative(a: Column, b: Column, kind: Column) -> Column:
    """Close enough to be hard, and surely another entity."""
    return ~trivial(a, b) & (negative_score(a, b, kind) >= CLOSE) & ~same_entity_surface(a, b, kind)
