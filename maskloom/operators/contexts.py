"""Contexts of pairs: which mention is meant, restored on both sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def _mask_places(left: Column) -> Column:
    n = T.count_masks(left)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def materialized(left: Column, right: Column, entity: Column, candidate: Column, mask_idx: Column) -> Column:
    """Struct ``left, right, how``: the entity restored on the left side, without mistaking another occurrence for it.

    In this order: the mask whose filling by the candidate gives the right side (``mask_diff:n``); the stated mask
    (``mask_idx_fallback:n``); the occurrence of the candidate on the right whose replacement by the entity gives the left
    side (``candidate_diff``), and the other way round (``entity_diff``); the first occurrence of the candidate, whatever its
    case (``candidate_reverse_replace``); ``unresolved``. A null side counts as empty.
    """
    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    entity, candidate = F.coalesce(entity, F.lit("")), F.coalesce(candidate, F.lit(""))
    want = T.folded_space(right)
    fitting = F.get(F.filter(_mask_places(left), lambda i: T.folded_space(T.replace_nth_mask(left, i, candidate)) == want), F.lit(0))
    stated = F.when((mask_idx >= 0) & (mask_idx < T.count_masks(left)), mask_idx.cast("int"))
    masked = (T.count_masks(left) > 0) & (candidate != "")
    both = (entity != "") & (candidate != "")
    by_candidate = T.matching_occurrence(right, candidate, entity, left)
    by_entity = T.matching_occurrence(left, entity, candidate, right)
    reverse = F.when(F.position(F.lower(candidate), F.lower(right)) > 0, T.replace_first(right, candidate, entity))

    def out(a: Column, b: Column, how: Column) -> Column:
        return F.struct(a.alias("left"), b.alias("right"), how.alias("how"))

    return (
        F.when(masked & fitting.isNotNull(), out(T.replace_nth_mask(left, fitting, entity), right, F.concat(F.lit("mask_diff:"), fitting.cast("string"))))
        .when(masked & stated.isNotNull(), out(T.replace_nth_mask(left, stated, entity), right, F.concat(F.lit("mask_idx_fallback:"), stated.cast("string"))))
        .when(both & by_candidate.isNotNull(), out(by_candidate, right, F.lit("candidate_diff")))
        .when(both & by_entity.isNotNull(), out(left, by_entity, F.lit("entity_diff")))
        .when(both & reverse.isNotNull(), out(reverse, right, F.lit("candidate_reverse_replace")))
        .otherwise(out(left, right, F.lit("unresolved")))
    )


def target_marked(masked: Column, values: Column, target: Column, marker: str = "[TARGET]") -> Column:
    """The masks filled from a map of mask number to value, but the target's replaced by a marker."""
    return T.fill_masks(masked, F.map_from_entries(F.transform(F.map_entries(values), lambda x: F.struct(x["key"], F.when(x["key"] == target, F.lit(marker)).otherwise(x["value"])))))


def pair_budget(left: Column, right: Column, entity: Column, candidate: Column, budget: int) -> Column:
    """Struct ``left, right``: half of the words for the left side, what it leaves for the right, each around its marked span."""
    def rest(one: Column) -> Column:
        used = F.size(F.split(F.trim(one), r"\s+"))
        return F.struct(one.alias("left"), T.token_budget(right, candidate, F.lit(budget) - used).alias("right"))

    return T.let(T.token_budget(left, entity, F.lit(budget // 2)), rest)


# The question of the entity view.
QUESTION = "Question: does replacing the original entity with the candidate preserve the factual meaning?"


def views(left: Column, right: Column, entity: Column, candidate: Column) -> Column:
    """Array of structs ``mode, first, second``: the four ways in which a pair is shown to a model.

    Both sides as they are; both with their name between tags; the left side and a question about the two names; the left side
    with its name masked and the two names.
    """
    names = F.concat(F.lit("Original entity: "), F.coalesce(entity, F.lit("")), F.lit("\nCandidate entity: "), F.coalesce(candidate, F.lit("")))

    def one(mode: str, first: Column, second: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), first.alias("first"), second.alias("second"))

    return F.array(
        one("pair", left, right), one("marked_pair", T.tagged_first(left, entity, "[E1]", "[/E1]"), T.tagged_first(right, candidate, "[E2]", "[/E2]")),
        one("entity_query", left, F.concat(names, F.lit("\n" + QUESTION))), one("masked_query", T.replace_first(left, entity, F.lit("[TGT]")), names),
    )
