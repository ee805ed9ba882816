"""Validation, flags, duplicates and conflicts of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import text as T
from ..durable import cut
from .judging import known_non_equivalent
from .skew import lookup
from .splitting import hash_ranked

_ALL = "__ALL__"


def same_identity(a: Column, b: Column) -> Column:
    """Equal under one of three normalisations: spaces and case, word characters only, article-free."""
    spaced = F.lower(T.normalize_space(a)) == F.lower(T.normalize_space(b))
    return spaced | (T.compact(a) == T.compact(b)) | ((T.article_free(a) == T.article_free(b)) & (T.article_free(a) != ""))


# Pairs of words that are no equivalents, and the reasons to reject a row.
NOT_EQUIVALENT = (("annual", "biannual"), ("annual", "biennial"), ("biannual", "biennial"))
REASONS = (
    "invalid_schema_or_label", "identity_or_normalized_identity", "identical_model_inputs", "entity_missing_from_left",
    "candidate_missing_from_right", "known_non_equivalent_positive", "numeric_value_changed_positive",
)


def reject_reason(entity: Column, candidate: Column, left: Column, right: Column, label: Column, group: Column) -> Column:
    """The first of REASONS that holds for a row, null for a valid one; numbers are compared in numeric rows that have some on both sides."""
    numbers = [F.array_join(N.signature(c), "|") for c in (entity, candidate)]
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in (entity, candidate, left, right)]
    folded = [F.lower(T.normalize_space(c)) for c in (entity, candidate, left, right)]
    conditions = (
        blank[0] | blank[1] | blank[2] | blank[3] | ~F.coalesce(label.isin("preserved", "changed"), F.lit(False)), same_identity(entity, candidate), folded[2] == folded[3],
        ~F.contains(folded[2], folded[0]), ~F.contains(folded[3], folded[1]), (label == "preserved") & known_non_equivalent(entity, candidate, NOT_EQUIVALENT),
        (label == "preserved") & group.eqNullSafe("numeric") & (numbers[0] != "") & (numbers[1] != "") & (numbers[0] != numbers[1]),
    )
    out = None
    for condition, reason in zip(conditions, REASONS):
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def flags(entity: Column, candidate: Column, left: Column, right: Column) -> Column:
    """All flags of a row whose sides are materialised, in a fixed order."""
    folded = [F.lower(T.normalize_space(c)) for c in (left, right)]
    numbers = [F.array_join(N.signature(c), "|") for c in (entity, candidate)]
    same_value = (numbers[0] == numbers[1]) & (numbers[0] != "")
    return F.array_compact(F.array(
        F.when((F.coalesce(F.trim(entity), F.lit("")) == "") | (F.coalesce(F.trim(candidate), F.lit("")) == ""), "missing_required_field"),
        F.when(same_identity(entity, candidate), "identity_candidate"),
        F.when(same_value, "numeric_same_value_format"),
        F.when(folded[0] == folded[1], "identical_model_inputs"),
        F.when(left.isNull(), "target_location_unresolved"),
        F.when(left.isNotNull() & ~F.contains(F.lower(left), F.lower(entity)), "entity_missing_after_materialization"),
        F.when(right.isNotNull() & ~F.contains(F.lower(right), F.lower(candidate)), "candidate_missing_after_materialization"),
    ))


CRITICAL_NOT = ("target_location_unresolved", "numeric_same_value_format")


def critical(found: Column) -> Column:
    """Flags that bar a row."""
    return F.array_except(found, F.array(*[F.lit(x) for x in CRITICAL_NOT]))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows, keys, duplicates``: one row; duplicates are rows beyond the first of each key."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def resolved(rows: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """One row per key: ``status`` kept (with its first row's values) or conflict, and the rows it stands for.

    Labels are compared by their extremes, which partial aggregation combines before the shuffle.
    """
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order))
    per = rows.groupBy(*keys).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count("*").alias("n_rows"), first.alias("_first"))
    status = F.when(F.col("_low") == F.col("_high"), "kept").otherwise("conflict")
    return per.select(*keys, status.alias("status"), "n_rows", "_first.*")


def balance(rows: DataFrame, group: str, label: str, least: int) -> DataFrame:
    """Groups of at least ``least`` rows, and whether they hold both labels."""
    per = rows.where(F.col(label).isin("preserved", "changed")).groupBy(group).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("balanced"))
    return per.where(F.col("n") >= least)


def union_distinct(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all frames, the first per key; earlier frames come first."""
    both = None
    for n, frame in enumerate(frames):
        one = frame.withColumn("_from", F.lit(n))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_from")]
    rank = Window.partitionBy(*keys).orderBy("_from", *rest)
    return both.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "_from")


def surface_relation(a: Column, b: Column) -> Column:
    """identical, subset, overlapping or disjoint by tokens."""
    x, y = F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))
    shared = F.size(F.array_intersect(x, y))
    return (
        F.when((shared == F.size(x)) & (shared == F.size(y)), "identical").when((shared == F.size(x)) | (shared == F.size(y)), "subset")
        .when(shared > 0, "overlapping").otherwise("disjoint")
    )


def same_type_negatives(mentions: DataFrame, entities: DataFrame, seed: str = "13") -> DataFrame:
    """``id, entity_id, candidate``: for each mention another surface of its type, drawn by hash; of all types if its own has none.

    The pool of a type is numbered in the order of a hash, large types in parts; a mention's draw is a number in the pool, so the join
    is one to one whatever the size of the pool, and mentions of a frequent entity draw different numbers. Types number few; their
    sizes are sent to all tasks only after they are counted.
    """
    pool = entities.where("surface IS NOT NULL").select(F.col("id").alias("entity_id"), "surface", F.coalesce("heuristic_type", F.lit(_ALL)).alias("own_type"))
    pool = cut(pool.select("entity_id", "surface", F.explode(F.array_distinct(F.array("own_type", F.lit(_ALL)))).alias("t"), "own_type"), "pool")
    sizes = cut(pool.groupBy("t").agg(F.count("*").alias("n")), "pool-sizes")
    numbered = cut(hash_ranked(pool, ["t"], "entity_id", sizes).select("t", "entity_id", "surface", "own_type", F.col("rank").alias("k")), "numbered")
    # An entity draws from its type if another is there, else from all.
    asked = numbered.join(F.broadcast(sizes), "t").where("n > 1").select("entity_id", F.struct((F.col("t") == _ALL).alias("last"), "t", F.col("k").alias("own"), F.col("n").alias("size")).alias("x"))
    asked = asked.groupBy("entity_id").agg(F.min("x").alias("x")).select("entity_id", "x.t", "x.own", "x.size")
    facts = mentions.select("id", "entity_id").distinct()
    per = facts.groupBy("entity_id").agg(F.count("*").alias("n_mentions"))
    rows = lookup(facts, asked.join(per, "entity_id"), "entity_id", "n_mentions")
    draw = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % (F.col("size") - 1)
    drawn = rows.withColumn("k", F.when(draw >= F.col("own"), draw + 1).otherwise(draw))
    return drawn.join(numbered.select("t", "k", F.col("surface").alias("candidate")), ["t", "k"]).select("id", "entity_id", "candidate")
