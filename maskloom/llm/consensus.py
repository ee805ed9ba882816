"""Consensus of several annotators by confidence-aware truth discovery.

Truths and weights are found in turn until the distances settle. A pair's truth is the label of least weighted
distance from its votes. A contributor's error variance is the mean distance of its votes from the truths that
all others give, so that nobody confirms themselves; it is divided by what it would be by chance, since agreeing
with a common label is little evidence of care. The upper end of its chi-squared confidence interval
decides: one of the long tail with few votes is trusted less than one with the same errors over many, and
the weight is minus its logarithm, nothing for those no better than chance. The votes of one annotator count
as a contributor for each table and level of stated confidence, since nobody is equally honest about all of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut, release
from ..operators.skew import lookup

LABELS = ("preserved", "changed", "uncertain")
Z = -1.959964  # standard normal quantile of alpha / 2 for alpha = 0.05
PRIOR = 0.05  # added to a contributor's distance, so that no weight is infinite
LEAST = 1e-3  # weight, so that a pair whose contributors are no better than chance still has a label
TIE = 1e-9


def clean_label(raw: Column) -> Column:
    """preserved, changed or uncertain whatever the spelling; null for anything else (no vote)."""
    word = F.regexp_replace(F.lower(raw), "[^a-z]", "")
    return (
        F.when(word.startswith("preserv"), "preserved")
        .when(word.startswith("change"), "changed")
        .when(word.startswith("uncertain") | word.startswith("unsure"), "uncertain")
    )


def votes_of(judgments: DataFrame, directional: DataFrame) -> DataFrame:
    """``pair_id, annotator, source, label, n``: votes of both tables, resent rows counted once.

    Rows with a null pair, annotator or id of the row, or without a vote, have none. A directional row without
    preserves_meaning votes by its two directions: entailment both ways preserves, uncertain stays uncertain,
    anything else changes.
    """
    plain = judgments.select(
        "judgment_id", "pair_id", F.col("annotator_id").alias("annotator"), clean_label(F.col("label")).alias("label"),
        F.lit("label").alias("how"),
    )
    both = (F.lower(F.trim("a_to_b")) == "entailment") & (F.lower(F.trim("b_to_a")) == "entailment")
    unsure = F.lower(F.trim("a_to_b")).eqNullSafe("uncertain") | F.lower(F.trim("b_to_a")).eqNullSafe("uncertain")
    shown = F.when(F.col("a_to_b").isNull() | F.col("b_to_a").isNull(), None).when(unsure, "uncertain").when(both, "preserved").otherwise("changed")
    sure = F.coalesce("confidence", F.lit(-1.0))
    sure = F.when(F.isnan(sure) | (sure < 0), "none").when(sure < 0.5, "low").when(sure < 0.8, "middle").otherwise("high")
    directed = directional.select(
        "judgment_id", "pair_id", F.col("annotator_id").alias("annotator"),
        F.coalesce(clean_label(F.col("preserves_meaning")), shown).alias("label"), F.concat(F.lit("directions-"), sure).alias("how"),
    )
    rows = plain.distinct().unionByName(directed.distinct()).na.drop()
    source = F.concat_ws("|", "annotator", "how")
    return rows.groupBy("pair_id", "annotator", "how", "label").agg(F.count("*").alias("n")).withColumn("source", source)


def _quantile(n: Column) -> Column:
    """The lower chi-squared quantile for n degrees of freedom (Wilson and Hilferty's approximation)."""
    return n * F.pow(F.greatest(F.lit(0.0), 1 - 2 / (9 * n) + Z * F.sqrt(2 / (9 * n))), 3)


def _of_vote(columns: dict[str, Column]) -> Column:
    """The one of three columns that belongs to a row's label."""
    return F.when(F.col("label") == LABELS[0], columns[LABELS[0]]).when(F.col("label") == LABELS[1], columns[LABELS[1]]).otherwise(columns[LABELS[2]])


def sums_of(votes: DataFrame) -> DataFrame:
    """``pair_id`` and the sum of the weights of its votes for each label; votes have a ``weight``."""
    return votes.groupBy("pair_id").agg(*[F.sum(F.when(F.col("label") == x, F.col("weight") * F.col("n")).otherwise(0.0)).alias(x) for x in LABELS])


def by_chance(sums: DataFrame) -> dict[str, float]:
    """The distance a vote for each label would have from truths drawn as they are spread."""
    top = F.greatest(*LABELS)
    ties = sum((F.col(x) == top).cast("int") for x in LABELS)
    row = sums.agg(*[F.avg((F.col(x) == top).cast("int") / ties).alias(x) for x in LABELS]).first()
    return {x: max(1e-3, 1 - (row[x] or 0.0)) for x in LABELS}


def weights(votes: DataFrame, sums: DataFrame, chance: dict[str, float]) -> DataFrame:
    """``source, n, distance, weight``: per contributor, from the distance of its votes to what the others say.

    Votes on pairs that nobody else voted on say nothing about the contributor.
    """
    others = {x: F.greatest(F.lit(0.0), F.col(x) - F.when(F.col("label") == x, F.col("weight") * F.col("n")).otherwise(0.0)) for x in LABELS}
    rows = votes.join(sums, "pair_id").select("source", "label", "n", *[c.alias(x) for x, c in others.items()])
    top = F.greatest(*LABELS)
    least = {x: (F.col(x) >= top - TIE).cast("int") for x in LABELS}
    ties = sum(least.values())
    told = F.when(top > TIE, F.col("n")).otherwise(0)
    distance = (1 - _of_vote(least) / ties) / _of_vote({x: F.lit(chance[x]) for x in LABELS})
    found = rows.groupBy("source").agg(F.sum("n").alias("n"), F.sum(told).cast("double").alias("k"), F.sum(told * distance).alias("distance"))
    upper = (F.col("distance") + PRIOR) / F.greatest(_quantile(F.greatest("k", F.lit(1e-3))), F.lit(1e-3))
    return found.select("source", "n", "distance", F.greatest(F.lit(LEAST), -F.log(F.least(F.lit(1.0), upper))).alias("weight"))


def truth_discovery(judgments: DataFrame, directional: DataFrame, settled: float = 1e-3, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """Truths ``pair_id, preserved, changed, uncertain`` (shares of the weight) and the votes they rest on.

    All weigh alike at first. It ends when the sum of all distances changes by less than ``settled`` of itself
    from one round to the next. Nulls in any column, resent and late rows: see ``votes_of``; pairs without a
    vote are absent here; empty tables give empty results.
    """
    votes = cut(votes_of(judgments, directional), "votes")
    total = votes.count()
    weighed_votes, before, weighed = votes.withColumn("weight", F.lit(1.0)), None, None
    for _ in range(max_rounds):
        sums = cut(sums_of(weighed_votes), "truth")
        after = cut(weights(weighed_votes, sums, by_chance(sums)), "weights")
        now = after.agg(F.sum("distance")).first()[0] or 0.0
        for done in (sums, weighed):
            if done is not None:
                release(done)
        weighed = after
        by = weighed.select("source", F.col("n").alias("votes"), "weight")
        weighed_votes = lookup(votes, by, "source", "votes", total)
        if before is not None and abs(now - before) <= settled * max(now, 1e-9):
            break
        before = now
    sums = sums_of(weighed_votes)
    whole = F.greatest(sum(F.col(x) for x in LABELS), F.lit(1e-12))
    return cut(sums.select("pair_id", *[(F.col(x) / whole).alias(x) for x in LABELS]), "truth"), votes


def consensus(judgments: DataFrame, truth: DataFrame) -> DataFrame:
    """``pair_id, label, certainty``: one row per pair of ``judgments``; ties and pairs without votes are uncertain."""
    top = F.greatest(*LABELS)
    ties = sum((F.col(x) == top).cast("int") for x in LABELS)
    label = F.when(ties > 1, "uncertain").when(F.col("preserved") == top, "preserved").when(F.col("changed") == top, "changed").otherwise("uncertain")
    pairs = judgments.select("pair_id").where("pair_id IS NOT NULL").distinct()
    joined = pairs.join(truth, "pair_id", "left")
    return joined.select("pair_id", F.coalesce(label, F.lit("uncertain")).alias("label"), F.round(F.coalesce(top, F.lit(0.0)), 6).alias("certainty"))


def annotators(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """``annotator_id, n_votes, reliability, reliability_lower``: expected share of right votes, and its lower bound.

    The lower bound takes the error at the upper end of its chi-squared interval, and is not below 0.
    """
    joined = votes.join(truth, "pair_id")
    wrong = 1 - _of_vote({x: F.col(x) for x in LABELS})
    found = joined.groupBy("annotator").agg(F.sum(F.col("n") * wrong).alias("err"), F.sum("n").cast("double").alias("n"))
    upper = F.least(F.lit(1.0), (F.col("err") + PRIOR) / F.greatest(_quantile(F.col("n")), F.lit(1e-3)))
    return found.select(
        F.col("annotator").alias("annotator_id"), F.col("n").cast("long").alias("n_votes"),
        F.round(1 - F.col("err") / F.col("n"), 6).alias("reliability"), F.round(1 - upper, 6).alias("reliability_lower"),
    )


def agreement(judgments: DataFrame, directional: DataFrame) -> DataFrame:
    """``n_pairs, n_votes, observed, expected, alpha``: Krippendorff's alpha of all votes, one row.

    Pairs with one vote say nothing about agreement and are left out; without any other the measures are null.
    """
    votes = votes_of(judgments, directional)
    per = votes.groupBy("pair_id").agg(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(x) for x in LABELS])
    m = sum(F.col(x) for x in LABELS)
    several = per.withColumn("m", m).where("m > 1")
    same = sum(F.col(x) * (F.col(x) - 1) for x in LABELS) / (F.col("m") - 1)
    sums = several.agg(F.count("*").alias("n_pairs"), F.sum("m").alias("n_votes"), F.sum(same).alias("same"), *[F.sum(x).alias(x) for x in LABELS])
    n = F.col("n_votes")
    chance = sum(F.col(x) * (F.col(x) - 1) for x in LABELS) / F.nullif(n * (n - 1), F.lit(0))
    seen = F.col("same") / F.nullif(n, F.lit(0))
    return sums.select(
        "n_pairs", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.round(seen, 6).alias("observed"), F.round(chance, 6).alias("expected"),
        F.round((seen - chance) / F.nullif(1 - chance, F.lit(0.0)), 6).alias("alpha"),
    )
