"""Judgments: votes, consensus, repair, agreement, directional relations, ranking pairs, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T


def votes(judgments: DataFrame) -> DataFrame:
    """One row per judgment id with its label cleaned; resent rows are alike but for their arrival."""
    kept = judgments.drop("received_at").distinct()
    return kept.withColumn("label", R.vote(F.col("label")))


def directed(directional: DataFrame) -> DataFrame:
    """One row per directional judgment id, with the relation its two directions amount to."""
    kept = directional.drop("received_at").distinct()
    return kept.withColumn("derived", R.relation(F.col("a_to_b"), F.col("b_to_a"))).withColumn("label", R.vote(F.col("preserves_meaning")))


def consensus(rows: DataFrame, least_preserved: int = 2, least_changed: int = 2) -> DataFrame:
    """``pair_id, votes_p, votes_c, label, score, rationale``: unanimous enough, or uncertain.

    Preserved needs ``least_preserved`` such votes and none for changed, changed the reverse; uncertain and
    missing votes never block. The score is the mean of all scores (halves round up); the rationale lists the votes in order.
    """
    line = F.concat_ws("=", F.col("annotator_id"), "label")
    grouped = rows.groupBy("pair_id").agg(
        F.count_if(F.col("label") == "preserved").alias("votes_p"), F.count_if(F.col("label") == "changed").alias("votes_c"),
        F.avg(F.when(~F.isnan("score"), F.col("score"))).alias("mean"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("judgment_id", line.alias("line")))), lambda x: x["line"]), "; ").alias("rationale"),
    )
    label = (
        F.when((F.col("votes_p") >= least_preserved) & (F.col("votes_c") == 0), "preserved")
        .when((F.col("votes_c") >= least_changed) & (F.col("votes_p") == 0), "changed").otherwise("uncertain")
    )
    return grouped.select("pair_id", "votes_p", "votes_c", label.alias("label"), F.round(F.col("mean") + F.lit(1e-9), 4).alias("score"), "rationale")


def repaired(raw: DataFrame, repairs: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Missing labels replaced by those of ``repairs`` (one row per key) unless these are missing too."""
    fixed = repairs.select(key, F.col(label).alias("_fix")).where(F.col("_fix") != "missing")
    joined = raw.join(fixed, key, "left")
    return joined.withColumn(label, F.when(F.col(label) == "missing", F.coalesce("_fix", label)).otherwise(F.col(label))).drop("_fix")


def unanswered(expected: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Expected ids without an answer: the input of a resumed run."""
    return expected.join(answers.select(key), key, "left_anti")


def agreement(pairs: DataFrame, bucket: str, a: str, b: str) -> DataFrame:
    """``bucket, n, agreement, kappa`` of two labels per row."""
    total = pairs.groupBy(bucket).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    sides = pairs.select(bucket, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("l")), F.struct(F.lit(1).alias("side"), F.col(b).alias("l")))).alias("x"))
    margin = sides.groupBy(bucket, "x.l").agg(F.count_if(F.col("x.side") == 0).alias("p"), F.count_if(F.col("x.side") == 1).alias("q"))
    chance = margin.groupBy(bucket).agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
    seen, luck = F.col("same") / F.col("n"), F.col("pq") / (F.col("n") * F.col("n"))
    kappa = F.when(luck < 1, (seen - luck) / (1 - luck))
    return total.join(chance, bucket).select(bucket, "n", F.round(seen, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def overlay(rows: DataFrame, payload: list[str], key: str, *order: Column) -> DataFrame:
    """The last payload of each key whose payloads all agree; keys with conflicting ones are left out."""
    both = F.struct(*payload)
    grouped = rows.groupBy(key).agg(F.min(both).alias("low"), F.max(both).alias("high"))
    return grouped.where("low = high").select(key, *[F.col(f"high.{c}").alias(c) for c in payload])


def nli_examples(rows: DataFrame, least: float = 0.8) -> DataFrame:
    """Two ordered examples per confident directional row: a to b, and b to a with the sides swapped."""
    valid = ("entailment", "neutral", "contradiction")
    kept = rows.where((F.col("confidence") >= least) & F.col("a_to_b").isin(*valid) & F.col("b_to_a").isin(*valid))

    def one(direction, premise, hypothesis, label):
        id = T.stable_id(20, F.col("pair_id"), F.lit(direction))
        return F.struct(id.alias("nli_id"), F.lit(direction).alias("direction"), F.col(premise).alias("premise"), F.col(hypothesis).alias("hypothesis"), F.col(label).alias("label"))

    both = F.array(one("a_to_b", "entity", "candidate", "a_to_b"), one("b_to_a", "candidate", "entity", "b_to_a"))
    return kept.select("pair_id", "judgment_id", F.inline(both))


def ranking_pairs(rows: DataFrame, group: str, negatives: int = 4, seed: str = "17") -> DataFrame:
    """``group, ranking_id, positive, negative``: every preserved row with a few changed ones of its group.

    Negatives are numbered within their group in the order of a hash; a positive takes ``negatives`` of them in a row
    from a place that its own hash says, round to the beginning. So a positive meets only its negatives, not all of its group,
    and a run can be repeated.
    """
    pos = rows.where("label = 'preserved'").select(group, F.col("pair_id").alias("positive"))
    neg = rows.where("label = 'changed'").select(group, F.col("pair_id").alias("negative"))
    order = Window.partitionBy(group).orderBy(F.sha1(F.concat_ws("|", F.lit(seed), "negative")), "negative")
    numbered = neg.withColumn("k", F.row_number().over(order) - 1)
    sizes = neg.groupBy(group).agg(F.count("*").alias("size"))
    start = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(seed), "positive")), 1, 8), 16, 10).cast("long")
    taken = F.sequence(F.lit(0).cast("long"), F.least(F.lit(negatives), F.col("size")) - 1)
    drawn = pos.join(sizes, group).withColumn("k", F.explode(F.transform(taken, lambda i: (start + i) % F.col("size"))))
    return drawn.join(numbered, [group, "k"]).select(group, T.stable_id(20, F.col("positive"), F.col("negative")).alias("ranking_id"), "positive", "negative")


def known_non_equivalent(a: Column, b: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """The two words, in either order, are a listed pair."""
    key = F.array_sort(F.array(T.article_free(a), T.article_free(b)))
    return F.array_join(key, "|").isin(*["|".join(sorted(p)) for p in pairs])


def stratified_sample(rows: DataFrame, strata: list[str], id: str, size: int, seed: str = "83") -> DataFrame:
    """Round robin over the strata until ``size`` rows are drawn; order within a stratum by hash."""
    draw = F.sha1(F.concat_ws("|", F.lit(seed), F.col(id).cast("string")))
    window = Window.partitionBy(*strata).orderBy(draw)
    # No stratum gives more than ``size`` rows, so the global order is over a bounded set.
    ranked = rows.withColumn("turn", F.row_number().over(window)).where(F.col("turn") <= size)
    picked = ranked.orderBy("turn", *strata, id).limit(size)
    place = F.row_number().over(Window.orderBy("turn", *strata, id))
    return picked.select(F.format_string("audit%06d", place).alias("audit_id"), id, *strata)
