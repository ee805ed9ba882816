"""Quality of scores against labels, from sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _f1(hit: Column, wrong: Column, lost: Column) -> Column:
    return 2 * hit / F.greatest(2 * hit + wrong + lost, F.lit(1))


def counts(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn as aggregates."""
    return [
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"),
    ]


def from_counts(frame: DataFrame, *keep: str) -> DataFrame:
    """Accuracy, precision, recall and macro F1 from the four counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = _f1(tp, fp, fn), _f1(tn, fn, fp)
    return frame.select(
        *keep, "tp", "fp", "fn", "tn", F.round(_ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(_ratio(tp, tp + fp), 6).alias("precision"),
        F.round(_ratio(tp, tp + fn), 6).alias("recall"), F.round((pos + neg) / 2, 6).alias("macro_f1"),
    )


def binary(rows: DataFrame, groups: list[str], threshold: float = 0.5, least: int = 1) -> DataFrame:
    """Metrics of ``score`` against boolean ``truth`` per group of at least ``least`` rows."""
    per = rows.groupBy(*groups).agg(*counts(F.col("truth"), F.col("score") >= threshold))
    return from_counts(per.where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= least), *groups)


def _by_score(rows: DataFrame) -> DataFrame:
    """One row per distinct score with its positives and negatives: all that ranking metrics need."""
    return rows.groupBy("score").agg(F.count_if("truth").alias("p"), F.count_if(~F.col("truth")).alias("q"))


def calibration(rows: DataFrame) -> DataFrame:
    """``n, brier, ece, roc_auc, average_precision``, one row.

    The ranking metrics run over distinct scores, not rows: scores are rounded to 6 places before.
    """
    r = rows.select("truth", F.round("score", 6).alias("score"))
    y = F.col("truth").cast("double")
    one = r.agg(F.count("*").alias("n"), F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"))
    bins = r.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("k"), F.avg("score").alias("s"), F.avg(y).alias("t"))
    ece = bins.agg((F.sum(F.col("k") * F.abs(F.col("s") - F.col("t"))) / F.sum("k")).alias("ece"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _by_score(r).select("p", "q", F.sum("p").over(down).alias("cp"), F.sum("q").over(down).alias("cq"))
    total = ranked.agg(
        F.sum("p").alias("np"), F.sum("q").alias("nq"), F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2)).alias("above"),
        F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))).alias("ap"),
    )
    both = one.crossJoin(ece).crossJoin(total)  # three single rows
    auc = F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("above") / (F.col("np") * F.col("nq")))
    return both.select("n", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"), F.round(auc, 6).alias("roc_auc"), F.round(F.col("ap") / F.col("np"), 6).alias("average_precision"))


def sweep(rows: DataFrame, steps: int = 99) -> DataFrame:
    """``threshold`` 0.01 to 0.99 with metrics, and which is the first best macro F1.

    Rows are reduced to one per score step before the thresholds are applied to them.
    """
    step = F.least(F.floor(F.round(F.col("score") * (steps + 1), 6)), F.lit(steps + 1)).cast("int")
    per = rows.groupBy(step.alias("s")).agg(F.count_if("truth").alias("p"), F.count_if(~F.col("truth")).alias("q"))
    at = per.select("p", "q", "s", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("t"))
    hit = F.col("s") >= F.col("t")
    sums = at.groupBy("t").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("q")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("q"))).alias("tn"),
    )
    out = from_counts(sums.withColumn("threshold", F.round(F.col("t") / (steps + 1), 2)), "threshold")
    rank = F.row_number().over(Window.orderBy(F.desc("macro_f1"), "threshold"))
    return out.withColumn("is_best", rank == 1)


def clustered_bootstrap(rows: DataFrame, cluster: str, draws: int = 200, seed: str = "23") -> DataFrame:
    """``n_draws, mean, low, high``: macro F1 over resampled clusters, with 95 % bounds by order statistics.

    Every cluster is reduced to its four counts; in each draw it is taken as often as a hash says (Poisson of
    mean 1, the large-sample form of drawing with replacement), so draws need no shuffle of the rows.
    """
    per = rows.groupBy(cluster).agg(*counts(F.col("truth"), F.col("score") >= 0.5))
    drawn = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("d"))
    u = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(seed), F.col("d").cast("string"), F.col(cluster).cast("string"))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    bounds = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    times = sum((u >= b).cast("int") for b in bounds)
    sums = drawn.withColumn("w", times).groupBy("d").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "fn", "tn")])
    scored = from_counts(sums, "d")
    rank = scored.withColumn("r", F.row_number().over(Window.orderBy("macro_f1", "d")))
    low, high = max(1, round(draws * 0.025)), round(draws * 0.975)
    return rank.agg(
        F.count("*").alias("n_draws"), F.round(F.avg("macro_f1"), 6).alias("mean"),
        F.max(F.when(F.col("r") == low, F.col("macro_f1"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("macro_f1"))).alias("high"),
    )


_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


def bootstrap_comparison(rows: DataFrame, cluster: str, draws: int = 1000, seed: str = "23") -> DataFrame:
    """``n_draws, n_groups, mean_delta, low, high, new_better``: macro F1 of ``new`` less that of ``old`` over resampled clusters.

    As ``clustered_bootstrap``, with the counts of both scores per cluster; the bounds are the order statistics at 2.5 and
    97.5 %, and ``new_better`` is the share of draws in which the difference is above 0.
    """
    both = [c.alias(f"{n}_{m}") for m in ("old", "new") for c, n in zip(counts(F.col("truth"), F.col(m) >= 0.5), ("tp", "fp", "fn", "tn"))]
    per = rows.groupBy(cluster).agg(*both)
    drawn = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("d"))
    u = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(seed), F.col("d").cast("string"), F.col(cluster).cast("string"))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    names = [f"{n}_{m}" for m in ("old", "new") for n in ("tp", "fp", "fn", "tn")]
    sums = drawn.withColumn("w", sum((u >= b).cast("int") for b in _POISSON)).groupBy("d").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in names])

    def f1(m: str) -> Column:
        tp, fp, fn, tn = (F.col(f"{n}_{m}") for n in ("tp", "fp", "fn", "tn"))
        return F.round((2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)) + 2 * tn / F.greatest(2 * tn + fn + fp, F.lit(1))) / 2, 6)

    delta = sums.select("d", F.round(f1("new") - f1("old"), 6).alias("delta"))
    ranked = delta.withColumn("r", F.row_number().over(Window.orderBy("delta", "d")))  # as many rows as draws
    low, high = int(draws * 0.025) + 1, min(int(draws * 0.975), draws - 1) + 1
    found = ranked.agg(
        F.count("*").alias("n_draws"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.max(F.when(F.col("r") == low, F.col("delta"))).alias("low"),
        F.max(F.when(F.col("r") == high, F.col("delta"))).alias("high"), F.round(F.avg((F.col("delta") > 0).cast("double")), 4).alias("new_better"),
    )
    groups = per.agg(F.count("*").alias("n_groups"))
    return found.crossJoin(groups).select("n_draws", "n_groups", "mean_delta", "low", "high", "new_better")  # two single rows


def outcome(truth: Column, old: Column, new: Column) -> Column:
    """How a new decision compares with an old one."""
    return (
        F.when((old == truth) & (new == truth), "both_correct").when(new == truth, "new_fixed")
        .when(old == truth, "new_regressed").otherwise("both_wrong")
    )
