"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTEGRAL = {"bigint", "int", "smallint", "tinyint"}


def distinct_per_key(rows: DataFrame, key: str, item: str, out: str = "n_distinct") -> DataFrame:
    """Exact number of distinct ``item`` per ``key``, columns ``key`` and ``out`` (long).

    The mergeable state is a 64-bit mask per (key, item // 64): every partition folds its rows into masks
    in a bounded hash table that spills sorted runs when it is full, and only masks are shuffled, by
    (key, word), so a key with a third of all rows is spread over all tasks and folded up to 64 to 1.
    Redelivered items set a bit twice and change nothing. A second, again map-side combined, step adds
    up the bits of each key. Items that aren't integers use themselves as state.

    Nulls: rows with a null key or a null item count nowhere; a key with null items only is absent. An
    empty table gives an empty result. Other columns of ``rows``, whatever their names, are not read.
    """
    kept = rows.select(F.col(key).alias("k"), F.col(item).alias("i")).where("k IS NOT NULL AND i IS NOT NULL")
    if dict(kept.dtypes)["i"] in _INTEGRAL:
        kept = kept.withColumn("i", F.col("i").cast("long"))
        states = kept.groupBy("k", F.shiftright("i", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(i & 63L AS INT))")).alias("mask")
        )
        counted = states.groupBy("k").agg(F.sum(F.bit_count("mask").cast("long")).alias(out))
    else:
        counted = kept.distinct().groupBy("k").agg(F.count("*").alias(out))
    return counted.withColumnRenamed("k", key)


def deliveries_per_key(rows: DataFrame, key: str, item: str, at: str) -> DataFrame:
    """Per key: rows delivered, distinct items, resent rows, first and last arrival.

    All measures are algebraic (count, min, max) or the masks of ``distinct_per_key``; both sides arrive
    as one row per key, so joining them shuffles no raw rows. Null keys and items as there.
    """
    kept = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull())
    totals = kept.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
    )
    return totals.join(distinct_per_key(kept, key, item), key).withColumn("n_resent", F.col("n_rows") - F.col("n_distinct"))


def stale_counts(owners: DataFrame, owner_key: str, claimed: str, rows: DataFrame, key: str, item: str) -> DataFrame:
    """Owners whose ``claimed`` count differs from their distinct items, with both numbers.

    An owner without items has 0; a null claim differs from every number; repeated owner rows are
    compared one by one; an owner with a null key owns nothing and has 0.
    """
    counted = distinct_per_key(rows, key, item, "n_distinct").withColumnRenamed(key, "counted_key")
    owned = owners.select(F.col(owner_key).alias("owner"), F.col(claimed).alias("claimed"))
    joined = owned.join(counted, F.col("owner") == F.col("counted_key"), "left")
    true = F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct")
    return joined.select("owner", "claimed", true).where(~F.col("claimed").eqNullSafe(F.col("n_distinct")))


def lookup(rows: DataFrame, by: DataFrame, on: str, weight: str, total: int | None = None, share: float = 0.001) -> DataFrame:
    """``rows`` inner joined with the unique-keyed ``by``, without a hot task when a few keys hold most rows.

    ``by`` has the number of rows of each key in ``weight``. Keys above ``share`` of all rows number at
    most 1 / ``share``, so that side is broadcast within a proven bound; the rest is an ordinary join on
    keys none of which is hot. ``total`` is the number of ``rows``, if the caller knows it.
    """
    if total is None:
        total = by.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) > max(1, total * share)
    hot = F.broadcast(by.where(heavy).drop(weight))
    cold = by.where(~heavy).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on))


def spread_join(rows: DataFrame, by: DataFrame, on: str) -> DataFrame:
    """``rows`` inner joined with the unique-keyed ``by``, whose keys may be hot in ``rows``: counts them, map-side combined, and goes through ``lookup``."""
    counts = rows.groupBy(on).agg(F.count("*").alias("_n"))
    return lookup(rows, by.join(counts, on), on, "_n")


def join_by_size(rows: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = 1_000_000) -> DataFrame:
    """A join that broadcasts ``small`` only after counting it: up to ``limit`` narrow rows, else both sides are shuffled."""
    return rows.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def salted(column: Column, parts: int) -> Column:
    """A stable salt 0..parts-1 for a column."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
