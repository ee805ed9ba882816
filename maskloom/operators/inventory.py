"""The entity inventory: mentions, entities, counters, exports and rebuilt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .skew import spread_join


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a stated order; ties by every other column, so that runs agree."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def top_per_group(rows: DataFrame, groups: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; Spark limits groups before the shuffle."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def delivered_once(mentions: DataFrame) -> DataFrame:
    """One row per mention id; resent rows have the same content, so only ``loaded_at`` needs a choice."""
    same = [c for c in mentions.columns if c not in ("id", "loaded_at")]
    return mentions.groupBy("id").agg(*[F.first(c).alias(c) for c in same], F.min("loaded_at").alias("loaded_at"))


def mask_rows(texts: DataFrame) -> DataFrame:
    """``text_id, mask_idx, mask``: one row per mask as written."""
    return texts.select(F.col("id").alias("text_id"), F.posexplode(T.masks(F.col("masked_text"))).alias("mask_idx", "mask"))


def type_counts(mentions: DataFrame) -> DataFrame:
    """``entity_id, observed_type, n``: nested counters in long form, distinct mentions."""
    kept = mentions.select("entity_id", "observed_type", "id").where("entity_id IS NOT NULL").distinct()
    return kept.groupBy("entity_id", F.coalesce("observed_type", F.lit("missing")).alias("observed_type")).agg(F.count("*").alias("n"))


def primary_type(counts: DataFrame) -> DataFrame:
    """``entity_id, primary_type, n_mentions``: the most frequent type, the alphabetically first of equals."""
    best = F.struct((-F.col("n")).alias("n"), F.col("observed_type").alias("t"))
    return counts.groupBy("entity_id").agg(F.min(best).alias("b"), F.sum("n").alias("n_mentions")).select("entity_id", F.col("b.t").alias("primary_type"), "n_mentions")


def star(mentions: DataFrame, texts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Mentions with their corpus; the facts are reduced to the columns in use before they are shuffled."""
    facts = mentions.select("id", "entity_id", "text_id").where("entity_id IS NOT NULL")
    placed = facts.join(texts.select(F.col("id").alias("text_id"), "dataset_id"), "text_id")
    return placed.join(datasets.select(F.col("id").alias("dataset_id"), "name", "split", "domain"), "dataset_id")


def rebuilt_texts(texts: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``text_id, rebuilt``: masked texts with every mention's surface put back; masks without one stay."""
    named = spread_join(mentions.select("text_id", "mask_idx", "entity_id").distinct(), entities.select(F.col("id").alias("entity_id"), "surface"), "entity_id")
    one = named.groupBy("text_id", "mask_idx").agg(F.min("surface").alias("surface"))
    filled = one.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("mask_idx", "surface"))).alias("m"))
    rows = texts.select(F.col("id").alias("text_id"), "masked_text").where("masked_text IS NOT NULL").join(filled, "text_id", "left")
    m = F.coalesce("m", F.create_map().cast("map<bigint,string>"))
    return rows.select("text_id", T.fill_masks(F.col("masked_text"), m).alias("rebuilt"))


def slim_subset(entities: DataFrame, mentions: DataFrame, texts: DataFrame, group: str, n_entities: int, n_mentions: int):
    """(entities, mentions, texts) of the most mentioned entities of a group, a few mentions each, their texts only."""
    kept = entities.where(F.col("heuristic_group") == group).orderBy(F.desc("mention_count"), "id").limit(n_entities)
    rows = mentions.select("id", "entity_id", "text_id", "mask_idx").distinct().join(kept.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    some = top_per_group(rows, ["entity_id"], n_mentions, F.col("id"))
    return kept, some, texts.join(some.select(F.col("text_id").alias("id")), "id", "left_semi")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Insert-or-ignore: the first of the new rows of a key, unless it is there already."""
    return old.unionByName(first_per_key(new, keys, *order).join(old.select(*keys), keys, "left_anti"))


def merged_counters(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Counters ``key, value, n`` of two batches added up; applying a batch again to its own result is the caller's error."""
    return a.unionByName(b).groupBy(key, value).agg(F.sum("n").alias("n"))
