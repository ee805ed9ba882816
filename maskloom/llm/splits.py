"""Splits that keep records of one author, source or entity together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut
from ..operators.components import connected_components
from ..operators.skew import lookup
from ..operators.splitting import greedy_splits

_ENTITY = 1 << 62
_SOURCE = 1 << 61


def source_key(source_id: Column) -> Column:
    """One spelling per source: the feed code and the number without leading zeros.

    Case, padding and separators don't matter. Anything that isn't a code with a number (null, empty, a
    stand-in word or sign) is a missing id: null.
    """
    found = F.regexp_extract(F.lower(F.trim(source_id)), r"^([a-z]+)[^a-z0-9]*0*([0-9]+)$", 1)
    number = F.regexp_extract(F.lower(F.trim(source_id)), r"^([a-z]+)[^a-z0-9]*0*([0-9]+)$", 2)
    return F.when(found != "", F.concat_ws("-", found, number))


def ties(texts: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges ``src, dst`` between texts and the sources and named entities they hold.

    A text is its id (below 2**61 in size), an entity 2**62 + its id, a source 2**61 + 61 bits of its
    hash; so a component's smallest node is always a text. Mentions of texts or entities that aren't in
    the tables tie nothing; null ids neither.
    """
    text = texts.select(F.col("id").alias("src"), source_key(F.col("source_id")).alias("key")).where("src IS NOT NULL")
    by_source = text.where("key IS NOT NULL").select(
        "src", (F.lit(_SOURCE) + F.xxhash64("key").bitwiseAND(F.lit(_SOURCE - 1))).alias("dst")
    )
    named = entities.where("heuristic_group = 'proper_name'").select(F.col("id").alias("entity_id")).distinct()
    pairs = mentions.select("entity_id", F.col("text_id").alias("src")).where("entity_id IS NOT NULL AND src IS NOT NULL")
    by_entity = (
        pairs.distinct()
        .join(named, "entity_id", "left_semi")
        .join(text.select("src").distinct(), "src", "left_semi")
        .select("src", (F.lit(_ENTITY) + F.col("entity_id")).alias("dst"))
    )
    return by_source.unionByName(by_entity)


def tied_groups(texts: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``text_id, group_id`` for every text: the smallest id among the texts tied to it directly or through others.

    A text tied to no other is its own group. Texts with a null id have no row; repeated text rows count
    once; empty tables give as many groups as texts.
    """
    found = connected_components(ties(texts, mentions, entities)).where(F.col("node") < _SOURCE)
    ids = texts.select(F.col("id").alias("text_id")).where("text_id IS NOT NULL").distinct()
    joined = ids.join(found.withColumnRenamed("node", "text_id"), "text_id", "left")
    return joined.select("text_id", F.coalesce("component", "text_id").alias("group_id"))


def assign_splits(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """``text_id, group_id, split``: whole groups go to one split, shares close to ``targets``.

    Groups of each size are put in the order of the hash of their id, and that order is cut into the ranges that
    splits still need, larger groups first: proportional ranges of the hash, so that neither one large group nor
    the luck of many small ones upsets the shares. Only the histogram of group sizes reaches the driver, at most as many rows as the square
    root of twice the number of texts, and it is the same way at every size. Shares are scaled to add up to 1; a null or
    negative share is 0; with no targets the split is null; no groups, no rows.
    """
    wanted = {r["split"]: max(0.0, r["target_share"] or 0.0) for r in targets.select("split", "target_share").where("split IS NOT NULL").collect()}
    if not sum(wanted.values()):
        return groups.withColumn("split", F.lit(None).cast("string"))
    groups = cut(groups, "groups")
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size")).withColumnRenamed("group_id", "component")
    split = greedy_splits(sizes, wanted, tuple(sorted(wanted)), by_share=False).withColumnRenamed("component", "group_id")
    weights = cut(split.join(sizes.withColumnRenamed("component", "group_id"), "group_id"), "group-splits")
    return lookup(groups, weights, "group_id", "size").select("text_id", "group_id", "split")


def held(assigned: DataFrame, targets: DataFrame, within: float = 0.01) -> DataFrame:
    """``n_texts, n_crossing, n_off``: texts placed, groups in several splits, and splits whose share is off by more than ``within`` beyond the largest group."""
    total = assigned.agg(F.count("*").alias("n_texts"))
    per_group = assigned.groupBy("group_id").agg(F.count_distinct("split").alias("k"), F.count("*").alias("n")).agg(F.count_if(F.col("k") > 1).alias("n_crossing"), F.max("n").alias("largest"))
    shares = targets.select("split", "target_share").join(assigned.groupBy("split").agg(F.count("*").alias("n")), "split", "left")
    both = shares.crossJoin(F.broadcast(total.crossJoin(per_group)))  # a row per split and two single rows
    off = F.abs(F.coalesce("n", F.lit(0)) / F.col("n_texts") - F.col("target_share")) > within + F.col("largest") / F.col("n_texts")
    return both.groupBy("n_texts", "n_crossing").agg(F.count_if(off).alias("n_off"))
