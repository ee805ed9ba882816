"""Aliases of well-known names: the resource, its index and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import norm_key

# Groups of a canonical name, its strict aliases and those that need review.
ALIASES = (
    ("United States", ("U.S.", "US", "USA", "U.S.A.", "United States", "United States of America"), ("America",)),
    ("United Kingdom", ("UK", "U.K.", "Britain", "Great Britain", "United Kingdom"), ()),
    ("European Union", ("EU", "E.U.", "European Union"), ()),
    ("International Criminal Court", ("ICC", "International Criminal Court"), ()),
    ("United Nations", ("UN", "U.N.", "United Nations"), ()),
    ("Apple", ("Apple", "Apple Inc.", "Apple, Inc."), ()),
    ("Microsoft", ("Microsoft", "Microsoft Corp.", "Microsoft Corporation"), ()),
    ("OpenAI", ("OpenAI", "OpenAI Inc.", "OpenAI, Inc."), ()),
)
SCHEMA = "groups array<struct<canonical:string,strict_aliases:array<string>,review_aliases:array<string>>>"


def resource(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``place, canonical, strict, review``: from a JSON file of that form, or the built-in groups."""
    if path:
        groups = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.posexplode("groups").alias("place", "g"))
        return groups.select("place", "g.canonical", F.col("g.strict_aliases").alias("strict"), F.col("g.review_aliases").alias("review"))
    rows = [(i, c, list(s), list(r)) for i, (c, s, r) in enumerate(ALIASES)]
    return spark.createDataFrame(rows, "place int, canonical string, strict array<string>, review array<string>")


def index(groups: DataFrame) -> DataFrame:
    """``key, strict, review``: one row per key of a canonical name or alias; of several groups the last counts."""
    strict, review = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in ("strict", "review"))
    names = F.concat(strict, review, F.when(F.col("canonical").isNotNull(), F.array("canonical")).otherwise(F.array().cast("array<string>")))
    rows = groups.select("place", strict.alias("strict"), review.alias("review"), F.explode(names).alias("name")).where("name <> ''")
    return rows.groupBy(norm_key(F.col("name")).alias("key")).agg(F.max_by(F.struct("strict", "review"), "place").alias("x")).select("key", "x.strict", "x.review")


def alias_candidates(rows: DataFrame, surface: Column, indexed: DataFrame) -> DataFrame:
    """``rows`` with ``strict`` and ``review``: the aliases of a surface that have another key; empty arrays without any.

    The index is a resource file of a few groups, so it is sent to all tasks.
    """
    key = norm_key(surface)
    met = rows.withColumn("_key", key).join(F.broadcast(indexed.withColumnRenamed("key", "_key")), "_key", "left")
    none = F.array().cast("array<string>")
    for c in ("strict", "review"):
        met = met.withColumn(c, F.coalesce(F.filter(F.col(c), lambda x: norm_key(x) != F.col("_key")), none))
    return met.drop("_key")
