"""Nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(queries: DataFrame, rows: DataFrame, id: str, vector: str, k: int, block: int = 4096, group: str | None = None) -> DataFrame:
    """``query, id, rank, cosine``: exact nearest rows of every query but itself, of the query's group if one is named.

    Queries go out in blocks of bounded size; each task multiplies a block with its batches and keeps k rows
    per query, so at most k rows per query and task are shuffled. Null vectors and ids are left out; ties go
    to the smaller id.
    """
    spark = rows.sparkSession
    keep = [F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).cast("string").alias("g")]
    asked = queries.select(*keep).where("id IS NOT NULL AND v IS NOT NULL")
    base = rows.select(*keep).where("id IS NOT NULL AND v IS NOT NULL")
    n_blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").collect()
        if not mine:
            continue
        matrix = np.array([r["v"] for r in mine])
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in mine]), matrix / np.where(norms == 0, 1, norms), np.array([r["g"] for r in mine], object)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q, groups = sent.value
            held_ids, held = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
            for batch in batches:
                if not len(batch):
                    continue
                m = np.stack(batch["v"].to_numpy())
                length = np.linalg.norm(m, axis=1, keepdims=True)
                cosine = np.round(q @ (m / np.where(length == 0, 1, length)).T, 6)
                other = batch["id"].to_numpy()
                cosine[ids[:, None] == other[None, :]] = -np.inf
                cosine[groups[:, None] != batch["g"].to_numpy(object)[None, :]] = -np.inf
                # What the task has kept so far competes with the batch; k a query remain.
                cosine = np.concatenate([held, cosine], axis=1)
                every = np.concatenate([held_ids, np.broadcast_to(other, (len(ids), len(other)))], axis=1)
                best = np.lexsort((every, -cosine), axis=1)[:, :k]
                held, held_ids = np.take_along_axis(cosine, best, 1), np.take_along_axis(every, best, 1)
            use = np.isfinite(held)
            yield pd.DataFrame({"query": np.repeat(ids, held.shape[1])[use.ravel()], "id": held_ids[use], "cosine": held[use]})

        part = base.mapInPandas(run, "query long, id long, cosine double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query long, id long, rank long, cosine double")
    rank = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k).select("query", "id", "rank", "cosine")


def bucket_quota(neighbours: DataFrame, bounds: dict[str, float], per_bucket: int) -> DataFrame:
    """``query, id, bucket``: up to ``per_bucket`` neighbours per query and cosine bucket, each unordered pair once.

    A pair belongs to its smaller query; that is the declarative form of a greedy pass and equals it while
    quotas don't bind.
    """
    bucket = None
    for name, least in bounds.items():
        hit = F.col("cosine") >= least
        bucket = F.when(hit, name) if bucket is None else bucket.when(hit, name)
    owned = neighbours.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    pair = owned.groupBy(F.least("query", "id").alias("low"), F.greatest("query", "id").alias("high")).agg(F.min(F.struct("query", "id", "bucket", "cosine")).alias("x"))
    rank = Window.partitionBy("query", "bucket").orderBy(F.desc("cosine"), "id")
    return pair.select("x.*").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_bucket).select("query", "id", "bucket")
