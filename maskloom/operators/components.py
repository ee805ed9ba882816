"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import cut, release
from .skew import lookup


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest node it knows."""
    low = edges.groupBy("s").agg(F.count("*").alias("n"))
    seen = edges.groupBy(F.col("l").alias("s")).agg(F.min("s").alias("m"))
    # A node without a smaller neighbour is its own minimum: its edges stay and need no join.
    moved = low.join(seen, "s")
    stay = edges.join(seen.select("s"), "s", "left_anti").select("l", "s")
    return stay.unionByName(lookup(edges, moved, "s", "n", total).select("l", F.col("m").alias("s")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("l").agg(F.min("s").alias("m"), F.count("*").alias("n"))
    several = least.where("n > 1")
    rest = lookup(edges, several, "l", "n", total).where("s <> m").select(F.col("s").alias("l"), F.col("m").alias("s"))
    return least.select("l", F.col("m").alias("s")).unionByName(rest)


def _at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over one partition of bounded size: every node with the smallest node of its component."""
    parts = [b[["l", "s"]].to_numpy(np.int64) for b in batches if len(b)]
    if not parts:
        return
    nodes, place = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = place.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        differ = high != low
        if not differ.any():
            break
        np.minimum.at(root, high[differ], low[differ])
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"node": nodes, "component": nodes[root]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """One row ``node, component`` (longs) per node of ``edges``; the component is its smallest node.

    Nulls in either column and self-loops are dropped (a node seen only in those is absent); repeated
    and reversed edges count once; an empty table gives an empty result; extra columns are not read.
    Each round is two rewritings of the edge table and ends in a table in the shared folder, so lineage
    stays short and a lost executor costs one round. Hot nodes go through ``lookup``. The loop ends when
    the edges are a fixed point, which for these rewritings is a forest of stars; rounds grow with the
    logarithm of the longest path. Up to ``at_once`` edges, counted before, are resolved by one task instead (16
    bytes an edge); the result is the same.
    """
    pair = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    current = cut(
        pair.where("a <> b").select(F.greatest("a", "b").alias("l"), F.least("a", "b").alias("s")).distinct(), "edges"
    )
    mark = _mark(current)
    if 0 < mark[0] <= at_once:
        return current.coalesce(1).mapInPandas(_at_once, "node long, component long")
    for _ in range(max_rounds):
        if not mark[0]:
            break
        half = cut(_large_star(current, mark[0]).distinct(), "large-star")
        after = cut(_small_star(half, mark[0]).distinct(), "small-star")
        release(half)
        release(current)
        before, mark, current = mark, _mark(after), after
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = current.select(F.col("l").alias("node"), F.col("s").alias("component"))
    return leaves.unionByName(current.select(F.col("s").alias("node"), F.col("s").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges."""
    hashed = F.xxhash64("l", "s")
    return tuple(edges.agg(F.count("*"), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed)).first())
