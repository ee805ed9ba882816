"""Documents into containers of fixed capacity, shortest pack first over the histogram of lengths.

Only the histogram (one row per length up to the capacity) reaches the driver, where packs are counted
per pattern, never listed. Documents then find their container by their rank among those of their length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import cut
from ..operators.skew import join_by_size

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits a text before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PER_SALT = 1_000_000  # items ranked by one task


def token_counts(documents: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` by a tokenizer in the form of ranked byte pairs; a null text has 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        encoding = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["t"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes})

    return documents.select(F.col(id).alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, n_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ``(packs, ((length, items per pack), ...))``.

    Lengths are placed longest first, each item into the shortest pack (the one with most space left) if it
    fits there, else into a new pack. Packs of one pattern take an item each at once and then count among
    the packs of their new space, so the outcome is that of placing the items one by one.
    """
    by_space: dict[int, list[tuple[int, tuple | None]]] = {}
    spaces: list[int] = []  # a heap, most space first; holds every key of by_space at least once

    def add(space: int, count: int, pattern) -> None:
        if space not in by_space:
            by_space[space] = []
            heapq.heappush(spaces, -space)
        by_space[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo and spaces and -spaces[0] >= length:
            space = -spaces[0]
            count, pattern = by_space[space].pop()
            used = min(count, todo)
            if count > used:
                by_space[space].append((count - used, pattern))
            if not by_space[space]:
                del by_space[space]
                heapq.heappop(spaces)
            add(space - length, used, (length, pattern))
            todo -= used
        # A new pack is the one with most space, so the next items go there until it is full.
        whole, rest = divmod(todo, capacity // length)
        for packs, items in ((whole, capacity // length), (min(rest, 1), rest)):
            if packs:
                pattern = None
                for _ in range(items):
                    pattern = (length, pattern)
                add(capacity - items * length, packs, pattern)
    out = []
    for entries in by_space.values():
        for count, pattern in entries:
            held: dict[int, int] = {}
            while pattern:
                held[pattern[0]] = held.get(pattern[0], 0) + 1
                pattern = pattern[1]
            out.append((count, tuple(sorted(held.items(), reverse=True))))
    return out


def _slots(spark, patterns, capacity: int) -> DataFrame:
    """``size, low, base, each, steps``: per length the ranks at which its ranges begin, and what they lead to.

    One row per length and arrays of at most the number of patterns, which the capacity bounds.
    """
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for packs, pattern in patterns:
        for size, each in pattern:
            by_size.setdefault(size, []).append((taken.get(size, 0), base, each))
            taken[size] = taken.get(size, 0) + packs * each
        base += packs
    rows = []
    for size, ranges in by_size.items():
        steps = [1 << k for k in range(len(ranges).bit_length() - 1, -1, -1)]
        rows.append((size, *([r[i] for r in ranges] for i in range(3)), steps))
    return spark.createDataFrame(rows, "size long, low array<long>, base array<long>, each array<long>, steps array<int>")


def pack(counts: DataFrame, capacity: int, per_salt: int = PER_SALT) -> DataFrame:
    """``container_id, doc_id, piece, token_start, n_tokens``.

    An item longer than the capacity, and only such a one, is cut into full pieces, each filling a container,
    and a rest that is packed like any item. Rows with a null id are packed as others are; a null or zero
    size takes no space and has no row; repeated rows are items of their own; an empty table gives an empty
    result. A length that many items have is ranked in parts of about ``per_salt`` items, so no task ranks more. Container ids
    follow from ranks and stay the same if a lost task runs again.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = counts.sparkSession
    items = counts.where("n_tokens > 0").select("doc_id", "n_tokens")
    full = F.floor(F.col("n_tokens") / capacity).cast("long")
    rest = items.select("doc_id", full.alias("piece"), (F.col("n_tokens") % capacity).alias("size")).where("size > 0")
    whole = items.where(full > 0).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"), F.lit(capacity).cast("long").alias("size")
    )
    pieces = rest.unionByName(whole)
    # One row per length, at most the capacity.
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}
    salts = [(size, -(-n // per_salt)) for size, n in histogram.items()]
    salts = spark.createDataFrame(salts, "size long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))
    salted = cut(pieces.join(F.broadcast(salts), "size").select("doc_id", "piece", "size", salt.alias("salt")), "items")
    cells = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1
    ranked = join_by_size(salted.withColumn("r", place), offsets, ["size", "salt"]).withColumn("rank", F.col("r") + F.col("offset"))
    placed = ranked.join(F.broadcast(_slots(spark, shortest_pack_first(histogram, capacity), capacity)), "size")
    # Binary search for the last range that begins at the rank or before; positions count from 0.
    found = F.aggregate(
        "steps", F.lit(0), lambda at, step: F.when((at + step < F.size("low")) & (F.get("low", at + step) <= F.col("rank")), at + step).otherwise(at)
    )
    placed = placed.withColumn("at", found)
    container = F.get("base", F.col("at")) + F.floor((F.col("rank") - F.get("low", F.col("at"))) / F.get("each", F.col("at")))
    return placed.select(
        container.cast("long").alias("container_id"), "doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.col("size").alias("n_tokens")
    )


def pack_all(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The packing for every size in ``containers`` (a small table; null or non-positive sizes are skipped)."""
    counts = cut(token_counts(documents, tokenizer=tokenizer), "token-counts")
    sizes = containers.where("capacity_tokens > 0").select("container_name", "capacity_tokens").distinct().collect()
    out = None
    for row in sorted(sizes, key=lambda r: (r["capacity_tokens"], r["container_name"] or "")):
        one = pack(counts, row["capacity_tokens"]).select(F.lit(row["container_name"]).cast("string").alias("container_name"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        empty = "container_name string, container_id long, doc_id long, piece long, token_start long, n_tokens long"
        return documents.sparkSession.createDataFrame([], empty)
    return out


def use_of_space(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_name, n_containers, n_tokens, used_share`` per container size."""
    per = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    total = per.groupBy("container_name").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"))
    joined = total.join(containers.select("container_name", "capacity_tokens").distinct(), "container_name")
    share = F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)
    return joined.select("container_name", "n_containers", "n_tokens", share.alias("used_share"))


def placement(documents: DataFrame, packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_name, n_documents, n_broken, n_over``: what a packing must keep, per container size.

    Documents placed; those whose pieces leave a gap, overlap, or are more than one without need; containers
    holding more than their capacity. Both of the last are 0 in a packing that holds.
    """
    sizes = containers.where("capacity_tokens > 0").select("container_name", "capacity_tokens").distinct()
    over = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("t")).join(sizes, "container_name")
    over = over.groupBy("container_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"))
    per = packed.groupBy("container_name", "doc_id").agg(
        F.count("*").alias("k"), F.max("piece").alias("last"), F.sum("n_tokens").alias("t"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end")
    )
    per = per.join(sizes, "container_name")
    need = F.ceil(F.col("t") / F.col("capacity_tokens"))
    broken = (F.col("t") != F.col("end")) | (F.col("k") != need) | (F.col("last") != F.col("k") - 1)
    kept = per.groupBy("container_name").agg(F.count("*").alias("n_documents"), F.count_if(broken).alias("n_broken"))
    return kept.join(over, "container_name").select("container_name", "n_documents", "n_broken", "n_over")
