"""Splits by component, group or row, and what leaks between them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import cut
from .components import connected_components
from .skew import join_by_size

_DOCUMENT = 1 << 61
AT_ONCE = 1_000_000  # edges that one task resolves


def entity_document_components(rows: DataFrame, entity: str, document: str) -> DataFrame:
    """Rows with the component of the graph that ties rows by entity and by document; rows are first reduced to distinct edges."""
    edges = rows.select(F.col(entity).alias("src"), (F.col(document) + F.lit(_DOCUMENT)).alias("dst")).distinct()
    found = connected_components(edges, at_once=AT_ONCE)
    return rows.join(found.select(F.col("node").alias(entity), "component"), entity, "left")


def component_sizes(rows: DataFrame) -> DataFrame:
    """``size, n_components``: how many components have how many rows."""
    return rows.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


def _level(load: dict[str, float], base: dict[str, float], unit: dict[str, float], step: float, count: int) -> dict[str, int]:
    """How many of ``count`` equal items of ``step`` each split gets if every item goes where (load - base) / unit is least."""

    def fits(level: float) -> dict[str, int]:
        # Items go to a split while it is below the level before they come.
        return {k: max(0, math.ceil((level * unit[k] + base[k] - load[k]) / step)) for k in load}

    low = min((load[k] - base[k]) / unit[k] for k in load)
    high = max((load[k] + step * count - base[k]) / unit[k] for k in load) + 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if sum(fits(middle).values()) <= count:
            low = middle
        else:
            high = middle
    return fits(low)


def quotas(classes: list[tuple[int, int, int]], ratios: dict[str, float], order: tuple[str, ...], by_share: bool = True) -> list[tuple[int, int, str, int, int]]:
    """``(size, rare, split, low, high)``: which ranks of each class of components go to which split.

    ``classes`` are ``(size, rare rows, components)``. Components with rows of a rare source come first, larger ones before
    smaller ones, each to the split whose rare rows fall most behind, then whose rows do, then by ``order``; the others then
    to the split whose rows fall most behind: by the share of its target it has, or else by the rows it lacks, which keeps a large
    component out of a small split. Equal components are placed all at once: what they would bring about one by one
    follows from the level they fill up to.
    """
    total, rare_total = (sum(c[i] * c[2] for c in classes) for i in (0, 1))
    scale = sum(ratios.values()) or 1.0

    def ruler(of: int) -> tuple[dict[str, float], dict[str, float]]:
        goal = {k: max(of * v / scale, 1.0) for k, v in ratios.items()}
        return (dict.fromkeys(ratios, 0.0), goal) if by_share else ({k: of * v / scale for k, v in ratios.items()}, dict.fromkeys(ratios, 1.0))

    (base, unit), (rare_base, rare_unit) = ruler(total), ruler(rare_total)
    load, rare_load, out = dict.fromkeys(ratios, 0.0), dict.fromkeys(ratios, 0.0), []
    open_ = [k for k in ratios if ratios[k] > 0]
    for size, rare, count in sorted(classes, key=lambda c: (c[1] == 0, -c[0], -c[1])):
        main, zero, one, step = (rare_load, rare_base, rare_unit, rare) if rare else (load, base, unit, size)
        given = dict.fromkeys(ratios, 0)
        if count > 1000:
            given |= _level({k: main[k] for k in open_}, zero, one, step, count)
        for k, n in given.items():
            load[k] += n * size
            rare_load[k] += n * rare
        for _ in range(count - sum(given.values())):
            to = min(open_, key=lambda k: ((main[k] - zero[k]) / one[k], (load[k] - base[k]) / unit[k], order.index(k)))
            given[to] += 1
            load[to] += size
            rare_load[to] += rare
        low = 0
        for k in order:
            if given.get(k):
                out.append((size, rare, k, low, low + given[k]))
                low += given[k]
    return out


def hash_ranked(rows: DataFrame, by: list[str], id: str, counts: DataFrame, seed: str = "41", per_part: int = 1_000_000) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within ``by``, in the order of a hash of ``id``; ``counts`` has ``by`` and ``n``, few rows.

    A class of many rows is ranked in parts by the beginning of the hash, so that no task ranks more than about ``per_part``.
    """
    parts = counts.select(*by, F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / per_part) / 4)).cast("int").alias("_digits"))
    hashed = rows.withColumn("_h", F.sha1(F.concat_ws("|", F.lit(seed), F.col(id).cast("string")))).join(F.broadcast(parts), by)
    hashed = hashed.withColumn("_part", F.substring("_h", F.lit(1), F.col("_digits"))).drop("_digits")
    cells = hashed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h", id)) - 1
    ranked = join_by_size(hashed.withColumn("_r", place), offsets, [*by, "_part"])
    return ranked.withColumn("rank", F.col("_r") + F.col("_offset")).drop("_h", "_part", "_r", "_offset")


def greedy_splits(sizes: DataFrame, ratios: dict[str, float], order: tuple[str, ...] = ("test", "val", "train"), rare: str | None = None, by_share: bool = True) -> DataFrame:
    """``component, split``: components by size, those with rows of rare sources first (see ``quotas``).

    ``sizes`` has ``component, size`` and, if named, ``rare``, the rows of rare sources. Only the histogram of sizes reaches the driver:
    as many rows as there are different sizes, at most the square root of twice the number of rows. Which of equal
    components go where follows their hash. A behaviour of its own for small or large inputs there is none.
    """
    sizes = cut(sizes.select("component", "size", (F.col(rare) if rare else F.lit(0)).cast("long").alias("rare")), "sizes")
    per = sizes.groupBy("size", "rare").agg(F.count("*").alias("n"))
    classes = [(r["size"], r["rare"], r["n"]) for r in per.collect()]
    spark = sizes.sparkSession
    counts = spark.createDataFrame(classes, "size long, rare long, n long")
    ranges = spark.createDataFrame(quotas(classes, ratios, order, by_share), "size long, rare long, split string, low long, high long")
    per_class = ranges.groupBy("size", "rare").agg(F.array_sort(F.collect_list(F.struct("low", "split"))).alias("ranges"))
    ranked = hash_ranked(sizes, ["size", "rare"], "component", counts).join(F.broadcast(per_class), ["size", "rare"])
    found = F.element_at(F.filter("ranges", lambda x: x["low"] <= F.col("rank")), -1)["split"]
    return ranked.select("component", found.alias("split"))


def _nth(hashed: DataFrame, rank: int, length: int) -> str:
    """The hash of that rank among hashes with one beginning: longer beginnings are counted until few are left to sort."""
    counts = {r["p"]: r["n"] for r in hashed.groupBy(F.substring("h", 1, length).alias("p")).agg(F.count("*").alias("n")).collect()}
    seen = 0
    for p in sorted(counts):
        if seen + counts[p] > rank:
            part = hashed.where(F.substring("h", 1, length) == p)
            if counts[p] > 100_000 and length < 40:
                return _nth(part, rank - seen, length + 3)
            return sorted(r["h"] for r in part.select("h").collect())[rank - seen]  # at most 100,000
        seen += counts[p]
    raise IndexError(rank)


def hash_splits(keys: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: str = "41") -> DataFrame:
    """``key, split`` for distinct keys: the exact floor of each share, in the order of a hash.

    The cut-offs are two order statistics of the hash, found by counting hash ranges, so no task ever
    ranks all keys: only the range a cut-off falls into is sorted.
    """
    hashed = cut(keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", F.sha1(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))), "hashed")
    n = hashed.count()
    counts = {r["p"]: r["n"] for r in hashed.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.count("*").alias("n")).collect()}

    def at(rank: int) -> str:
        """The hash of that rank (from 0); beyond the last, a string above all."""
        seen = 0
        for p in sorted(counts):
            if seen + counts[p] > rank:
                return _nth(hashed.where(F.substring("h", 1, 3) == p), rank - seen, 6)
            seen += counts[p]
        return "~"

    low, high = int(n * test), int(n * test) + int(n * val)
    first, second = at(low), at(high)
    return hashed.select(key, F.when(F.col("h") < first, "test").when(F.col("h") < second, "val").otherwise("train").alias("split"))


def overlaps(rows: DataFrame, split: str, kinds: dict[str, Column]) -> DataFrame:
    """``kind, left, right, n``: values that two splits share, per kind; all kinds in one pass."""
    values = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()])
    seen = rows.select(split, F.explode(values).alias("x")).where("x.value IS NOT NULL").groupBy("x.kind", "x.value").agg(F.array_sort(F.collect_set(split)).alias("s"))
    several = seen.where(F.size("s") > 1)
    both = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return several.select("kind", F.inline(both)).groupBy("kind", "left", "right").agg(F.count("*").alias("n"))
