"""Quotas of splits against placing components one by one, and exact ranks."""

import random
from collections import Counter

import pytest

from maskloom.operators import splitting as S

ORDER = ("test", "val", "train")


def one_by_one(classes, ratios):
    total, rare_total = (sum(c[i] * c[2] for c in classes) for i in (0, 1))
    goal = {k: max(total * v, 1.0) for k, v in ratios.items()}
    rare_goal = {k: max(rare_total * v, 1.0) for k, v in ratios.items()}
    load, rare_load = dict.fromkeys(ratios, 0), dict.fromkeys(ratios, 0)
    for size, rare, n in sorted(classes, key=lambda c: (c[1] == 0, -c[0], -c[1])):
        for _ in range(n):
            to = min(ratios, key=lambda k: (rare_load[k] / rare_goal[k] if rare else 0, load[k] / goal[k], ORDER.index(k)))
            load[to] += size
            rare_load[to] += rare
    return load


@pytest.mark.parametrize("seed", range(12))
def test_quotas_are_those_of_placing_one_by_one(seed):
    rng = random.Random(seed)
    classes = {(rng.randrange(1, 300), 0): rng.choice([1, 2, 40, 3000]) for _ in range(rng.randrange(1, 25))}
    for _ in range(rng.randrange(5)):
        size = rng.randrange(1, 90)
        classes[size, rng.randrange(1, size + 1)] = rng.choice([1, 7, 1500])
    rows = [(s, r, n) for (s, r), n in classes.items()]
    ratios = {"train": 0.8, "val": 0.1, "test": 0.1}
    found = S.quotas(rows, ratios, ORDER)
    held, load = Counter(), Counter()
    for size, rare, split, low, high in found:
        held[size, rare] += high - low
        load[split] += size * (high - low)
    assert held == Counter(classes)
    want = one_by_one(rows, ratios)
    # Ties of the level go either way by at most one item of the largest size.
    assert all(abs(load[k] - want[k]) <= 2 * max(s for s, _, _ in rows) for k in ratios)
    assert sum(load.values()) == sum(want.values())


def test_ranks_are_exact_and_in_parts(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(1000)], "id long, g int")
    counts = rows.groupBy("g").count().withColumnRenamed("count", "n")
    for per_part in (10, 10_000):
        got = [(r["g"], r["rank"], r["id"]) for r in S.hash_ranked(rows, ["g"], "id", counts, per_part=per_part).collect()]
        for g in range(3):
            assert sorted(r for x, r, _ in got if x == g) == list(range(sum(1 for i in range(1000) if i % 3 == g)))
        placed = {i: (g, r) for g, r, i in got}
        if per_part == 10:
            first = placed
    assert first == placed


def test_splits_keep_components_whole_and_close_to_the_shares(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([1, 1, 1, 2, 9]), rng.randrange(2)) for i in range(3000)] + [(9000, 800, 0)]
    df = spark.createDataFrame(sizes, "component long, size long, rare long")
    got = {r["component"]: r["split"] for r in S.greedy_splits(df, {"train": 0.8, "val": 0.1, "test": 0.1}, rare="rare").collect()}
    assert len(got) == len(sizes)
    share = Counter()
    for c, n, _ in sizes:
        share[got[c]] += n
    total = sum(share.values())
    assert abs(share["val"] / total - 0.1) < 0.01 and abs(share["test"] / total - 0.1) < 0.01
    assert S.greedy_splits(df.limit(0), {"train": 0.9, "test": 0.1}).count() == 0
