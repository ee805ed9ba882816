"""Families of edited copies, small and large, against all pairs counted by brute force."""

import random

import numpy as np
import pytest

from maskloom.llm import neardup
from maskloom.llm._text import mix

TEXT = "id long, original_text string, summary string"


def family(seed, copies, change, words=60):
    """Copies of one text, each with a share of its words replaced by words of its own."""
    rng = random.Random(seed)
    base = [f"b{seed}x{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for c in range(copies):
        said = list(base)
        for at in rng.sample(range(words), round(words * change)):
            said[at] = f"c{seed}y{c}z{at}"
        out.append(" ".join(said))
    return out


def jaccard(texts):
    """All similarities of sets of three words in a row."""
    sets = [[" ".join(w[i : i + 3]) for i in range(len(w) - 2)] for w in (t.split() for t in texts)]
    number = {s: i for i, s in enumerate(sorted({s for x in sets for s in x}))}
    table = np.zeros((len(texts), len(number)), np.float32)
    for i, x in enumerate(sets):
        table[i, [number[s] for s in x]] = 1
    shared = table @ table.T
    size = table.sum(axis=1)
    return shared / (size[:, None] + size[None, :] - shared)


def links(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], TEXT).repartition(4)
    members, found = neardup.near_duplicates(df)
    pairs = neardup.all_pairs(members, found).toPandas()
    return set(zip(pairs["text_id_a"], pairs["text_id_b"]))


def recall(got, similarity, low, high):
    a, b = np.nonzero(np.triu((similarity >= low) & (similarity < high), 1))
    want = set(zip(a.tolist(), b.tolist()))
    return len(want), len(want & got) / max(1, len(want))


@pytest.mark.parametrize("copies, change", [(10, 0.02), (10, 0.12), (63, 0.02), (63, 0.10), (64, 0.02), (64, 0.10), (200, 0.02), (200, 0.08), (200, 0.15)])
def test_families_keep_their_links(spark, copies, change):
    texts = family(copies, copies, change) + family(1, 5, 0.05) + [" ".join(f"q{i}w{k}" for k in range(40)) for i in range(50)]
    similarity = jaccard(texts)
    got = links(spark, texts)
    n, share = recall(got, similarity, 0.35, 1.01)
    assert n >= 10 and share >= 0.998, (n, share)
    # Nothing below the threshold, and hardly anything lost right above it.
    assert all(similarity[a, b] >= neardup.SIMILARITY - 1e-6 for a, b in got)
    n, share = recall(got, similarity, neardup.SIMILARITY + 1e-6, 0.35)
    assert not n or share >= 0.97, (n, share)


def test_a_family_of_two_thousand_keeps_its_links(spark):
    texts = family(3, 2000, 0.04, 40)
    similarity = jaccard(texts)
    n, share = recall(links(spark, texts), similarity, 0.35, 1.01)
    assert n > 1_000_000 and share >= 0.998, (n, share)


def test_no_link_is_lost_however_few_shingles_are_shared(spark):
    """A fixed number of keys or a radius of fingerprints loses some of those close to the threshold."""
    texts = [t for k in range(12) for t in family(500 + k, 40, 0.05 + 0.015 * k, 50 + 40 * (k % 3))]
    similarity = jaccard(texts)
    a, b = np.nonzero(np.triu(similarity >= neardup.SIMILARITY - 1e-6, 1))
    assert (similarity[a, b] < 0.35).sum() > 300
    assert links(spark, texts) == set(zip(a.tolist(), b.tolist()))


def test_shingles_of_many_texts_meet_in_parts(spark):
    rows = [(i, t, None) for i, t in enumerate(family(9, 60, 0.04))]
    bodies = neardup.bodies_of(spark.createDataFrame(rows, TEXT))
    classes = neardup.classes(bodies)
    plain, parts = neardup.describe(bodies, classes), neardup.describe(bodies, classes, hot=4)
    assert parts.where("size(hot) > 0").count() > 0
    want = {(r["a"], r["b"]) for r in neardup.links(plain).collect()}
    assert len(want) > 1500 and want == {(r["a"], r["b"]) for r in neardup.links(parts, chunk=7).collect()}


def test_rounds_change_nothing(spark, monkeypatch):
    texts = family(10, 50, 0.06) + family(11, 20, 0.1)
    want = links(spark, texts)
    monkeypatch.setattr(neardup, "ROUND", 100)
    monkeypatch.setattr(neardup, "VERIFIED", 100)
    assert len(want) > 1000 and links(spark, texts) == want


def test_fingerprints_are_signs_of_sums_of_random_bits():
    rng = np.random.default_rng(2)
    lists = [rng.integers(-(2**62), 2**62, n) for n in (1, 2, 7, 0, 300)]
    got = np.unpackbits(neardup.fingerprints(lists), axis=1)
    for i, x in enumerate(lists):
        for b in range(0, neardup.BITS, 64):
            bits = np.unpackbits(mix(x.view(np.uint64) ^ np.uint64(b + 1)).view(np.uint8).reshape(-1, 8), axis=1)
            assert (got[i, b : b + 64] == (bits.sum(axis=0) * 2 > len(x))).all()
