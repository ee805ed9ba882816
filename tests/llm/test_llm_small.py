"""Edge cases and brute-force comparisons on small tables."""

import collections
import heapq
import itertools
import random

import numpy as np
import pytest

from maskloom.llm import consensus, leakage, names, neardup, overlap, packing, splits, subjects

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("lan", "mit", "rok", "sen", "tur")]
TEXT = "id long, dataset_id long, source_id string, original_text string, summary string, extra string"
MENTION = "id long, entity_id long, text_id long, full_context string"
ENTITY = "id long, surface string, heuristic_group string, heuristic_type string, observed_types_json string, extra long"


def story(seed, n=60):
    return random.Random(seed).choices(WORDS, k=n)


def edited(words, seed, edits=3):
    rng, out = random.Random(seed), list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    out.insert(rng.randrange(len(out)), rng.choice(WORDS))
    return out


# --- p6 ---------------------------------------------------------------------------------------------


def test_bit_sliced_distances_equal_popcounts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (1, 32), dtype=np.uint8)
    prints = np.where(rng.random((330, 32)) < 0.5, base, rng.integers(0, 256, (330, 32), dtype=np.uint8)).astype(np.uint8)
    bucket = np.sort(rng.integers(0, 40, 330))
    bucket[:150] = bucket[0]  # one wide bucket
    distance = np.unpackbits(prints[:, None, :] ^ prints[None, :, :], axis=2).sum(axis=2)
    for radius in (0, 60, 96, 256):
        i, j = neardup.near_pairs(bucket, prints, radius)
        want = {(a, b) for a, b in itertools.combinations(range(330), 2) if bucket[a] == bucket[b] and distance[a, b] <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want
    assert len(neardup.near_pairs(bucket[:0], prints[:0])[0]) == 0


def near_rows():
    s = [story(i) for i in range(6)]
    rows = [(i, 1, None, " ".join(s[i]), f"own summary of story number {i} with some words more", "x") for i in range(4)]
    rows += [(10, 1, None, " ".join(edited(s[0], 1)).upper(), None, "x"), (11, 1, None, " ".join(s[0]), "No summary.", "x")]
    rows += [(12, 1, None, " ".join(s[1][30:] + s[1][:30]), "", "x")]  # reordered
    rows += [(20, 1, None, None, " ".join(story(50, 20)), "x"), (21, 1, None, " ".join(story(51)), " ".join(story(50, 20)), "x")]
    rows += [(22, 1, None, None, "No summary.", "x"), (23, 1, None, None, None, "x"), (24, 1, None, "", "", "x"), (25, 1, None, "... !", None, "x")]
    return rows


def test_near_duplicates_by_body_or_stand_in(spark):
    members, found = neardup.near_duplicates(spark.createDataFrame(near_rows(), TEXT))
    got = {tuple(r) for r in neardup.all_pairs(members, found).collect()}
    assert got == {(0, 10), (0, 11), (10, 11), (1, 12), (20, 21)}
    rows = {r["text_id"]: r for r in neardup.per_text(spark.createDataFrame(near_rows(), TEXT), members, found).collect()}
    assert len(rows) == len(near_rows())
    assert (rows[0]["class_id"], rows[0]["n_copies"], rows[0]["n_links"]) == (0, 2, 1)
    assert rows[23]["n_links"] == 0


def test_short_stand_ins_with_wording_of_their_own_are_linked(spark):
    short = "Tollomp council rejects bridge tax"  # fewer than eight words
    rows = [(1, 1, None, None, short, "x"), (2, 1, None, None, short.upper() + ".", "x"), (3, 1, None, " ".join(story(1)), short, "x")]
    rows += [(4, 1, None, None, "Summary not available.", "x"), (5, 1, None, None, "summary NOT available", "x"), (6, 1, None, None, "See the full text for details.", "x")]
    rows += [(7, 1, None, None, "See the full text for details.", "x"), (8, 1, None, None, "Other wording altogether", "x")]
    got = {tuple(r) for r in neardup.all_pairs(*neardup.near_duplicates(spark.createDataFrame(rows, TEXT))).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_buckets_above_the_chunk_lose_nothing(spark):
    base = story(7, 80)
    rows = [(i, 1, None, " ".join(edited(base, i, 2)), None, "x") for i in range(60)]
    bodies = neardup.bodies_of(spark.createDataFrame(rows, TEXT))
    described = neardup.describe(bodies, neardup.classes(bodies))
    plain = {(r["a"], r["b"]) for r in neardup.links(described).collect()}
    assert plain == {(r["a"], r["b"]) for r in neardup.links(described, chunk=7).collect()}
    assert len(plain) > 1500


@pytest.mark.parametrize("n", [200, 2000])
def test_many_edited_copies_stay_linked(spark, n):
    base = story(8, 100)
    texts = [edited(base, i, 10) for i in range(n)]  # 10 % of the words
    code = {w: i for i, w in enumerate(WORDS)}
    sets = [{tuple(code[w] for w in t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    place = {x: k for k, x in enumerate(set().union(*sets))}
    has = np.zeros((n, len(place)), np.float32)
    for i, x in enumerate(sets):
        has[i, [place[y] for y in x]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    near = np.triu(both >= neardup.SIMILARITY * (size[:, None] + size - both), 1)
    _, found = neardup.near_duplicates(spark.createDataFrame([(i, 1, None, " ".join(t), None, "x") for i, t in enumerate(texts)], TEXT))
    got = found.select("a", "b").toPandas().to_numpy()
    assert near[got[:, 0], got[:, 1]].all() and len(got) > 0.98 * near.sum() and near.sum() > 0.4 * n * (n - 1) / 2


def test_bound_of_sketches_never_drops_a_pair():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 150, rng.integers(1, 2000))) for _ in range(60)] + [np.arange(40 * i, 40 * i + 90) for i in range(40)]
    sk, size = neardup.sketches(lists), np.array([len(x) for x in lists])
    i, j = map(np.array, zip(*itertools.combinations(range(100), 2)))
    true = np.array([len(np.intersect1d(lists[a], lists[b])) / len(np.union1d(lists[a], lists[b])) for a, b in zip(i, j)])
    may = neardup.may_reach(sk[i], sk[j], size[i], size[j], 0.3)
    assert may[true >= 0.3].all() and not may[true < 0.05].all()


def test_near_duplicates_of_nothing(spark):
    members, found = neardup.near_duplicates(spark.createDataFrame([], TEXT))
    assert members.count() == 0 and neardup.all_pairs(members, found).count() == 0


# --- p4 ---------------------------------------------------------------------------------------------


def test_overlap_across_splits_also_by_contexts(spark):
    s = [story(i + 100) for i in range(4)]
    datasets = spark.createDataFrame([(1, "a", "train"), (2, "a", "validation"), (3, "b", "Test ")], "id long, name string, split string")
    rows = [(1, 1, "ab-1", " ".join(s[0]), None, "x"), (2, 2, "ab-1", " ".join(edited(s[0], 5)), None, "x"), (3, 1, None, " ".join(s[0]), None, "x")]
    rows += [(4, 3, "ab_02", " ".join(s[0]).title(), None, "x"), (5, 2, "?", " ".join(s[1]), None, "x"), (6, 3, None, None, None, "x"), (7, 1, None, " ".join(s[2]), None, "x")]
    rows += [(8, 2, None, None, None, "x"), (9, 2, None, "", None, "x"), (None, 1, None, " ".join(s[1]), None, "x"), (10, 99, None, " ".join(s[1]), None, "x")]
    contexts = [" ".join(s[2][:35]) + " <mask> x", "y [MASK] " + " ".join(s[2][30:])]
    mentions = spark.createDataFrame([(i, 1, 6, c) for i, c in enumerate(contexts)] + [(7, 1, 6, ""), (8, 1, 6, None), (0, 1, 6, contexts[0])], MENTION)
    texts = spark.createDataFrame(rows, TEXT)
    members, found = overlap.overlaps(texts, datasets, mentions)
    got = {tuple(r) for r in overlap.all_pairs(members, found).collect()}
    assert got == {(1, 2), (3, 2), (1, 4), (3, 4), (7, 6)}
    report = {(r["split"], r["corpus"], r["feed"]): r["n_pairs"] for r in overlap.report(texts, datasets, members, found).collect()}
    assert report["validation", "a", "ab"] == 2 and report["Test ", "b", "ab"] == 2 and report["Test ", "b", "missing"] == 1


def test_overlap_join_equals_all_dot_products(spark):
    rng = random.Random(3)
    base = [story(i, 40) for i in range(5)]
    rows = [(i, 1 + i % 2, None, " ".join(edited(rng.choice(base), i, rng.randrange(1, 4))), None, "x") for i in range(60)]
    datasets = spark.createDataFrame([(1, "a", "train"), (2, "a", "test")], "id long, name string, split string")
    bodies = overlap.bodies_of(spark.createDataFrame(rows, TEXT), datasets, spark.createDataFrame([], MENTION)).cache()
    got = {(r["a"], r["b"]) for r in overlap.links(bodies, overlap.classes(bodies)).collect()}
    sets = {r["id"]: (r["train"], set(r["sh"])) for r in bodies.collect()}
    often = collections.Counter(h for _, s in sets.values() for h in s)
    w = {h: np.log1p(len(sets) / n) for h, n in often.items()}
    norm = {i: sum(w[h] ** 2 for h in s) ** 0.5 for i, (_, s) in sets.items()}
    want = {(a, b) for a, (t, x) in sets.items() for b, (u, y) in sets.items() if t and not u and sum(w[h] ** 2 for h in x & y) / norm[a] / norm[b] >= overlap.COSINE}
    assert got == want and 20 < len(want) < 900


def test_overlap_in_rounds_is_the_same(spark, monkeypatch):
    """Meetings grow with the square of a common term; those of one round are bounded."""
    rng = random.Random(4)
    base = [story(i, 40) for i in range(5)]
    rows = [(i, 1 + i % 2, None, " ".join(edited(rng.choice(base), i, rng.randrange(1, 4))), None, "x") for i in range(60)]
    datasets = spark.createDataFrame([(1, "a", "train"), (2, "a", "test")], "id long, name string, split string")
    bodies = overlap.bodies_of(spark.createDataFrame(rows, TEXT), datasets, spark.createDataFrame([], MENTION)).cache()
    want = {(r["a"], r["b"]) for r in overlap.links(bodies, overlap.classes(bodies)).collect()}
    asked = []
    rounds = overlap._rounds
    monkeypatch.setattr(overlap, "ROUND", 50)
    monkeypatch.setattr(overlap, "PER_ENTRY", 0)
    monkeypatch.setattr(overlap, "_rounds", lambda entries: asked.append(rounds(entries)) or asked[-1])
    got = {(r["a"], r["b"]) for r in overlap.links(bodies, overlap.classes(bodies)).collect()}
    assert got == want and len(want) > 20 and 1 < asked[0]


def test_overlap_of_a_large_edited_group(spark):
    base, formula = story(300, 100), story(301, 30)
    rows = [(i, 1 + i % 2, None, " ".join(edited(base, i, 10)), None, "x") for i in range(150)]  # 10 % of the words
    rows += [(i, 1 + i % 2, None, " ".join(formula + story(i, 70)), None, "x") for i in range(1000, 1100)]
    datasets = spark.createDataFrame([(1, "a", "train"), (2, "a", "test")], "id long, name string, split string")
    members, found = overlap.overlaps(spark.createDataFrame(rows, TEXT), datasets, spark.createDataFrame([], MENTION))
    got = {tuple(r) for r in overlap.all_pairs(members, found).collect()}
    assert all(a < 150 and b < 150 for a, b in got) and len(got) > 0.95 * 75 * 75


# --- p5 ---------------------------------------------------------------------------------------------


def test_tied_groups_and_splits(spark):
    texts = [(1, 1, "ABC-0007", None, None, "x"), (2, 1, " abc:7", None, None, "x"), (3, 1, "n/a", None, None, "x"), (4, 1, "n/a", None, None, "x"), (5, 1, "abc", None, None, "x"), (6, 1, "", None, None, "x")]
    entities = [(1, "A", "proper_name", "PERSON", None, 1), (2, "B", "numeric", "DATE", None, 1)]
    mentions = [(1, 1, 2, "c"), (2, 1, 3, "c"), (2, 1, 3, "c"), (3, 2, 4, "c"), (4, 2, 5, "c"), (5, None, 6, "c"), (6, 1, None, "c"), (7, 9, 6, "c"), (8, 1, 99, "c")]
    t, m, e = spark.createDataFrame(texts, TEXT), spark.createDataFrame(mentions, MENTION), spark.createDataFrame(entities, ENTITY)
    groups = splits.tied_groups(t, m, e)
    assert {tuple(r) for r in groups.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)}
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, target_share double")
    many = spark.createDataFrame([(i, i // 3 if i < 3000 else 9999) for i in range(4000)], "text_id long, group_id long")
    placed = splits.assign_splits(many, targets).collect()
    assert len({(r["group_id"], r["split"]) for r in placed}) == 1001
    share = sum(r["split"] == "train" for r in placed) / 4000
    assert abs(share - 0.8) < 0.03
    assert splits.assign_splits(many.limit(3), targets.limit(0)).first()["split"] is None
    assert splits.tied_groups(t.limit(0), m, e).count() == 0


# --- p3 ---------------------------------------------------------------------------------------------

JUDGED = "judgment_id long, pair_id string, annotator_id string, label string, score double"
DIRECTED = "judgment_id long, pair_id string, annotator_id string, a_to_b string, b_to_a string, preserves_meaning string, confidence double"


def test_consensus_weighs_annotators(spark):
    rng = random.Random(11)
    truth = {f"p{i}": rng.choice(["preserved", "changed", "changed"]) for i in range(300)}
    skill = {"good": 0.95, "fair": 0.85, "sound": 0.85, "bad": 0.35, "worse": 0.35, "poor": 0.35}
    rows = []
    for p, t in truth.items():
        for a, s in skill.items():
            rows.append((len(rows), p, a, t if rng.random() < s else rng.choice([x for x in consensus.LABELS if x != t]), 0.5))
    rows += rows[:40] + [(9001, "none", "good", "missing", None), (9002, "none", "fair", None, None), (9003, None, "good", "changed", 1.0)]
    judged, directed = spark.createDataFrame(rows, JUDGED), spark.createDataFrame([], DIRECTED)
    posterior, votes = consensus.truth_discovery(judged, directed)
    got = {r["pair_id"]: r["label"] for r in consensus.consensus(judged, posterior).collect()}
    assert set(got) == {*truth, "none"} and got["none"] == "uncertain"
    right = sum(got[p] == t for p, t in truth.items()) / len(truth)
    plain = 0
    for p, t in truth.items():
        count = collections.Counter(r[3] for r in rows[: len(truth) * len(skill)] if r[1] == p).most_common()
        plain += count[0][0] == t
    assert right > 0.88 and right > plain / len(truth) + 0.03
    rate = {r["annotator_id"]: r["reliability"] for r in consensus.annotators(votes, posterior).collect()}
    assert rate["good"] > rate["fair"] > rate["bad"]


def test_consensus_of_nothing_and_directions(spark):
    judged, directed = spark.createDataFrame([], JUDGED), spark.createDataFrame([], DIRECTED)
    posterior, _ = consensus.truth_discovery(judged, directed, 1)
    assert posterior.count() == 0 and consensus.agreement(judged, directed).first()["n_votes"] == 0
    rows = [(1, "p", "a", "entailment", "entailment", None, 0.9), (2, "p", "b", "entailment", "neutral", None, float("nan")), (3, "p", "c", None, None, "PRESERVED.", None)]
    labels = {r["annotator"]: (r["label"], r["how"]) for r in consensus.votes_of(judged, spark.createDataFrame(rows, DIRECTED)).collect()}
    assert labels == {"a": ("preserved", "directions-high"), "b": ("changed", "directions-none"), "c": ("preserved", "directions-none")}


# --- p7 ---------------------------------------------------------------------------------------------


def plain_packs(histogram, capacity):
    """Containers of the plain rule: longest item first, into the pack with most space, one by one."""
    space = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if space and -space[0] >= length:
                heapq.heapreplace(space, space[0] + length)
            else:
                heapq.heappush(space, length - capacity)
    return len(space)


HISTOGRAMS = [
    ({60: 1000, 7: 4000, 5: 2000}, 100), ({50: 1, 10: 5}, 100), ({700: 500, 30: 5000}, 1000), ({100: 3}, 100), ({1: 1001}, 100), ({}, 10),
    ({51: 400, 49: 399, 2: 300, 1: 7}, 100), ({34: 1000, 33: 1000}, 100), ({997: 40, 3: 500, 2: 1}, 1000),
]
for _seed in range(12):
    _rng = random.Random(_seed)
    _from = _rng.sample(range(1, 129), _rng.randrange(1, 60))
    HISTOGRAMS.append((dict(collections.Counter(_rng.choice(_from) for _ in range(3000))), 128))


@pytest.mark.parametrize("histogram, capacity", HISTOGRAMS)
def test_patterns_hold_every_item_once_in_as_many_packs_as_one_by_one(histogram, capacity):
    patterns = packing.shortest_pack_first(histogram, capacity)
    held = collections.Counter()
    for packs, pattern in patterns:
        assert packs > 0 and sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            held[n] += packs * k
    assert held == histogram
    assert sum(p for p, _ in patterns) == plain_packs(histogram, capacity)


def test_packing_is_repeatable_and_salts_change_nothing_but_places(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.choice([3, 3, 3, 40, 61, 150])) for i in range(900)], "doc_id long, n_tokens long")
    one = sorted(tuple(r) for r in packing.pack(df, 100).collect())
    assert one == sorted(tuple(r) for r in packing.pack(df.repartition(7), 100).collect())
    many = packing.pack(df, 100, per_salt=50).collect()
    assert len({r["container_id"] for r in many}) == len({r[0] for r in one})
    use = collections.Counter()
    for r in many:
        use[r["container_id"]] += r["n_tokens"]
    assert max(use.values()) <= 100 and sum(use.values()) == sum(r[4] for r in one)


def test_packing_places_all_and_splits_only_long_items(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(0, 90) for _ in range(400)] + [100, 200, 250, None, 0]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    rows = packing.pack(df, 100).collect()
    use, by_doc = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        use[r["container_id"]] += r["n_tokens"]
        by_doc[r["doc_id"]].append((r["token_start"], r["n_tokens"]))
    assert max(use.values()) <= 100
    for i, n in enumerate(sizes):
        parts = sorted(by_doc.get(i, []))
        assert sum(x for _, x in parts) == (n or 0) and (len(parts) <= 1 or n > 100)
        assert [a for a, _ in parts] == [100 * k for k in range(len(parts))]
    assert packing.pack(df.limit(0), 100).count() == 0


def test_tokens_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(1, "It's a test, isn't it?"), (2, None), (3, ""), (4, "ab " * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    assert got[2] == got[3] == 0 and got[1] == 9 and got[4] >= 5000


# --- p8 ---------------------------------------------------------------------------------------------


def test_leaks_fully_partly_altered_but_no_shared_lines(spark):
    line = "read the passage below and decide which of the two answers is the right one"
    items = [(i, line + ". " + " ".join(story(i + 300, 50))) for i in range(6)] + [(6, None), (7, ""), (None, "x y z w v")]
    bodies = [items[i][1].split(". ", 1)[1].split() for i in range(6)]
    rng = random.Random(1)
    typos = [w[:2] + w[3:] if rng.random() < 0.25 else w for w in bodies[2]]
    docs = [
        (1, " ".join(story(900, 80) + bodies[0] + story(901, 80))), (2, "<p>" + "&nbsp;".join(bodies[1][10:30]) + "</p> " + " ".join(story(902, 40))),
        (3, " ".join(story(903, 30) + typos).upper()), (4, line + " " + " ".join(story(904, 60))), (5, " ".join(bodies[3][:5])), (6, None), (7, ""),
        (8, " ".join(w[:3] + "-\n" + w[3:] if k % 3 == 0 else w for k, w in enumerate(bodies[4]))), (None, " ".join(bodies[5])),
    ]
    docs += [(100 + i, " ".join(bodies[5]) + f" w{i}") for i in range(60)]  # a passage that most documents hold
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    want = {(1, 0), (2, 1), (3, 2), (8, 4), *((100 + i, 5) for i in range(60))}
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, e).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, e, most_bits=64).collect()} == want
    assert leakage.leaks(d, e.limit(0)).count() == 0 and leakage.leaks(d.limit(0), e).count() == 0


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(2)
    for _ in range(20):
        a, *others = ([rng.choice(["one", "two", "six", "ten", "red"]) for _ in range(n)] for n in (12, 17, 5, 30, 0))
        value = np.array([rng.choice([0.0, 1.0, 2.0]) for _ in a])
        want = []
        for b in others:
            h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    h[i + 1][j + 1] = max(0, h[i][j] + (value[i] if x == y else leakage.MISMATCH), h[i][j + 1] - leakage.GAP, h[i + 1][j] - leakage.GAP)
            want.append(max(map(max, h)))
        assert leakage.align(a, value, others) == pytest.approx(want)


def test_stretches_side_by_side_are_all_there():
    lengths = np.array([5, 900, 3, 0, 40, 41, 39, 60000])
    parts = list(leakage.side_by_side(lengths, 100))
    assert sorted(np.concatenate(parts).tolist()) == list(range(8)) and all(len(p) == 1 or len(p) * lengths[p].max() <= 100 for p in parts)


# --- p9 ---------------------------------------------------------------------------------------------


def test_subject_areas_of_planted_vocabulary(spark):
    rng = random.Random(8)
    own = {"law": WORDS[:40], "sport": WORDS[40:80], "arts": WORDS[80:120]}
    common = WORDS[120:220]

    def text(areas, n=12):
        return ". ".join(" ".join(rng.choices(common, k=7) + (rng.choices(own[areas[k % len(areas)]], k=3) if areas else [])) for k in range(n)) + "."

    truth = {i: [("law",), ("sport",), ("arts",), ("law", "arts"), ()][i % 5] for i in range(150)}
    docs = spark.createDataFrame([(i, text(a)) for i, a in truth.items()] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = [(i, s, "a") for i, a in truth.items() if i < 80 for s in a] + [(0, "law", "b"), (2000, "law", "a"), (1, "unknown", "a"), (None, "law", "a")]
    labels = spark.createDataFrame(labels, "doc_id long, subject string, labeller string")
    areas = spark.createDataFrame([("law", ""), ("sport", ""), ("arts", ""), (None, "")], "subject string, description string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.subject_areas(docs, areas, labels).collect()}
    want = {(i, s) for i, a in truth.items() for s in a}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 3
    assert subjects.subject_areas(docs, areas, labels.limit(0)).count() == 0


# --- p2 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a, b", [
    ("Elizabeth Danflenbox", "Danflenbox, Liz"), ("Dr. Gregory Rilmbox", 'Gregory "Greg" Rilmbox'), ("Theodore K. Neltmung", "THEO NELTMUNG"),
    ("Kruxdolt-Optical Manufacturing (KOM)", "The Kruxdolt Optical Mfg Grp"), ("Department of Gasdan Sugar", "Sugar Department Gasdan"), ("Bürnmav Glass Bros. & Co.", "Burnmav Glass Brothers and Company"),
])
def test_rewritings_meet(a, b):
    assert names.rewrite(a)[0][:2] == names.rewrite(b)[0][:2]


def test_parties_link_variants_and_keep_others_apart(spark):
    people = ["Nicholas Flodbralm", "Nick Flodbralm", "N. Flodbralm", "Flodbralm, Nicholas", "Nicholas Flodbrlam", "Mr. Flodbralm", "Vincent Flodkuntrel", "Zishnelt Pharma Holdings Limited", "Zishnelt Pharma"]
    rows = [(i, s, "proper_name", "ORG" if "Zish" in s else "PERSON", None, i) for i, s in enumerate(people)]
    rows += [(50, "Port Flodbralm", "proper_name", "GPE", '{"GPE": 3}', 1), (51, None, "x", "PERSON", None, 1), (52, "", "x", "PERSON", None, 1), (53, "$12", "numeric", "MONEY", "{", 1)]
    cands = [(1, "ZPHL", 7), (2, "Rosemary Flodbralm", 0), (3, "zishnelt pharma ltd", 7), (3, "zishnelt pharma ltd", 7), (4, None, 1)]
    e, g = spark.createDataFrame(rows, ENTITY), spark.createDataFrame(cands, "candidate_id long, candidate string, entity_id long")
    groups = collections.defaultdict(set)
    for r in names.parties(e, g).collect():
        groups[r["party"]].add(r["name"])
    assert {frozenset(x) for x in groups.values() if len(x) > 1} == {frozenset({"e0", "e1", "e2", "e3", "e4", "e5"}), frozenset({"e7", "e8", "g1", "g3"})}
    assert names.pairs(names.parties(e.limit(0), g.limit(0))).count() == 0


def test_look_alike_letters_need_other_evidence(spark):
    people = ["John Kern", "John Kem", "3M Company", "Em Company", "Vera Bramdolt", "V. Bramdolt", "Ms. Bramdolt", "Vera Brarndolt", "Vera Bramd0lt"]
    e = spark.createDataFrame([(i, s, "proper_name", "ORG" if "Comp" in s else "PERSON", None, 1) for i, s in enumerate(people)] + [(20, "Vera Bramdolt", "x", "PERSON", None, 1)], ENTITY)
    g = spark.createDataFrame([(1, "Vera Bramdolt", 0)], "candidate_id long, candidate string, entity_id long")
    groups = collections.defaultdict(set)
    for r in names.parties(e, g).collect():
        groups[r["party"]].add(r["name"])
    assert {frozenset(x) for x in groups.values() if len(x) > 1} == {frozenset({"e4", "e5", "e6", "e7", "e8", "e20", "g1"})}


def test_a_form_that_several_parties_make_links_none(spark):
    people = ["Ted Brandolsk", "Edward Brandolsk", "Theodore Brandolsk", "Mr. Brandolsk", "Ted Karsund", "Edward Karsund"]
    e = spark.createDataFrame([(i, s, "proper_name", "PERSON", None, 1) for i, s in enumerate(people)], ENTITY)
    got = {tuple(r) for r in names.pairs(names.parties(e, spark.createDataFrame([], "candidate_id long, candidate string, entity_id long"))).collect()}
    assert got == {("e4", "e5")}
