"""Subject areas of documents by class-association rules.

Rules "these words near one another -> this area" are mined by parallel frequent-pattern growth from the
sentences of labelled documents and pruned where any shorter rule in them says as much. Documents held out from
mining calibrate them: how often rules of a stated confidence are right there is what they weigh, and
the shares of a document that make an area a substantial part are those that fit its labels best. A
document is scored sentence by sentence, so that an area counts by how much of the document it makes up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import cut, release
from ._text import words_of

LABELLED = 20_000  # documents with labels to learn from, at most
HELD_OUT = 5  # every so many of them calibrate
WINDOW = 8  # telling words in a row that make a transaction; a longer sentence makes several
SUPPORT = 3  # documents with a word, transactions with a rule
LIKELY = 0.5  # least share of a word's documents, or a rule's transactions, in its area
SURE_RULE = 0.55  # least smoothed share: a rule that happened to be met in one area only a few times is no rule
GAIN = 0.05  # by which a rule must be surer than every shorter one in it
EVIDENCE = 1.0  # least log-odds of a sentence's area
WHOLE, AMONG = 0.14, 0.18  # least share of all sentences, and of those with an area, where nothing is held out
BINS = 20
_CLASS = "\x01"
_END = re.compile(r"[.!?\n]+")


def sentences(text: str | None) -> list[list[str]]:
    """Sentences of at least two words."""
    found = (words_of(s) for s in _END.split(text or ""))
    return [w for w in found if len(w) > 1]


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(i, s, list(dict.fromkeys(w))) for i, s, t in zip(batch["doc_id"], batch["subject"], batch["text"]) for w in sentences(t)]
        yield pd.DataFrame(out, columns=["doc_id", "subject", "bag"])


class Rules:
    """Pruned rules, ready to score sentences; ``rows`` are words, area and smoothed confidence."""

    def __init__(self, areas: list[str], rows: list[tuple[tuple[str, ...], str, float]]):
        self.areas, self.rows = areas, rows
        self.whole, self.among = WHOLE, AMONG
        self.weigh(lambda confidence: confidence)

    def weigh(self, chance) -> None:
        """Weights from the chance that a rule of a stated confidence is right, against that of any other area."""
        number = {a: i for i, a in enumerate(self.areas)}
        self.single: dict[str, list[tuple[int, float, int]]] = {}
        self.joint: dict[str, list[tuple[frozenset, int, float, int]]] = {}
        for words, area, confidence in self.rows:
            right = min(max(chance(confidence), 0.01), 0.999)
            weight = float(np.log(right / (1 - right) * max(1, len(self.areas) - 1)))
            band = min(BINS - 1, int(confidence * BINS))
            if weight <= 0:
                continue
            if len(words) == 1:
                self.single.setdefault(words[0], []).append((number[area], weight, band))
            else:
                self.joint.setdefault(min(words), []).append((frozenset(words), number[area], weight, band))

    def matches(self, bag: set[str]) -> Iterator[tuple[int, float, int]]:
        """Area, weight and confidence band of every rule that holds in a sentence."""
        for w in bag:
            yield from self.single.get(w, ())
            for need, area, weight, band in self.joint.get(w, ()):
                if need <= bag:
                    yield area, weight, band

    def shares(self, text: str | None) -> tuple[np.ndarray, int]:
        """Sentences per area, and sentences in all."""
        counts = np.zeros(len(self.areas))
        said = sentences(text)
        for words in said:
            evidence: dict[int, float] = {}
            for area, weight, _ in self.matches(set(words)):
                evidence[area] = evidence.get(area, 0.0) + weight
            if evidence:
                best = min(evidence, key=lambda a: (-evidence[a], a))
                if evidence[best] >= EVIDENCE:
                    counts[best] += 1
        return counts, len(said)


def transactions_of(said: list[str], telling) -> list[list[str]]:
    """The telling words of a sentence in the order they are said, at most WINDOW to a transaction, none left out."""
    kept = list(dict.fromkeys(w for w in said if w in telling))
    return [kept[k : k + WINDOW] for k in range(0, len(kept), WINDOW)]


def pruned(found: dict[tuple[tuple[str, ...], str], tuple[float, float]]) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules (words, area, smoothed confidence) that are surer than every shorter rule for the area within them."""
    out = []
    for (words, area), (confidence, smoothed) in found.items():
        if smoothed < SURE_RULE:
            continue
        shorter = (found.get((part, area)) for k in range(1, len(words)) for part in combinations(words, k))
        if all(x is None or confidence > x[0] + GAIN for x in shorter):
            out.append((words, area, smoothed))
    return out


def mine(labelled: DataFrame, areas: list[str]) -> Rules:
    """Rules from ``doc_id, subject, text`` rows, one area each; their number is bounded by that of the documents."""
    bags = cut(labelled.mapInPandas(_bags, "doc_id long, subject string, bag array<string>"), "bags")
    sizes = {r["subject"]: r["n"] for r in bags.groupBy("subject").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if not sizes:
        return Rules(areas, [])
    # A word tells something if one area has most of it, areas of different size made equal.
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    met = bags.select("doc_id", "subject", F.explode("bag").alias("w")).distinct()
    rate = met.groupBy("w", "subject").agg(F.count("*").alias("n"))
    rate = rate.withColumn("r", F.col("n") / size[F.col("subject")])
    told = rate.groupBy("w").agg(F.sum("n").alias("n"), (F.max("r") / F.sum("r")).alias("top"))
    telling = {r["w"] for r in told.where((F.col("n") >= SUPPORT) & (F.col("top") >= LIKELY)).select("w").collect()}

    def items(batches):
        for batch in batches:
            yield pd.DataFrame({"items": [t + [_CLASS + s] for bag, s in zip(batch["bag"], batch["subject"]) for t in transactions_of(bag, telling)]})

    # The same sentence in several copies is one observation.
    once = bags.select("subject", "bag").distinct()
    transactions = cut(once.mapInPandas(items, "items array<string>"), "transactions")
    n = transactions.count()
    if not n:
        return Rules(areas, [])
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, SUPPORT / n), minConfidence=LIKELY).fit(transactions)
    kept = model.associationRules.where(F.col("consequent")[0].startswith(_CLASS) & ~F.exists("antecedent", lambda x: x.startswith(_CLASS)))
    found = {}
    for r in kept.select("antecedent", "consequent", "confidence", "support").collect():
        both = r["support"] * n
        alone = both / r["confidence"]
        found[tuple(sorted(r["antecedent"])), r["consequent"][0][1:]] = (r["confidence"], (both + 0.5) / (alone + 0.5 * max(2, len(areas))))
    for done in (bags, transactions):
        release(done)
    return Rules(areas, pruned(found))


def monotone(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares right / total made non-decreasing by pooling neighbours; empty places take the one before."""
    blocks: list[list[float]] = []
    for r, t in zip(right, total):
        blocks.append([float(r), float(t), 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-9) > blocks[-1][0] * max(blocks[-2][1], 1e-9):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), r / t if t else 0.0) for r, t, k in blocks])


def calibrate(rules: Rules, held: DataFrame) -> None:
    """Set the weights and the shares by held-out ``doc_id, subjects, text``; without any they stay as they are.

    What reaches the driver is a row per confidence band and one per held-out document.
    """
    number = {a: i for i, a in enumerate(rules.areas)}
    known = held.sparkSession.sparkContext.broadcast(rules)

    def bands(batches):
        right, total = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            for subjects, text in zip(batch["subjects"], batch["text"]):
                mine_ = {number[s] for s in subjects}
                for said in sentences(text):
                    for area, _, band in known.value.matches(set(said)):
                        total[band] += 1
                        right[band] += area in mine_
        yield pd.DataFrame({"band": np.arange(BINS), "r": right, "t": total})

    rows = held.mapInPandas(bands, "band int, r double, t double").groupBy("band").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).collect()
    if not sum(r["t"] for r in rows):
        return
    right, total = np.zeros(BINS), np.zeros(BINS)
    for r in rows:
        right[r["band"]], total[r["band"]] = r["r"], r["t"]
    # A band seldom met stays near its own confidence.
    middle = (np.arange(BINS) + 0.5) / BINS
    chance = monotone(right + 10 * middle, total + 10)
    rules.weigh(lambda confidence: chance[min(BINS - 1, int(confidence * BINS))])

    known = held.sparkSession.sparkContext.broadcast(rules)

    def counted(batches):
        for batch in batches:
            out = []
            for subjects, text in zip(batch["subjects"], batch["text"]):
                counts, n = known.value.shares(text)
                out.append(([int(a in subjects) for a in known.value.areas], (counts / max(n, 1)).tolist(), (counts / max(counts.sum(), 1)).tolist()))
            yield pd.DataFrame(out, columns=["is", "whole", "among"])

    sample = held.mapInPandas(counted, "is array<int>, whole array<double>, among array<double>").toPandas()
    rules.whole, rules.among = best_shares(*(np.stack(sample[c].map(np.asarray)) for c in ("is", "whole", "among")))


def best_shares(labelled: np.ndarray, whole: np.ndarray, among: np.ndarray) -> tuple[float, float]:
    """Least shares of all sentences and of those with an area that agree best (F1) with the labels.

    Of all that come within a thousandth of the best, the one in the middle.
    """
    grid = [(w, a) for w in np.arange(0.08, 0.27, 0.02) for a in np.arange(0.08, 0.35, 0.02)]
    score = []
    for w, a in grid:
        given = (whole >= w) & (among >= a)
        both = (given & (labelled > 0)).sum()
        score.append(2 * both / max(1, given.sum() + (labelled > 0).sum()))
    near = np.array([g for g, x in zip(grid, score) if x >= max(score) - 0.001])
    centre = near.mean(axis=0)
    w, a = near[np.argmin(((near - centre) ** 2).sum(axis=1))]
    return float(w), float(a)


def _score(rules):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = rules.value
        for batch in batches:
            out = []
            for id, text in zip(batch["doc_id"], batch["text"]):
                counts, n = known.shares(text)
                total = counts.sum()
                for k in np.flatnonzero(counts):
                    if counts[k] >= known.whole * n and counts[k] >= known.among * total:
                        out.append((id, known.areas[k], counts[k] / n, counts[k] / total))
            yield pd.DataFrame(out, columns=["doc_id", "subject", "whole", "among"])

    return run


def learn(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> Rules:
    """Rules mined from at most LABELLED labelled documents, of which every HELD_OUT-th calibrates instead."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    areas = sorted(r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect())
    known = labels.where(F.col("subject").isin(areas) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "subject")
    chosen = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    sample = cut(docs.join(F.broadcast(chosen), "doc_id"), "labelled")
    held = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(HELD_OUT)) == 0
    rules = mine(sample.where(~held & (F.size("subjects") == 1)).select("doc_id", F.col("subjects")[0].alias("subject"), "text"), areas)
    calibrate(rules, sample.where(held))
    release(sample)
    return rules


def subject_areas(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, subject, whole, among``: areas that make up a substantial part of each document.

    ``whole`` and ``among`` are an area's share of all sentences and of those with any area. Learning uses
    at most LABELLED labelled documents, chosen by hash, and of those with one area only for mining; scoring reads
    every document whole. Null ids or texts, empty texts, labels of unknown subjects or documents: no row;
    repeated labels count once; without labels the result is empty.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    rules = documents.sparkSession.sparkContext.broadcast(learn(documents, subjects, labels))
    return docs.mapInPandas(_score(rules), "doc_id long, subject string, whole double, among double")


def composition(found: DataFrame, documents: DataFrame, by: str = "source") -> DataFrame:
    """``source, subject, n_documents, share``: documents per subject; a null subject has those of no area."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(by).alias(by)).join(found.select("doc_id", "subject"), "doc_id", "left")
    totals = documents.groupBy(F.col(by).alias("t")).agg(F.count("*").alias("total"))
    per = rows.groupBy(by, "subject").agg(F.count_distinct("doc_id").alias("n_documents"))
    joined = per.join(totals, F.col(by).eqNullSafe(F.col("t")))
    return joined.select(by, "subject", "n_documents", F.round(F.col("n_documents") / F.col("total"), 6).alias("share"))
