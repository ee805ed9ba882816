"""Evaluation passages in training documents: rare n-gram seeds, then Smith-Waterman alignment.

Documents are read once for seeds: their n-grams pass a bit filter of the passages' n-grams, of bounded size
however many passages there are, and what passes is joined with the passages on the n-gram itself. Seeds on
neighbouring diagonals make stretches, and every stretch that may hold a copy is aligned word by word. Only
documents with such a stretch are read a second time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import cut, release
from ..operators.skew import join_by_size, lookup
from ._text import mix, words

SEED = 4  # words
RARE_SHARE, RARE_LEAST = 0.002, 20
SHARED_SHARE, SHARED_LEAST, SHARED_RUN = 0.02, 3, 6
STOCK_RUN = 8  # seeds in a row
SCORE = 23.0  # of the alignment; a word that agrees counts 2
SHORT = 0.9  # of the best score a passage can have, where that is less
MATCH, MISMATCH, GAP, SLACK = 2.0, -1.0, 1.0, 12
ALIKE, STOCK = 0.75, 0.5  # of a match: a word one edit apart, a word of a stock phrase
BITS_PER_SEED, BITS_MOST = 32, 1 << 29

_HYPHEN = r"(?<=\p{L})[-\u2010]\s*\n\s*(?=\p{L})"
_MARKUP = r"<[^<>\n]{0,60}>|&(?:[a-zA-Z]{2,8}|#[0-9]{1,6});"


def plain_words(text: Column) -> Column:
    """Words of a text without markup and without the hyphens that break words at line ends."""
    return words(F.regexp_replace(F.regexp_replace(text, _HYPHEN, ""), _MARKUP, " "))


def grams(h: np.ndarray, k: int = SEED) -> np.ndarray:
    """The hash of ``k`` words in a row, at each place."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * np.uint64(3) + h[i : i + n])
    return out


class Filter:
    """A set of hashes as bits: two per hash. It may let others pass, but never stops one of its own."""

    def __init__(self, n_bits: int):
        self.mask = np.uint64(n_bits - 1)
        self.bits = np.zeros(n_bits // 8, np.uint8)

    @staticmethod
    def size_for(n: int, most: int = BITS_MOST) -> int:
        return min(most, 1 << max(6, int(n * BITS_PER_SEED - 1).bit_length()))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes & self.mask).astype(np.int64), ((hashes >> np.uint64(32)) & self.mask).astype(np.int64)

    def add_words(self, at: np.ndarray, bits: np.ndarray) -> None:
        self.bits.view(np.int64)[at] = bits

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in self.places(hashes):
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _filter_of(seeds: DataFrame, n: int, most: int) -> Filter:
    """The filter of the column ``g``. Tasks send words of bits that are set, at most as many as the filter has."""
    out = Filter(Filter.size_for(n, most))
    mask = int(out.mask)
    place = F.explode(F.array(F.col("g").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("g", 32).bitwiseAND(F.lit(mask))))
    bits = seeds.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63L AS INT))")).alias("bits"))
    rows = bits.toPandas()
    out.add_words(rows["w"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))
    return out


def _passages(shared: np.ndarray):
    """For mapInPandas: what each passage has; an instruction line, a long run of seeds that many passages share, is blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blanks, seeds = [], []
            for h in batch["h"]:
                g = grams(np.asarray(h, np.int64).view(np.uint64))
                common = np.isin(g, shared)
                blank = np.zeros(len(h), bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], common.astype(np.int8), [0]])))
                for s, e in zip(edges[::2], edges[1::2]):
                    if e - s >= SHARED_RUN:
                        blank[s : e + SEED - 1] = True
                blanks.append(blank.tolist())
                inside = [p for p in range(len(g)) if not blank[p : p + SEED].any()]
                seeds.append([{"place": p, "g": int(x)} for p, x in zip(inside, g[inside].view(np.int64))] if inside else [])
            yield pd.DataFrame({"item": batch["item"], "words": batch["words"], "blank": blanks, "seeds": seeds})

    return run


def _hits(filter_):
    """For mapInPandas: the n-grams of documents that pass the filter; ``first`` marks the first of its kind in a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = filter_.value
        for batch in batches:
            ids, ats, found, firsts = [], [], [], []
            for id, h in zip(batch["id"], batch["h"]):
                g = grams(np.asarray(h, np.int64).view(np.uint64))
                at = np.flatnonzero(wanted.passes(g)) if len(g) else ()
                if len(at):
                    first = np.zeros(len(at), bool)
                    first[np.unique(g[at], return_index=True)[1]] = True
                    ids.append(np.full(len(at), id))
                    ats.append(at)
                    found.append(g[at].view(np.int64))
                    firsts.append(first)
            if ids:
                yield pd.DataFrame({"doc": np.concatenate(ids), "at": np.concatenate(ats), "g": np.concatenate(found), "first": np.concatenate(firsts)})

    return run


def worth(blank, common) -> np.ndarray:
    """What each word of a passage earns: nothing in instruction lines, little in stock phrases.

    A stock phrase is a short run of common seeds. A long one is a passage that many documents hold.
    """
    value = np.where(np.asarray(blank, bool), 0.0, MATCH)
    flags = np.zeros(len(value) + 1, np.int8)
    flags[np.asarray(common, np.int64)] = 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
    for s, e in zip(edges[::2], edges[1::2]):
        if e - s <= STOCK_RUN:
            value[s : e + SEED - 1] = np.minimum(value[s : e + SEED - 1], MATCH * STOCK)
    return value


def alike(a: str, b: str) -> bool:
    """The words differ by one edit or by two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    low, n = 0, min(len(a), len(b))
    while low < n and a[low] == b[low]:
        low += 1
    x, y = a[low:], b[low:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _shortened(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word}


class Spellings:
    """Words of a passage by their shortened forms, to find the one that a miswritten word stands for."""

    def __init__(self, item: list[str]):
        self.number = {w: n for n, w in enumerate(dict.fromkeys(item))}
        self.forms: dict[str, list[str]] = {}
        for w in self.number:
            if len(w) > 3:
                for form in _shortened(w):
                    self.forms.setdefault(form, []).append(w)
        self.seen: dict[str, int] = {}

    def near(self, word: str) -> int:
        """Number of a word of the passage one edit away, or -1."""
        if word not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            forms = _shortened(word) if len(word) > 3 else ()
            met = [self.number[x] for form in forms for x in self.forms.get(form, ()) if alike(word, x)]
            self.seen[word] = min(met, default=-1)
        return self.seen[word]


def align(item: list[str], value: np.ndarray, docs: list[list[str]], spellings: Spellings | None = None) -> np.ndarray:
    """Best local alignment score of a passage, whose words have a ``value`` each, with each of several stretches of documents.

    The stretches are aligned side by side, shorter ones filled up with words that match nothing.
    """
    spellings = spellings or Spellings(item)
    number = spellings.number
    width = max((len(d) for d in docs), default=0)
    codes, degree = np.full((len(docs), width), -1), np.ones((len(docs), width))
    for k, doc in enumerate(docs):
        for j, w in enumerate(doc):
            if w in number:
                codes[k, j] = number[w]
            else:
                codes[k, j], degree[k, j] = spellings.near(w), ALIKE
    best, h = np.zeros(len(docs)), np.zeros((len(docs), width + 1))
    slope = GAP * np.arange(width + 1)
    for i, w in enumerate(item):
        diagonal = h[:, :-1] + np.where(codes == number[w], value[i] * degree, MISMATCH)
        h = np.maximum(h - GAP, 0.0)
        h[:, 1:] = np.maximum(h[:, 1:], diagonal)
        h += slope
        np.maximum.accumulate(h, axis=1, out=h)
        h -= slope
        np.maximum(best, h.max(axis=1), out=best)
    return best


def side_by_side(lengths: np.ndarray, most: int = 50_000) -> Iterator[np.ndarray]:
    """Places of stretches to align together: of similar length, about ``most`` words in all with what fills them up."""
    order = np.argsort(lengths, kind="stable")
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * lengths[order[high]] <= most:
            high += 1
        yield order[low:high]
        low = high


def _aligned(least: float):
    """For mapInPandas: the score of each stretch that reaches what its passage asks for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple] = {}
        for batch in batches:
            out = []
            for item, rows in batch.groupby("item"):
                if item not in known:
                    if len(known) >= 1000:
                        known.clear()
                    passage, value = list(rows["words"].iloc[0]), worth(rows["blank"].iloc[0], rows["common"].iloc[0])
                    known[item] = (passage, value, Spellings(passage), min(least, SHORT * float(value.sum())))
                passage, value, spellings, need = known[item]
                said, docs = [list(x) for x in rows["said"]], rows["doc"].to_numpy()
                for at in side_by_side(np.array([len(x) for x in said])):
                    score = align(passage, value, [said[k] for k in at], spellings)
                    out += [(docs[k], item, x) for k, x in zip(at, score) if x >= need]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score"])

    return run


def stretches(matched: DataFrame) -> DataFrame:
    """``doc, item, low, high``: stretches of documents to align, from rows ``doc, item, length, at, place, rare``.

    A document and a passage go together if they share several rare seeds or, however common the seeds, many in
    a row: a passage that a large part of all documents contains has no rare seed, a stock phrase is too
    short for the other. Then every stretch is aligned that has a rare seed or some seeds in a row.
    """
    rows = matched.withColumn("d", F.col("at") - F.col("place"))
    # Before any row moves: without two rare seeds, half of the seeds in a row lie in one of two neighbouring bands.
    bands = rows.groupBy("doc", "item", F.floor(F.col("d") / (SLACK + 1)).alias("b")).agg(F.count_if("rare").alias("r"), F.count("*").alias("c"))
    likely = cut(bands.groupBy("doc", "item").agg(F.sum("r").alias("r"), F.max("c").alias("c")).where("r >= 2 OR c >= 4").select("doc", "item"), "likely")
    rows = join_by_size(rows, likely, ["doc", "item"], "left_semi")
    both = Window.partitionBy("doc", "item")
    band = both.orderBy("d").rangeBetween(0, SLACK)
    rows = rows.withColumn("row", F.size(F.collect_set("place").over(band))).withColumn("scarce", F.size(F.collect_set(F.when(F.col("rare"), F.col("place"))).over(both)))
    rows = rows.withColumn("most", F.max("row").over(both)).where("scarce >= 3 OR (scarce >= 2 AND most >= 4) OR most >= 8")
    # Seeds whose stretches overlap belong to one.
    far = F.col("d") - F.lag("d").over(both.orderBy("d")) > F.col("length") + 2 * SLACK
    rows = rows.withColumn("new", F.coalesce(far, F.lit(False)).cast("int")).withColumn("island", F.sum("new").over(both.orderBy("d")))
    per = rows.groupBy("doc", "item", "island").agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.max("length").alias("length"), F.max("rare").alias("rare"), F.max("row").alias("row")
    )
    return per.where("rare OR row >= 4").select(
        "doc", "item", F.greatest(F.lit(0), F.col("first") - SLACK).alias("low"), (F.col("last") + F.col("length") + SLACK).alias("high")
    )


def leaks(documents: DataFrame, items: DataFrame, least: float = SCORE, most_bits: int = BITS_MOST) -> DataFrame:
    """``doc_id, item_id, score``: documents and the passages they contain, fully or partly, also altered.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, passage``. Seeds that many passages share
    begin nothing, and longer runs of them (instruction lines) earn nothing in an alignment. ``least`` is the
    score of about twelve equal words; a passage that cannot reach it must be there nearly whole. Null ids, null,
    empty or wordless texts match nothing, passages shorter than a seed neither; of repeated ids the best
    score counts; empty tables give an empty result. ``most_bits`` bounds the filter sent to all tasks, not the result.
    """
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item"), plain_words(F.col("passage")).alias("words")).where("item IS NOT NULL AND size(words) > 0")
    asked = asked.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    n_items, n_docs = asked.count(), docs.count()

    def own_grams(batches):
        for batch in batches:
            found = [np.unique(grams(np.asarray(h, np.int64).view(np.uint64))).view(np.int64) for h in batch["h"]]
            yield pd.DataFrame({"g": np.concatenate(found or [np.empty(0, np.int64)])})

    often = asked.select("h").mapInPandas(own_grams, "g long").groupBy("g").count().where(F.col("count") >= max(SHARED_LEAST, SHARED_SHARE * n_items))
    shared = np.array([r["g"] for r in often.collect()], np.int64).view(np.uint64)  # at most 1 / SHARED_SHARE times a passage's length
    passages = cut(
        asked.mapInPandas(_passages(shared), "item long, words array<string>, blank array<boolean>, seeds array<struct<place:int,g:long>>"), "passages"
    )
    seeds = passages.select("item", F.size("words").alias("length"), F.explode("seeds").alias("x")).select("item", "length", "x.place", "x.g")
    filter_ = spark.sparkContext.broadcast(_filter_of(seeds, seeds.count(), most_bits))
    hashed = docs.select("id", F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    hits = cut(hashed.mapInPandas(_hits(filter_), "doc long, at int, g long, first boolean"), "seed-hits")
    met = hits.groupBy("g").agg(F.count("*").alias("n"), F.count_if("first").alias("n_docs"))
    rare = F.col("n_docs") <= max(RARE_LEAST, RARE_SHARE * n_docs)
    entries = seeds.groupBy("g").agg(F.collect_list(F.struct("item", "length", "place")).alias("entries"))
    met = cut(met.join(entries, "g").select("g", "n", rare.alias("rare"), "entries"), "seeds-met")
    matched = lookup(hits, met, "g", "n").select("doc", "at", "rare", F.explode("entries").alias("x")).select("doc", "at", "rare", "x.item", "x.length", "x.place")
    found = cut(stretches(matched), "stretches")
    release(hits)

    # The documents of the stretches, and what their passages are worth.
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("item", "low", "high")).alias("parts"))
    said = join_by_size(docs.withColumnRenamed("id", "doc"), per_doc, "doc").select("doc", plain_words(F.col("text")).alias("said"), "parts")
    said = said.select("doc", "said", F.explode("parts").alias("x"))
    said = said.select("doc", "x.item", F.slice("said", F.col("x.low") + 1, F.col("x.high") - F.col("x.low")).alias("said"))
    stock = met.where("NOT rare").select(F.explode("entries").alias("x")).groupBy("x.item").agg(F.collect_set("x.place").alias("common"))
    sizes = found.groupBy("item").agg(F.count("*").alias("n"))
    worthy = passages.select("item", "words", "blank").join(sizes, "item").join(stock, "item", "left")
    worthy = cut(worthy.select("item", "n", "words", "blank", F.coalesce("common", F.array().cast("array<int>")).alias("common")), "worthy")
    rows = lookup(said, worthy, "item", "n").select("doc", "item", "said", "words", "blank", "common")
    scored = rows.mapInPandas(_aligned(least), "doc_id long, item_id long, score double")
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
