"""Groups of near-duplicate texts by an exact join of their sets of word shingles.

Shingles are ordered from rare to common. Two sets that are similar enough have their rarest common one among
the first of both, as many as their sizes leave (prefix filter), so texts meet at those and nothing is
lost. What meets is dropped by sizes, ranks and a bit sketch only if it cannot be similar; the rest is checked on
the whole sets. All shingles count alike, however many texts have them: the wording of a group of many
edited copies is as common as a stock phrase. ``near_pairs`` compares fingerprints bit-sliced; the operator, which
may lose nothing, does not use it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import cut, release
from ..operators.skew import join_by_size, lookup
from ._text import flat, mix, word_hashes

SHINGLE = 3  # words
SIMILARITY = 0.3  # of shingle sets: most of the wording is shared
BITS, RADIUS = 256, 106
SKETCH = 512  # bits
SLOTS = 16  # parts of the shingles, one or some a round
ROUND = 2_000_000  # rows of about a hundred bytes to shuffle in one round, while there are slots
VERIFIED = 500_000  # pairs whose sets move in one round, while there are slots
CELLS = 1 << 21
_STEPS = 8  # of a cell's logarithm
WITNESSES = 4
# Words of stand-ins that say that there is none, or where to look.
PLACEHOLDER = (
    "a an and are as at available be been can details exists for found full given has here in is it missing more n na no none not null of on original "
    "or pending please provided refer see summaries summary tba tbd text the there this to unavailable unknown yet"
).split()
_SETS = "dom int, rep long, urgent boolean, sh array<long>"
_DESCRIBED = (
    "dom int, rep long, urgent boolean, size int, shared int, entries int, "
    + ", ".join([f"s{k} long" for k in range(SKETCH // 64)] + [f"w{k} long" for k in range(WITNESSES)])
    + ", " + ", ".join(f"t{k} array<long>, p{k} array<int>" for k in range(SLOTS))
    + ", rest array<long>, hot array<long>"
)
CHUNK = 16384  # texts of a shingle that ask for others in one task
PAIRS = 1_000_000  # compared at once
VALUES = 500_000  # shingles or words described at once
WIDE = 96  # texts of a bucket from which on it is compared by itself
BLOCK = 16384  # words of 64 texts that are looked at at once
BATCH = 100_000  # rows compared at once; small arrays cost more to call than to compute
_GROUP = 64  # planes between two looks at the counters
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- bit-sliced distances ---------------------------------------------------------------------------


def planes(prints: np.ndarray) -> np.ndarray:
    """uint8[n, BITS/8] to uint64[BITS, words]: bit b of text i is bit i of plane b."""
    n = len(prints)
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _add(counter: list[np.ndarray], carry: np.ndarray, level: int) -> None:
    """Add a plane of weight 2**level to the vertical counters."""
    while level < len(counter):
        counter[level], carry = counter[level] ^ carry, counter[level] & carry
        level += 1


def _full(a, b, c):
    """Full adder: the sum plane and the carry plane."""
    u = a ^ b
    total = u ^ c
    u &= c
    carry = a & b
    carry |= u
    return total, carry


def _at_most(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is at most ``radius``."""
    below, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ALL)
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            below |= equal & ~counter[level]
            equal &= counter[level]
        else:
            equal &= ~counter[level]
    return below | equal


def near_lanes(differ, n_planes: int, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words that hold a lane within ``radius``, and those lanes.

    ``differ(p, at)`` gives plane p of the differing bits for the words ``at``, or for all of them, in order, if
    that is None; ``alive`` are the lanes to look at. After every group of planes, words without a lane
    still within the radius are abandoned. While most words have one, all are kept: picking them out costs more.
    """
    at = np.flatnonzero(alive)
    at = at if 2 * len(at) < len(alive) else None
    lanes = alive if at is None else alive[at]
    counter = [np.zeros(len(lanes), np.uint64) for _ in range(int(n_planes).bit_length())]
    for p in range(0, n_planes, 16):
        if not len(lanes):
            break
        ones, twos, fours, eights = counter[:4]
        carried = []
        for q in (p, p + 4, p + 8, p + 12):
            ones, t1 = _full(ones, differ(q, at), differ(q + 1, at))
            ones, t2 = _full(ones, differ(q + 2, at), differ(q + 3, at))
            twos, f = _full(twos, t1, t2)
            carried.append(f)
        fours, e1 = _full(fours, carried[0], carried[1])
        fours, e2 = _full(fours, carried[2], carried[3])
        eights, sixteens = _full(eights, e1, e2)
        counter[:4] = ones, twos, fours, eights
        _add(counter, sixteens, 4)
        if (p + 16) % _GROUP == 0:
            lanes = lanes & _at_most(counter, radius)
            keep = np.flatnonzero(lanes)
            if 2 * len(keep) < len(lanes) or p + 16 == n_planes:
                at, lanes, counter = keep if at is None else at[keep], lanes[keep], [c[keep] for c in counter]
    return (np.flatnonzero(lanes), lanes[lanes != 0]) if at is None else (at, lanes)


def _lanes_to_pairs(at: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and lane numbers of the set bits."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return at[row], lane


def _wide(prints: np.ndarray, radius: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j >= begin[i]) within the radius in one large bucket: many texts against all planes at once."""
    p, n = planes(prints), len(prints)
    bits = np.unpackbits(prints, axis=1, bitorder="little").astype(bool)
    tail = n - (p.shape[1] - 1) * 64
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, min(256, BLOCK // p.shape[1]))
    for low in range(0, n, step):
        high = min(n, low + step)
        skipped = int(begin[low:high].min()) // 64
        n_words = p.shape[1] - skipped
        if n_words <= 0:
            continue
        part = p[:, skipped:]
        # Only the texts asked for, and no padding.
        shift = np.clip(begin[low:high, None] - (np.arange(n_words) + skipped) * 64, 0, 64)
        alive = np.where(shift < 64, _ALL << np.minimum(shift, 63).astype(np.uint64), np.uint64(0))
        if tail < 64:
            alive[:, -1] &= np.uint64((1 << tail) - 1)
        flip = np.where(bits[low:high].T, _ALL, np.uint64(0))

        def differ(b, at, part=part, flip=flip, n_words=n_words):
            if at is None:
                return (part[b] ^ flip[b][:, None]).ravel()
            return part[b][at % n_words] ^ flip[b][at // n_words]

        at, lanes = near_lanes(differ, p.shape[0], alive.ravel(), radius)
        place, lane = _lanes_to_pairs(at, lanes)
        left.append(place // n_words + low)
        right.append((place % n_words + skipped) * 64 + lane)
    return np.concatenate(left), np.concatenate(right)


def _narrow(bucket: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius in many small buckets that lie one after the other: texts i and i + shift."""
    n = len(bucket)
    p = planes(prints)
    n_words, left, right = p.shape[1], [], []
    padded = np.concatenate([p, np.zeros((p.shape[0], 2), np.uint64)], axis=1)
    last = np.searchsorted(bucket, bucket, side="right")
    room = last - np.arange(n) - 1  # later texts of the same bucket
    for shift in range(1, int(room.max(initial=0)) + 1):
        flags = np.zeros(n_words * 64, np.uint8)
        flags[:n] = room >= shift
        alive = np.packbits(flags, bitorder="little").view(np.uint64)
        q, r = np.uint64(shift // 64), np.uint64(shift % 64)

        def differ(b, at, q=int(q), r=r):
            if at is None:
                moved = padded[b, q : q + n_words] >> r
                return p[b] ^ (moved | (padded[b, q + 1 : q + 1 + n_words] << (np.uint64(64) - r)) if r else moved)
            moved = padded[b][at + q] >> r
            if r:
                moved = moved | (padded[b][at + q + 1] << (np.uint64(64) - r))
            return p[b][at] ^ moved

        at, lanes = near_lanes(differ, p.shape[0], alive, radius)
        word, lane = _lanes_to_pairs(at, lanes)
        left.append(word * 64 + lane)
        right.append(word * 64 + lane + shift)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_pairs(bucket: np.ndarray, prints: np.ndarray, radius: int = RADIUS, wide: int = WIDE, begin: np.ndarray | None = None):
    """Positions (i, j) of texts of the same bucket within ``radius``; ``bucket`` is sorted.

    ``begin`` may say, for texts of buckets of more than ``wide``, from which position on others are asked for.
    """
    begin = np.arange(1, len(bucket) + 1) if begin is None else begin
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])
    big = ends - starts > wide
    small = np.ones(len(bucket), bool)
    left, right = [], []
    for s, e in zip(starts[big], ends[big]):
        small[s:e] = False
        i, j = _wide(prints[s:e], radius, begin[s:e] - s)
        left.append(i + s)
        right.append(j + s)
    rest = np.flatnonzero(small)
    if len(rest):
        i, j = _narrow(bucket[rest], prints[rest], radius)
        left.append(rest[i])
        right.append(rest[j])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


# --- fingerprints and keys ---------------------------------------------------------------------------


def fingerprints(lists) -> np.ndarray:
    """uint8[n, BITS/8]: the signs of the sums of the shingles' random bits."""
    values, starts = flat(lists)
    out = np.zeros((len(lists), BITS // 8), np.uint8)
    if not len(values):
        return out
    size = np.diff(starts)
    for b in range(0, BITS, 64):
        bits = np.unpackbits(mix(values.view(np.uint64) ^ np.uint64(b + 1)).view(np.uint8).reshape(-1, 8), axis=1)
        # One sum per text: far quicker than one reduction along rows of 64.
        ones = np.stack([bits[s:e].sum(axis=0, dtype=np.int64) for s, e in zip(starts[:-1], starts[1:])])
        out[:, b // 8 : b // 8 + 8] = np.packbits(2 * ones > size[:, None], axis=1)
    return out


def sketches(lists) -> np.ndarray:
    """uint8[n, SKETCH/8]: a bit for every value that a hash of the shingles takes."""
    values, starts = flat(lists)
    out = np.zeros((len(lists), SKETCH), np.uint8)
    out[np.repeat(np.arange(len(lists)), np.diff(starts)), (mix(values.view(np.uint64) ^ np.uint64(104729)) % np.uint64(SKETCH)).astype(np.int64)] = 1
    return np.packbits(out, axis=1)


def may_reach(one, two, size_one, size_two, similarity: float) -> np.ndarray:
    """Whether pairs of sets with these sketches and sizes can have this Jaccard similarity; never wrongly False.

    Shared shingles share their bit; what they have beyond one to a bit is bounded by what either set has.
    """
    a, b = one.view(np.uint64), two.view(np.uint64)
    ones = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a & b, a, b)]
    most = np.minimum(ones[0] + np.minimum(size_one - ones[1], size_two - ones[2]), np.minimum(size_one, size_two))
    return most >= similarity * (size_one + size_two - most) - 1e-9


# --- sets and their rare ends ------------------------------------------------------------------------


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most VALUES list elements, or of one row."""
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()[1:].astype(np.int64)
        low, done = 0, int(ends[0] - len(batch.column(column)[0])) if len(batch) else 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(ends, done + VALUES, side="right")))
            yield batch.slice(low, high - low)
            low, done = high, int(ends[high - 1])


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: ``dom, rep, urgent, hashes`` to ``dom, rep, urgent, sh``, the shingles of whole batches at once."""
    for batch in _parts(batches, "hashes"):
        column = batch.column("hashes")
        starts = column.offsets.to_numpy().astype(np.int64)
        words = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].view(np.uint64)
        starts = starts - starts[0]
        size = np.diff(starts)
        n = np.where(size > 0, np.maximum(1, size - SHINGLE + 1), 0)
        own = np.repeat(np.arange(len(size)), n)
        at = starts[:-1][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(len(own), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(SHINGLE):
                use = i < size[own]
                out[use] = mix(out[use] * np.uint64(3) + words[at[use] + i])
            # The two ways to judge a text have shingles of their own.
            dom = batch.column("dom").to_numpy(zero_copy_only=False)[own].astype(np.uint64)
            out = np.where(dom > 0, mix(out ^ np.uint64(7919) * (dom + np.uint64(1))), out).view(np.int64)
        order = np.lexsort((out, own))
        own, out = own[order], out[order]
        first = np.ones(len(out), bool)
        first[1:] = (own[1:] != own[:-1]) | (out[1:] != out[:-1])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("dom", "rep", "urgent")), _lists(out[first], own[first], len(size))], ["dom", "rep", "urgent", "sh"]
        )


def _lists(values: np.ndarray, own: np.ndarray, n: int) -> pa.ListArray:
    """Values that lie in the order of their rows ``own`` as an array of ``n`` lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)), pa.array(values))


def _rarity(sets: DataFrame):
    """Broadcast uint8[CELLS]: the logarithm of how often shingles fall into a cell; 0 if they can't be shared by two texts to link.

    It orders shingles from rare to common and need not be exact for that: any order loses nothing.
    """
    shingle = sets.select(F.explode("sh").alias("h"), "urgent")
    counted = shingle.groupBy(F.expr(f"CAST(h & {CELLS - 1}L AS INT)").alias("cell")).agg(F.count("*").alias("n"), F.max("urgent").alias("u"))
    counted = cut(counted.where("n > 1 AND u").drop("u"), "cells")
    told = counted.toPandas()
    release(counted)
    out = np.zeros(CELLS, np.uint8)
    out[told["cell"].to_numpy()] = np.minimum(255, np.round(_STEPS * np.log2(told["n"].to_numpy())))
    return sets.sparkSession.sparkContext.broadcast(out)


def _describe(rarity, similarity: float, hot: int):
    """For mapInArrow: sketch and shingles; those among which a pair must have its rarest common one lie in ``t0 ..``, with their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = rarity.value
        for batch in _parts(batches, "sh"):
            column = batch.column("sh")
            starts = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
            size = np.diff(starts)
            n = len(size)
            own = np.repeat(np.arange(n), size)
            rare = cells[values & (CELLS - 1)]
            order = np.lexsort((values, rare, own))
            values, rare = values[order], rare[order]
            rank = np.arange(len(values)) - (starts[:-1] - starts[0])[own]
            shared = rare > 0
            sketch = np.zeros((n, SKETCH), np.uint8)
            sketch[own[shared], (mix(values[shared].view(np.uint64) ^ np.uint64(104729)) % np.uint64(SKETCH)).astype(np.int64)] = 1
            words = np.packbits(sketch, axis=1, bitorder="little").view(np.int64)
            probe = shared & (rank <= size[own] - np.ceil(similarity * size[own] - 1e-9))
            slot = (mix(values.view(np.uint64) ^ np.uint64(15485863)) % np.uint64(SLOTS)).astype(np.int64)
            out = {c: batch.column(c) for c in ("dom", "rep", "urgent")}
            out["size"] = pa.array(size.astype(np.int32))
            out["shared"] = pa.array(np.bincount(own[shared], minlength=n).astype(np.int32))
            out["entries"] = pa.array(np.bincount(own[probe], minlength=n).astype(np.int32))
            for k in range(SKETCH // 64):
                out[f"s{k}"] = pa.array(np.ascontiguousarray(words[:, k]))
            # The same in all texts with most shingles in common, and all of them meet at it.
            sure = np.flatnonzero(shared & (rank <= size[own] - np.ceil(2 * similarity / (1 + similarity) * size[own] - 1e-9)))
            hashed = mix(values[sure].view(np.uint64) ^ np.uint64(7919))
            cell = own[sure] * WITNESSES + (hashed % np.uint64(WITNESSES)).astype(np.int64)
            order = np.lexsort((hashed, cell))
            cell, first = np.unique(cell[order], return_index=True)
            witness = np.zeros(n * WITNESSES, np.int64)
            witness[cell] = values[sure[order[first]]]
            for k in range(WITNESSES):
                out[f"w{k}"] = pa.array(np.ascontiguousarray(witness[k::WITNESSES]))
            for k in range(SLOTS):
                here = probe & (slot == k)
                out[f"t{k}"] = _lists(values[here], own[here], n)
                out[f"p{k}"] = _lists(rank[here].astype(np.int32), own[here], n)
            out["rest"] = _lists(values[~probe], own[~probe], n)
            many = probe & (rare >= np.floor(_STEPS * np.log2(max(2, hot))))
            out["hot"] = _lists(values[many], own[many], n)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _meet(token, salt, meta, kept, sketch, witness, rep, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows with the same token (sorted by token, salt and size) that can be similar, as ``dom, a, b``; none is lost.

    A pair with a witness in common is looked at where it meets at the first such, and nowhere else.
    """
    size, rank = meta >> 32, (meta >> 3) & 0x1FFFFFFF
    dom, index, urgent = meta >> 2 & 1, (meta >> 1 & 1) == 0, (meta & 1).astype(bool)
    group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
    place = (group << 32) + size
    x = np.flatnonzero(index)
    # The first of a pair is the smaller one; the other has at most 1 / similarity times its size.
    last = np.searchsorted(place, (group[x] << 32) + np.floor(size[x] / similarity + 1e-9).astype(np.int64), side="right")
    count = np.maximum(0, last - x - 1)
    ends = np.cumsum(count)
    spare = kept - np.bitwise_count(sketch).sum(axis=1, dtype=np.int64)
    low = 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
        c = count[low:high]
        i = np.repeat(x[low:high], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        low = high
        # At its rarest common shingle a pair has in common this one and at most what comes after it.
        need = similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9
        fit = np.minimum(size[i] - rank[i], size[j] - rank[j]) >= need
        free = np.ones(len(i), bool)
        for k in range(WITNESSES):
            both = free & (witness[k][i] == witness[k][j]) & (witness[k][i] != 0)
            fit = np.where(both, witness[k][i] == token[i], fit)
            free &= ~both
        fit &= urgent[i] | urgent[j]
        i, j, need = i[fit], j[fit], need[fit]
        # Shared shingles share their bit; what they have beyond one to a bit is bounded by what either set has.
        most = np.bitwise_count(sketch[i] & sketch[j]).sum(axis=1, dtype=np.int64) + np.minimum(spare[i], spare[j])
        fit = most >= need
        i, j = i[fit], j[fit]
        if len(i):
            yield dom[i], np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])


def _compare(similarity: float):
    """For mapInArrow over rows sorted by token, salt and size: candidate pairs. Tokens never part across partitions."""
    words = [f"s{k}" for k in range(SKETCH // 64)]

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, salt, meta, kept, rep = (rows[c].to_numpy() for c in ("token", "salt", "meta", "shared", "rep"))
        witness = [rows[f"w{k}"].to_numpy() for k in range(WITNESSES)]
        sketch = np.stack([rows[c].to_numpy().view(np.uint64) for c in words], axis=1)
        for dom, a, b in _meet(token, salt, meta, kept.astype(np.int64), sketch, witness, rep, similarity):
            found = pd.DataFrame({"dom": dom.astype(np.int32), "a": a, "b": b}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            count += len(batch)
            if count < BATCH:
                continue
            rows = pa.Table.from_batches(held)
            token, salt = rows["token"].to_numpy(), rows["salt"].to_numpy()
            before = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            begin = int(before[-1]) + 1 if len(before) else 0
            if begin:
                yield from pairs(rows.slice(0, begin))
            held = rows.slice(begin).combine_chunks().to_batches()
            count = len(rows) - begin
        if count:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _entries(described: DataFrame, slots: list[int], similarity: float, crowd: DataFrame | None) -> DataFrame:
    """``token, salt, meta, shared, rep, s0 .., w0 ..``: texts by the shingles at which they can meet others.

    A shingle of many texts meets in parts: each text is sent to all of them, but only in one it asks for others.
    """
    sketch = [f"s{k}" for k in range(SKETCH // 64)] + [f"w{k}" for k in range(WITNESSES)]
    t, p = (F.concat(*(f"{c}{k}" for k in slots)).alias(c) for c in "tp")
    rows = described.select("dom", "rep", "urgent", "size", "shared", *sketch, t, p)
    rows = rows.withColumn("x", F.explode(F.arrays_zip("t", "p"))).withColumns({"token": F.col("x.t"), "rank": F.col("x.p")})
    index = F.col("rank") <= F.col("size") - F.ceil(2 * similarity / (1 + similarity) * F.col("size") - 1e-9)
    if crowd is None:
        rows = rows.withColumn("salt", F.lit(0))
    else:
        rows = join_by_size(rows, crowd, "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(1)) - 1)))
        index = index & (F.col("salt") == F.pmod(F.xxhash64("rep"), F.coalesce("m", F.lit(1))))
    # Of two texts of one size and rank the one that asks must come first, in whichever part.
    flags = F.col("dom") * 4 + (~index).cast("int") * 2 + F.col("urgent").cast("int")
    meta = F.shiftleft(F.col("size").cast("long"), 32) + F.shiftleft(F.col("rank").cast("long"), 3) + flags
    return rows.select("token", "salt", meta.alias("meta"), "shared", "rep", *sketch)


# --- the operator -------------------------------------------------------------------------------------


def classes(bodies: DataFrame) -> DataFrame:
    """``dom, id, rep``: texts of the same words, each with the smallest id among them.

    ``bodies`` has ``dom, id, hashes``. Texts without a word have no wording to share and no row.
    """
    worded = bodies.where(F.size("hashes") > 0)
    marked = worded.select("dom", "id", F.md5(F.concat_ws(",", F.transform("hashes", lambda h: h.cast("string")))).alias("md5"))
    marked = marked.withColumn("content", F.concat_ws(":", "dom", "md5")).drop("md5")
    least = marked.groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    return lookup(marked, least, "content", "n").select("dom", "id", "rep")


def links(described: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``dom, a, b, similarity``: linked representatives, a < b; all of them.

    Goes over the shingles in rounds, and over the candidates too, so that shuffle files of one round at a time are on disk.
    """
    crowd = described.select(F.explode("hot").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    crowd = cut(crowd.select("token", F.ceil(F.col("n") / chunk).cast("int").alias("m")), "crowd")
    some = crowd.limit(1).count() > 0
    total = described.agg(F.sum("entries")).first()[0] or 0
    rounds = min(SLOTS, max(1, -(-total // ROUND)))
    met = [
        cut(
            _entries(described, [int(k) for k in slots], similarity, crowd if some else None)
            .repartition("token", "salt")
            .sortWithinPartitions("token", "salt", "meta")
            .mapInArrow(_compare(similarity), "dom int, a long, b long")
            .distinct(),
            "met",
        )
        for slots in np.array_split(np.arange(SLOTS), rounds)
    ]
    found = met[0] if len(met) == 1 else cut(reduce(DataFrame.unionAll, met).distinct(), "candidates")
    release(crowd)
    if len(met) > 1:
        for done in met:
            release(done)
    whole = described.select("dom", "rep", F.concat(*(f"t{k}" for k in range(SLOTS)), "rest").alias("sh"))
    rounds = min(SLOTS, max(1, -(-found.count() // VERIFIED)))
    scored = [cut(_scored(found.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k), whole, similarity), "scored") for k in range(rounds)]
    release(found)
    return reduce(DataFrame.unionAll, scored)


def _scored(found: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``dom, a, b`` whose sets in ``whole`` are similar."""
    one, two = (join_by_size(whole.withColumnRenamed("rep", c), found.select("dom", c).distinct(), ["dom", c], "left_semi") for c in "ab")
    shared = F.size(F.array_intersect("sh_a", "sh_b"))
    total = F.size("sh_a") + F.size("sh_b")
    both = found.join(one.withColumnRenamed("sh", "sh_a"), ["dom", "a"]).join(two.withColumnRenamed("sh", "sh_b"), ["dom", "b"])
    both = both.select("dom", "a", "b", shared.alias("s"), total.alias("t"))
    ratio = F.col("s") / (F.col("t") - F.col("s"))
    return both.select("dom", "a", "b", ratio.alias("similarity")).where(F.col("similarity") >= similarity)


def describe(bodies: DataFrame, members: DataFrame, hot: int = CHUNK) -> DataFrame:
    """One row per representative: its shingles, from rare to common, and a sketch of them."""
    urgent = members.join(bodies.select("dom", "id", "urgent"), ["dom", "id"])
    flags = urgent.groupBy("dom", "rep").agg(F.max("urgent").alias("urgent"))
    chosen = cut(bodies.select("dom", F.col("id").alias("rep"), "hashes").join(flags, ["dom", "rep"]).select("dom", "rep", "urgent", "hashes"), "chosen")
    described = described_sets(chosen.mapInArrow(set_batches, _SETS), hot)
    release(chosen)
    return described


def described_sets(sets: DataFrame, hot: int = CHUNK) -> DataFrame:
    """The table that ``links`` reads, of ``dom, rep, urgent, sh``. Sets are computed twice rather than written."""
    return cut(sets.mapInArrow(_describe(_rarity(sets), SIMILARITY, hot), _DESCRIBED), "described")


def stories(sets: DataFrame) -> DataFrame:
    """``rep, story``: for every set of shingles (``rep, sh``) with near-duplicates the smallest of them or itself."""
    described = described_sets(sets.select(F.lit(0).alias("dom"), "rep", F.lit(True).alias("urgent"), "sh"))
    found = cut(links(described).select("a", "b"), "links")
    release(described)
    ends = found.select(F.col("a").alias("rep"), "a").unionAll(found.select(F.col("b").alias("rep"), "a"))
    return ends.groupBy("rep").agg(F.min("a").alias("story"))


def bodies_of(texts: DataFrame, id: str = "id", body: str = "original_text", other: str = "summary", least_words: int = 8) -> DataFrame:
    """``dom, id, hashes, urgent``: the body as dom 0, the stand-in for it as dom 1.

    A pair is judged by the body if both have one, else by the stand-in, so in dom 1 only pairs with a
    text that lacks the body matter: those texts are ``urgent``. A stand-in of fewer than ``least_words``
    words that only says that there is none or where to look (PLACEHOLDER: "No summary.") has no row; any other has one, however short.
    """
    def present(c):
        return F.when(F.trim(F.col(c)) != "", F.col(c))

    rows = texts.select(F.col(id).cast("long").alias("id"), present(body).alias("b"), present(other).alias("o")).where("id IS NOT NULL")
    zero = rows.where("b IS NOT NULL").select(F.lit(0).alias("dom"), "id", word_hashes(F.col("b")).alias("hashes"), F.lit(True).alias("urgent"))
    one = rows.where("o IS NOT NULL").select(F.lit(1).alias("dom"), "id", word_hashes(F.col("o")).alias("hashes"), F.col("b").isNull().alias("urgent"))
    said = one.where((F.size("hashes") >= least_words) | (F.size(F.array_except("hashes", F.transform(F.array(*map(F.lit, PLACEHOLDER)), lambda w: F.xxhash64(w)))) > 0))
    return zero.unionByName(said)


def near_duplicates(texts: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    """Members ``dom, id, rep, urgent`` and links ``dom, a, b, similarity`` of a table of texts.

    Texts of the same words are one class with one representative; links join representatives whose
    shingle sets (three words in a row) overlap to SIMILARITY or more.
    Null ids have no row; a null or blank body is judged by the stand-in, both null or without words: no row;
    repeated ids must not occur; an empty table gives empty results; texts are read whole, extra columns
    not at all. A stand-in that three or more differing bodies have is a placeholder and links nothing.
    """
    bodies = cut(bodies_of(texts, **names), "bodies")
    members = cut(classes(bodies).join(bodies.select("dom", "id", "urgent"), ["dom", "id"]), "members")
    described = describe(bodies, members.select("dom", "id", "rep"))
    release(bodies)
    found = cut(links(described), "links")
    release(described)
    return members, found.join(_placeholders(members, found), ["dom", "a"], "left_anti").join(
        _placeholders(members, found).withColumnRenamed("a", "b"), ["dom", "b"], "left_anti"
    )


def _placeholders(members: DataFrame, found: DataFrame) -> DataFrame:
    """``dom, a``: stand-ins (dom 1) that go with three or more differing bodies."""
    body = members.where("dom = 0").select("id", "rep")
    both = found.where("dom = 0")
    lowest = (
        both.select(F.col("b").alias("rep"), F.col("a").alias("low")).groupBy("rep").agg(F.min("low").alias("low"))
    )
    labelled = body.join(lowest, "rep", "left").select("id", F.coalesce("low", "rep").alias("label"))
    held = members.where("dom = 1").select("id", "rep").join(labelled, "id")
    return (
        held.groupBy("rep").agg(F.count_distinct("label").alias("n")).where("n >= 3").select(F.lit(1).alias("dom"), F.col("rep").alias("a"))
    )


def all_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """``text_id_a, text_id_b``: every pair of linked texts, copies written out."""
    placeholders = _placeholders(members, found)
    kept = members.join(placeholders.withColumnRenamed("a", "rep"), ["dom", "rep"], "left_anti")
    left = kept.select("dom", F.col("rep").alias("a"), F.col("id").alias("x"), F.col("urgent").alias("ux"))
    right = kept.select("dom", F.col("rep").alias("b"), F.col("id").alias("y"), F.col("urgent").alias("uy"))
    across = found.select("dom", "a", "b").join(left, ["dom", "a"]).join(right, ["dom", "b"])
    within = left.join(right.withColumnRenamed("b", "a"), ["dom", "a"]).where("x < y")
    cols = ["x", "y", "ux", "uy"]
    both = across.select(*cols).unionByName(within.select(*cols)).where("ux OR uy")
    return both.select(F.least("x", "y").alias("text_id_a"), F.greatest("x", "y").alias("text_id_b")).distinct()


def per_text(texts: DataFrame, members: DataFrame, found: DataFrame, id: str = "id") -> DataFrame:
    """``text_id, class_id, n_copies, n_links``: one row per text.

    ``class_id`` is the smallest text of the same words, by body, else by stand-in; ``n_copies`` texts are in that
    class. ``n_links`` counts the classes linked to it: by body, and by stand-in where one of both texts lacks
    the body. A text without words is its own class.
    """
    placeholders = _placeholders(members, found).select("dom", F.col("a").alias("rep"))
    sizes = members.groupBy("dom", "rep").agg(F.count("*").alias("n"), F.max(F.col("urgent").cast("int")).alias("lacking"))
    sizes = cut(sizes.join(placeholders, ["dom", "rep"], "left_anti"), "class-sizes")
    lacking = sizes.select("dom", F.col("rep").alias("other"), "lacking")
    both = found.select("dom", F.col("a").alias("rep"), F.col("b").alias("other")).unionAll(found.select("dom", F.col("b").alias("rep"), F.col("a").alias("other")))
    degree = both.join(lacking, ["dom", "other"]).groupBy("dom", "rep").agg(F.count("*").alias("k"), F.sum("lacking").alias("k_lacking"))
    placed = members.join(sizes.join(degree, ["dom", "rep"], "left").drop("lacking"), ["dom", "rep"])
    # A text with a body meets by its stand-in only texts without one.
    links = F.when(F.col("urgent"), F.col("k")).otherwise(F.col("k_lacking"))
    per = placed.groupBy("id").agg(F.min_by(F.struct("rep", "n"), "dom").alias("x"), F.sum(F.coalesce(links, F.lit(0))).alias("k"))
    ids = texts.select(F.col(id).cast("long").alias("id")).where("id IS NOT NULL")
    return ids.join(per, "id", "left").select(
        F.col("id").alias("text_id"), F.coalesce("x.rep", "id").alias("class_id"),
        F.coalesce("x.n", F.lit(1)).alias("n_copies"), F.coalesce("k", F.lit(0)).alias("n_links"),
    )
