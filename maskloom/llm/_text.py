"""Words of whole texts, folded so that differences of writing vanish, and shingles of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin one, and accented letters, each with what it becomes.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e",
    "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ø": "o",
    "ù": "u", "ú": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "ß": "s",
}
INVISIBLE = "­​‌‍⁠﻿"
_WORD = r"[\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case, without invisible characters, accents and look-alike letters."""
    return F.translate(F.lower(text), "".join(LOOKALIKES) + INVISIBLE, "".join(LOOKALIKES.values()))


def words(text: Column) -> Column:
    """The words of a text in order; [] for a text without any, null for a null."""
    return F.regexp_extract_all(folded(text), F.lit(_WORD), F.lit(0))


_SPLIT = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(LOOKALIKES | dict.fromkeys(INVISIBLE))


def words_of(text: str) -> list[str]:
    """``words`` for Python code that needs the words themselves."""
    return _SPLIT.findall(text.lower().translate(_FOLD))


class Codes(dict):
    """Word to 64-bit hash, the same in every process; holds at most ``limit`` words at a time."""

    limit = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch of arrays one after the other, and the place where each array begins (and the end)."""
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values = np.concatenate([np.asarray(x, np.int64) for x in lists]) if starts[-1] else np.empty(0, np.int64)
    return values, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD1B54A32D192ED03)
        x ^= x >> np.uint64(32)
    return x


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of ``k`` words in a row, sorted; a text of fewer words is one shingle, an empty one none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    h = hashes.astype(np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = mix(out * np.uint64(3) + h[i : i + n])
    return np.unique(out.view(np.int64))


def shingle_batches(k: int, keep: tuple[str, ...], source: str = "hashes", to: str = "sh"):
    """A function for mapInPandas: the columns ``keep`` and the shingles of the array ``source`` as ``to``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keep)].copy()
            out[to] = [shingles(np.asarray(x, np.int64), k) for x in batch[source]]
            yield out

    return run
