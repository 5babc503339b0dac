"""Word n-gram sets of texts as 64-bit hashes, and their MinHash bands."""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash

NGRAM = 5
_WORD = re.compile(r"\w+")
_STEP, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each element."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, remembered for words seen before; emptied when it has grown too large."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def ngram_set(text: str | None, hashes: WordHashes, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the lower-cased words; a shorter text is one shingle; no words, none."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    with np.errstate(over="ignore"):
        rolled = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * _M1 + h[k : len(h) - width + 1 + k]
        return np.unique(mix(rolled + np.uint64(width)))


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many hashes reach the recall at the threshold.

    A pair at Jaccard s shares one of b bands of r rows with probability 1 - (1 - s^r)^b.
    More rows in a band let fewer unlike pairs through.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows > most_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError(f"recall {recall} at {threshold} needs more than {most_hashes} hashes")
    return best


class BandHasher:
    """Band keys of an n-gram set: the minima of ``bands * rows`` hash functions, hashed band by band."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        with np.errstate(over="ignore"):
            base = np.arange(bands * rows, dtype=np.uint64) + np.uint64(seed * 1_000_003)
        self.a = (mix(base) | np.uint64(1))[:, None]
        self.b = mix(base ^ np.uint64(0xA5A5A5A5))[:, None]

    def keys(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), 512):  # a block of hash values stays in the processor's cache
                block = self.a * grams[None, at : at + 512]
                block += self.b
                np.minimum(least, block.min(axis=1), out=least)
            out = np.arange(1, self.bands + 1, dtype=np.uint64)
            for column in least.reshape(self.bands, self.rows).T:
                out = mix(out * _M1 + column)
        return out
