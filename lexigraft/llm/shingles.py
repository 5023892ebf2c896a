"""Word shingles: words in lower case (A-Z), sets of runs of k words, and their hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def words_lower(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8").lower().split() if text else []


def shingle_set(words: list[bytes], k: int = 5) -> set[bytes]:
    """Distinct runs of ``k`` words; with fewer words the whole sequence is one, without words there is none."""
    if len(words) <= k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """64-bit hashes of the shingles of a text, in text order, repeated ones included."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(k, n)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for j in range(size):
        out = mix(out * MIX + hashes[j : n - size + 1 + j])
    return out
