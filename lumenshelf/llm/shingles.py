"""Word shingles as 64-bit hashes, and MinHash signatures of many texts at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WIDTH = 5
_WORD = re.compile(r"\w+")


class _Words(dict):
    """word -> 64-bit hash, kept for frequent use in bounded space."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_HASHES = _Words()


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(tokens: list[str], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one shingle, an empty one has none."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k]
    return np.unique(mix(out))


def signatures(sets: list[np.ndarray], size: int, seed: int = 5) -> np.ndarray:
    """MinHash coordinates, 32 bits each: one row per set. An empty set's row is zero."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**32, (2, size), dtype=np.uint32)
    a |= np.uint32(1)
    out = np.zeros((len(sets), size), np.uint32)
    at = [i for i, s in enumerate(sets) if len(s)]
    k = 0
    while k < len(at):
        end, total = k, 0
        while end < len(at) and (end == k or total + len(sets[at[end]]) <= 1 << 16):
            total += len(sets[at[end]])
            end += 1
        h = (np.concatenate([sets[i] for i in at[k:end]]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(sets[i]) for i in at[k : end - 1]])
        low = np.empty((size, end - k), np.uint32)
        for c in range(size):
            v = h * a[c]
            v += b[c]
            low[c] = np.minimum.reduceat(v, starts)
        low ^= low >> np.uint32(15)  # a minimum has high bits of zero
        low *= np.uint32(0x2C1B3C6D)
        out[at[k:end]] = (low ^ (low >> np.uint32(16))).T
        k = end
    return out
