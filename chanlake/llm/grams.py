"""Tokens and hashed n-grams, computed for whole batches of texts with numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Runs of letters and digits.
TOKEN = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_seen: dict[str, int] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def hashes(words: list[str]) -> list[int]:
    """64-bit hash of each token; the hashes of frequent tokens are remembered."""
    if len(_seen) > 300_000:
        _seen.clear()
    out = []
    for w in words:
        h = _seen.get(w)
        if h is None:
            h = _seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return out


class Sets:
    """Distinct n-grams of each text of a batch, in one array: those of text k lie at ``start[k]:start[k + 1]``."""

    def __init__(self, texts: list[str | None], width: int, least: int):
        lists = [tokens(t) for t in texts]
        flat: list[int] = []
        at, size = [], []
        for k, w in enumerate(lists):
            if len(w) >= max(least, width):
                at.append(k)
                size.append(len(w))
                flat += hashes(w)
        self.at = np.array(at, np.int64)
        n = np.array(size, np.int64)
        h = np.array(flat, np.uint64)
        doc = np.repeat(np.arange(len(n)), n)
        end = np.cumsum(n)
        left = np.repeat(end, n) - np.arange(len(h))  # tokens from here to the end of the text
        g = mix(h)
        for k in range(1, width):
            g = mix(g[:-1] + mix(h[k:], k)) if len(g) > 1 else g[:0]
        ok = left[: len(g)] >= width
        g, doc = g[ok], doc[: len(g)][ok]
        order = np.lexsort((g, doc))
        g, doc = g[order], doc[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])] if len(g) else np.zeros(0, bool)
        self.gram, self.doc = g[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(n)).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.n)]

    def of(self, k: int) -> np.ndarray:
        return self.gram[self.start[k] : self.start[k + 1]]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that are equal for equal sets."""
        if not len(self.n):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = np.add.reduceat(mix(self.gram, 11), self.start[:-1])
        b = np.add.reduceat(mix(self.gram, 23), self.start[:-1])
        return a.view(np.int64), b.view(np.int64)
