"""Vectorised word and window hashing of text batches with numpy.

A word is a maximal run of bytes outside space and 0x09-0x0D of the UTF-8 text. Word hashes sum random 64-bit numbers
drawn for (place in the word, byte): two given words collide with a chance of 2**-64. Windows sum mixed word hashes
times odd numbers drawn for the place in the window.
"""

from __future__ import annotations

import numpy as np

_PLACES = 128
_rng = np.random.Generator(np.random.PCG64(20240601))
_TABLE = _rng.integers(0, 2**64, size=(_PLACES, 256), dtype=np.uint64).ravel()
_STEP = _rng.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)
_BLOCK = _rng.integers(0, 2**64, size=4096, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a batch of texts: starts and ends in .data, hashes, and for each text the first word and word count."""

    def __init__(self, texts, lower: bool = False):
        raw = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
        self.raw = raw
        joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.data = _LOWER[joined] if lower else joined
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])[: len(raw)] if raw else np.zeros(0, np.int64)
        space = _SPACE[joined]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(np.concatenate([self.first, [len(self.starts)]]))
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.zeros(0, np.uint64)
        total = int(lengths.sum())
        shift = np.repeat(self.starts - (np.cumsum(lengths) - lengths), lengths)
        index = np.arange(total) + shift
        place = index - np.repeat(self.starts, lengths)
        value = _TABLE[(place & (_PLACES - 1)) * 256 + self.data[index]]
        if int(lengths.max()) > _PLACES:  # later blocks of long words get a factor of their own
            block = place // _PLACES
            far = np.flatnonzero(block)
            value = value.copy()
            value[far] = mix(value[far] + block[far].astype(np.uint64) * _BLOCK[7])
        run = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        last = np.cumsum(lengths)
        return mix(run[last] - run[last - lengths] + lengths.astype(np.uint64) * _BLOCK[0])

    def windows(self, k: int) -> np.ndarray:
        """A hash for each place of the batch where k words begin; windows that run into the next text are included."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hashes[j : j + n] * _STEP[j]
        return mix(out)

    def owners(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingle_sets(texts, k: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin (one place more than texts).

    A text with fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    w = Words(texts, lower)
    window = w.windows(k)
    n = np.where(w.counts >= k, w.counts - k + 1, 0)
    own = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(own)) + np.repeat(w.first - (np.cumsum(n) - n), n)
    h = window[at] if len(own) else np.zeros(0, np.uint64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = w.counts[short] > j
            extra[there] += w.hashes[w.first[short[there]] + j] * _STEP[j]
        h = np.concatenate([h, mix(extra + w.counts[short].astype(np.uint64) * _BLOCK[1])])
        own = np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
        h, own = h[keep], own[keep]
    return h, np.searchsorted(own, np.arange(len(n) + 1))
