"""A run-length compressed Burrows-Wheeler index of short passages, and matching statistics streamed from it."""

from __future__ import annotations

import numpy as np

#: Symbols in the first sort key, of nine bits each; the key doubles with each round.
FIRST = 7


def suffix_order(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Suffixes of all passages in order; each ends with its passage, an end is smaller than any byte, ties by place.

    data: the passages' bytes one after the other. rest: bytes from a place to the end of its passage.
    """
    n = len(data)
    rank = np.zeros(n, np.int64)
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(FIRST, np.int64)])
    for j in range(FIRST):
        rank = (rank << 9) | np.where(rest > j, padded[j : n + j], 0)
    longest, span = int(rest.max()) if n else 0, FIRST
    rank = np.unique(rank, return_inverse=True)[1] + 1
    while span < longest and int(rank.max()) < n:
        ahead = np.zeros(n, np.int64)
        far = np.flatnonzero(rest > span)
        ahead[far] = rank[far + span]
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1] + 1
        span *= 2
    return np.argsort(rank, kind="stable")


class RunIndex:
    """The transform's runs, with the suffix at each end of a run and its common prefix with its neighbour outside it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        lengths = np.diff(np.concatenate([starts, [n]]))
        self.rest = np.repeat(starts + lengths, lengths) - np.arange(n)
        order = suffix_order(data, self.rest)
        before = np.where(np.isin(order, starts), -1, data[order - 1].astype(np.int64)) if n else np.zeros(0, np.int64)
        #: Runs as (symbol, length); -1 stands before each passage, and such entries never form a run.
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] < 0)]) if n else np.zeros(0, bool)
        first = np.flatnonzero(head)
        self.symbols, self.run_lengths = before[first], np.diff(np.concatenate([first, [n]]))
        at = first[first > 0]
        #: Samples: at the seam of two runs, the suffixes on both sides and their longest common prefix.
        self.above, self.below = order[at - 1], order[at]
        self.common = _common(data, self.rest, self.above, self.below)
        self.n = n

    def statistics(self) -> np.ndarray:
        """For each place, the longest match that also starts at another place.

        Inside a run the common prefix of neighbours is one less than at the place before, where the same run of the
        text goes on; so lengths are only known at seams, and are carried along the text one less at each step.
        """
        reach = np.arange(self.n)
        np.maximum.at(reach, self.above, self.above + self.common)
        np.maximum.at(reach, self.below, self.below + self.common)
        return np.maximum.accumulate(reach) - np.arange(self.n) if self.n else reach


def _common(data: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b."""
    out = np.zeros(len(a), np.int64)
    most = np.minimum(rest[a], rest[b])
    live = np.flatnonzero(most > 0)
    step = 16
    while len(live):
        cols = np.arange(step)
        p = out[live][:, None] + cols
        inside = p < most[live][:, None]
        same = inside & (data[np.minimum(a[live][:, None] + p, len(data) - 1)] == data[np.minimum(b[live][:, None] + p, len(data) - 1)])
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        out[live] += run
        live = live[(run == step) & (out[live] < most[live])]
        step = 64
    return out
