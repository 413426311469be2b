"""Words of a list that some of many tokens are spelt like: bounds by matrices for a batch of tokens at once, then the ratio."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .readers import alike

#: Tokens that are compared with a block of terms at once.
TOKENS = 4096


def numbered(parts: Iterable[str]) -> list[str]:
    """Each part with how many equal ones stand before it, so that shared parts are a set's."""
    seen: dict[str, int] = {}
    out = []
    for p in parts:
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append(f"{p}{k}")
    return out


def _marks(words: list[str], cut: Callable[[str], list[str]], places: dict[str, int]) -> np.ndarray:
    """A row for each word and a column for each place: 1 where the word has the part."""
    found = np.zeros((len(words), len(places)), dtype=np.float32)
    at = [(i, places[p]) for i, w in enumerate(words) for p in cut(w) if p in places]
    if at:
        rows, columns = zip(*at)
        found[list(rows), list(columns)] = 1
    return found


def _letters(word: str) -> list[str]:
    return numbered(word)


def _pairs(word: str) -> list[str]:
    return numbered(word[i : i + 2] for i in range(len(word) - 1))


def alike_terms(terms: list[str], tokens: list[str], least: float) -> set[str]:
    """Terms that one of some tokens, all of one length, is spelt like.

    A ratio of r takes M >= r / 2 * s matching letters of s letters of both, so they share M letters. Their blocks are at most
    one more than the letters that don't match, so they share 3 * M - s - 1 pairs of letters too.
    """
    both = np.array([len(t) for t in terms]) + len(tokens[0])
    matching = np.ceil(both * (least / 2) - 1e-9)
    could = np.ones((len(tokens), len(terms)), dtype=bool)
    for cut, fewest in ((_letters, matching), (_pairs, 3 * matching - both - 1)):
        own = [cut(t) for t in terms]
        places = {p: i for i, p in enumerate(dict.fromkeys(p for x in own for p in x))}
        could &= _marks(tokens, cut, places) @ _marks(terms, cut, places).T >= fewest
    found = set()
    for j in np.flatnonzero(could.any(axis=0)):
        term = terms[j]
        if any(alike(term, tokens[i], least) for i in np.flatnonzero(could[:, j])):
            found.add(term)
    return found


def spelt(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (terms, tokens), lists, the tokens of one length: (term) that are found, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for i in range(batch.num_rows):
                left = [t for t in batch.column("terms")[i].as_py() if t not in found]
                new = alike_terms(left, batch.column("tokens")[i].as_py(), least) if left else set()
                found |= new
                if new:
                    yield pa.RecordBatch.from_pydict({"term": sorted(new)})

    return run


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (token): (m, tokens), lists of up to TOKENS tokens of m characters."""
    held: dict[int, list[str]] = {}

    def row(m: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"m": pa.array([m], pa.int32()), "tokens": pa.array([held.pop(m)], pa.list_(pa.string()))})

    for batch in batches:
        for token in batch.column("token").to_pylist():
            own = held.setdefault(len(token), [])
            own.append(token)
            if len(own) >= TOKENS:
                yield row(len(token))
    for m in list(held):
        yield row(m)
