"""Trigrams of flattened texts, packed: which units hold each, as arrays of their numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose trigrams are gathered together.
PIECE = 4 << 20
_LETTERS = " 0123456789abcdefghijklmnopqrstuvwxyz"
_CODE = np.zeros(256, np.int32)
_CODE[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(len(_LETTERS))
_BASE = len(_LETTERS)


def _name(code: int) -> str:
    return _LETTERS[code // _BASE**2] + _LETTERS[code // _BASE % _BASE] + _LETTERS[code % _BASE]


def _gathered(uids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """(gram, uids): a row for each trigram of the texts, of spaces, digits and small letters."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = _CODE[np.frombuffer(b"".join(texts), np.uint8)]
    of = np.repeat(np.arange(len(texts)), sizes)
    gram = codes[:-2] * _BASE**2 + codes[1:-1] * _BASE + codes[2:] if len(codes) > 2 else np.zeros(0, np.int32)
    inside = of[2:] == of[:-2] if len(codes) > 2 else np.zeros(0, bool)
    pairs = np.unique(gram[inside].astype(np.int64) * len(texts) + of[: len(gram)][inside])
    gram, own = np.divmod(pairs, max(len(texts), 1))
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    ends = np.concatenate([first[1:], [len(gram)]]).astype(np.int64)
    own = uids[own]
    return pa.RecordBatch.from_arrays([pa.array([_name(int(g)) for g in gram[first]], pa.string()), pa.array([own[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], ["gram", "uids"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, flat) as (gram, uids), some megabytes of text at a time."""
    uids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for uid, flat in zip(batch.column("uid").to_pylist(), batch.column("flat").to_pylist()):
            text = (flat or "").encode()
            if held and held + len(text) > PIECE:
                yield _gathered(np.array(uids, np.int64), texts)
                uids, texts, held = [], [], 0
            uids.append(uid)
            texts.append(text)
            held += len(text)
    if uids:
        yield _gathered(np.array(uids, np.int64), texts)


def counted(lists: list[list[str]]):
    """A function of batches (gram, uids) that counts, for each list of trigrams, how many of them each unit holds."""
    of = {g: [i for i, own in enumerate(lists) if g in own] for own in lists for g in own}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(of[g], np.frombuffer(u, np.int64)) for g, u in zip(batch.column("gram").to_pylist(), batch.column("uids").to_pylist())]
            if not rows:
                continue
            uid, at = np.unique(np.concatenate([u for _, u in rows]), return_inverse=True)
            sums = np.zeros((len(lists), len(uid)), np.int64)
            begin = 0
            for which, u in rows:
                for i in which:
                    sums[i, at[begin : begin + len(u)]] += 1  # a row's units are distinct
                begin += len(u)
            yield pa.RecordBatch.from_arrays([pa.array(uid), *(pa.array(s) for s in sums)], ["uid", *(f"_g{i}" for i in range(len(lists)))])

    return count
