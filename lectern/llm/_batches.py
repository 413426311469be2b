"""Cutting Arrow batches into pieces of bounded bytes, so that a worker's memory does not follow the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that a kernel works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system: a worker process goes on to other tasks, and what it keeps counts for the executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about limit bytes in column each, in order."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < len(sizes):
            yield batch.slice(begin)
    give_back()


def texts_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(column).to_pylist()


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of batches that are sorted by key, each whole."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and keys[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)
        held = []
    give_back()
