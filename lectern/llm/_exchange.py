"""Exchanging hashed places of texts between tasks in packed rows.

A map task sends, for each bucket of hashes, one row with arrays of entries (hash, place in the text, text). A reduce
task compares the entries of a bucket and answers with rows that hold the places of many texts, one row for each
bucket of texts; they are merged there into one row for each text. What a task already knows of its own entries it
sends as an answer at once, so a hash that very many texts share costs an entry for each piece of input, not for each
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import mix

ENTRIES = "bucket int, keys binary, ids binary, counts binary, hashes binary, low binary, high binary, sure binary"
ANSWERS = "dest int, keys binary, counts binary, places binary"


def buckets(total_bytes: int, partitions: int, each: int = 16 << 20) -> int:
    """Buckets, so that one holds the entries of about `each` bytes of text."""
    return int(max(partitions, total_bytes // each + 1))


class Known:
    """Hashes that a map task has seen in two texts, with the smallest id of each; a bounded number of them.

    What is known to be shared needs no entry of its own, so a hash that very many texts share costs an entry for each
    map task, not for each piece of its input. A hash that does not fit is sent again; results don't depend on it.
    """

    def __init__(self, most: int = 1 << 18):
        self.h, self.least, self.most = np.zeros(0, np.uint64), np.zeros(0, np.int64), most

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and its smallest id (of no meaning where it is not)."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return self.h[at] == h, self.least[at]

    def add(self, h: np.ndarray, ids: np.ndarray) -> None:
        """Distinct sorted hashes with ids; smaller ids replace held ones."""
        held, _ = self.find(h)
        at = np.searchsorted(self.h, h[held])
        self.least[at] = np.minimum(self.least[at], ids[held])
        new = np.flatnonzero(~held)[: self.most - len(self.h)]
        if len(new):
            both, least = np.concatenate([self.h, h[new]]), np.concatenate([self.least, ids[new]])
            order = np.argsort(both, kind="stable")
            self.h, self.least = both[order], least[order]


def pack(n_buckets: int, h: np.ndarray, place: np.ndarray, text: np.ndarray, keys: np.ndarray, ids: np.ndarray | None, sure: np.ndarray, narrow: bool = False) -> pa.RecordBatch:
    """Entries as rows, one for each bucket, in order of texts and places, so that they compress.

    keys and ids belong to the texts that text numbers; sure: see module. narrow keeps 32 bits of a hash beside those
    that chose the bucket, for filters that may let some others pass. A hash of 0 stays 0, others don't become 0.
    """
    bucket = ((h >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.lexsort((place, text, bucket))
    h, place, text, sure, bucket = h[order], place[order], text[order], sure[order], bucket[order]
    if narrow:
        h = np.where(h == 0, 0, (h >> np.uint64(8)) | np.uint64(1)).astype(np.uint32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
    columns: list[list] = [[] for _ in range(8)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, counts = np.unique(text[a:b], return_counts=True)
        values = (
            int(bucket[a]), keys[own].tobytes(), b"" if ids is None else ids[own].tobytes(), counts.astype(np.uint32).tobytes(), h[a:b].tobytes(),
            (place[a:b] & 0xFFFF).astype(np.uint16).tobytes(), (place[a:b] >> 16).astype(np.uint16).tobytes(), np.packbits(sure[a:b]).tobytes(),
        )
        for c, v in zip(columns, values):
            c.append(v)
    kinds = [pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in ENTRIES.split(", ")])


class Entries:
    """All entries of a reduce task. text numbers the texts over all rows; keys and ids are those of the texts."""

    def __init__(self, batches: Iterator[pa.RecordBatch], narrow: bool = False):
        parts: dict[str, list] = {k: [] for k in ("keys", "ids", "text", "h", "place", "sure")}
        texts = 0
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.int64)
                counts = np.frombuffer(row["counts"], np.uint32)
                parts["keys"].append(keys)
                parts["ids"].append(np.frombuffer(row["ids"], np.int64))
                parts["text"].append(np.repeat(np.arange(texts, texts + len(keys), dtype=np.int32), counts))
                parts["h"].append(np.frombuffer(row["hashes"], np.uint32 if narrow else np.uint64))
                low, high = (np.frombuffer(row[c], np.uint16).astype(np.uint32) for c in ("low", "high"))
                parts["place"].append(low + (high << np.uint32(16)))
                parts["sure"].append(np.unpackbits(np.frombuffer(row["sure"], np.uint8), count=len(low)).astype(bool))
                texts += len(keys)
        cat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}
        self.keys, self.ids, self.text, self.h, self.place, self.sure = (cat[k] for k in ("keys", "ids", "text", "h", "place", "sure"))

    def answers(self, which: np.ndarray, n_buckets: int) -> pa.RecordBatch:
        return answers(self.keys[self.text[which]], self.place[which].astype(np.uint32), n_buckets)


def answers(keys: np.ndarray, places: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Places by key, packed in one row for each bucket of keys that they go back to."""
    dest = (mix(keys.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.lexsort((keys, dest))
    keys, places, dest = keys[order], places[order], dest[order]
    first = _firsts(keys)
    cut = np.flatnonzero(np.diff(dest[first])) + 1
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    ends = np.concatenate([first[cut], [len(keys)]]).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(keys) else ends
    split = lambda x: [p.tobytes() for p in np.split(x, cut)] if len(keys) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array(dest[starts], pa.int32()),
            pa.array(split(keys[first]), pa.binary()),
            pa.array(split(counts.astype(np.uint32)), pa.binary()),
            pa.array([places[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        ],
        ["dest", "keys", "counts", "places"],
    )


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def merged(found: DataFrame, n_buckets: int, kind: type = np.uint32) -> DataFrame:
    """(key, places): one row for each key that has answers, with its distinct places in order."""

    def merge(batches):
        keys, places = [np.zeros(0, np.int64)], [np.zeros(0, kind)]
        for batch in batches:
            for row in batch.to_pylist():
                keys.append(np.repeat(np.frombuffer(row["keys"], np.int64), np.frombuffer(row["counts"], np.uint32)))
                places.append(np.frombuffer(row["places"], kind))
        keys, places = np.concatenate(keys), np.concatenate(places)
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        if len(keys):
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])])
            keys, places = keys[new], places[new]
        first = _firsts(keys)
        for a in range(0, len(first), 4096):
            begins = first[a : a + 4096]
            ends = np.concatenate([first[a + 1 : a + 4096], [first[a + 4096] if a + 4096 < len(first) else len(keys)]])
            yield pa.RecordBatch.from_arrays([pa.array(keys[begins]), pa.array([places[x:y].tobytes() for x, y in zip(begins, ends)], pa.binary())], ["key", "places"])

    return found.repartition(n_buckets, "dest").mapInArrow(merge, "key long, places binary")


def places_of(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_py() or b"", np.uint32).astype(np.int64)
