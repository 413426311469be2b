"""Removal of repeated word windows, found through anchors at the places of a difference cover."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import pieces, texts_of
from ._exchange import ANSWERS, ENTRIES, Entries, Known, buckets, merged, pack, places_of
from ._io import release, shuffle_partitions, table, text_bytes
from ._joins import flagged, heavy_keys, salted_join, sieved
from ._words import Words

#: Any difference modulo 7 is one of two members: two places can be moved by the same step below 7 into the cover.
PERIOD, COVER = 7, (1, 2, 4)
LAST = (1 << 63) - 1


def _starts(w: Words, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of each start of k words in texts of `least` words or more."""
    n = np.where(w.counts >= least, np.maximum(w.counts - k + 1, 0), 0)
    text = np.repeat(np.arange(len(n)), n)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = True) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256, kept_text) for each row of docs; without with_text no kept_text.

    A word goes if a window of `window` consecutive words covers it whose words also begin in a document with a smaller
    id; kept words are joined by one space. Windows of `window` words that occur twice share an anchor: `window` - 6
    words at a place of the cover in both. First exchange: anchors that two texts hold. Second: windows around those
    anchors are compared by hash, and the smallest id of each is found. All windows of all texts are judged.

    A hash that very many texts share costs an entry for each map task; texts with very many copies are dealt over
    several tasks in the joins, whose number of partitions follows the bytes of text.

    ids must be integers. Null or empty text: no words. A null id counts as larger than all others and removes nothing
    from them; rows with equal ids remove nothing from one another. Empty table: no rows. Other columns are left out.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window needs {PERIOD + 1} words or more")
    spark, anchor = docs.sparkSession, window - PERIOD + 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    n_bytes = text_bytes(rows, "text")
    n_buckets, tasks = buckets(n_bytes, shuffle_partitions(spark)), shuffle_partitions(spark, n_bytes)
    copied = heavy_keys(rows, "key", "text", n_bytes, tasks)  # texts with very many copies under one id

    def send_anchors(batches):
        shared_before = Known()
        for batch in pieces(batches, "text"):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            w = Words(texts_of(batch, "text"))
            text, place = _starts(w, anchor, window)
            chosen = np.isin(place % PERIOD, COVER)
            text, place = text[chosen], place[chosen]
            if not len(text):
                continue
            h = w.windows(anchor)[w.first[text] + place] & np.uint64(~0xFF & (2**64 - 1))
            # What two texts of the task's input share is known to be shared; one entry stands for it.
            held, _ = shared_before.find(h)
            if held.any():
                yield _told(keys, text[held], place[held], n_buckets, True)
                text, place, h = text[~held], place[~held], h[~held]
                if not len(text):
                    continue
            order = np.lexsort((text, h))
            hs, ts = h[order], text[order]
            first = np.concatenate([[True], hs[1:] != hs[:-1]])
            group = np.cumsum(first) - 1
            many = np.concatenate([[False], (hs[1:] == hs[:-1]) & (ts[1:] != ts[:-1])])
            known = np.zeros(group[-1] + 1, bool)
            known[group[many]] = True
            sure = known[group]
            alone = ~sure | first
            told_once = hs[first & sure]
            shared_before.add(told_once, np.zeros(len(told_once), np.int64))
            yield pack(n_buckets, hs[alone], place[order][alone], ts[alone], keys, None, sure[alone], True)
            rest = order[~alone]
            yield _told(keys, text[rest], place[rest], n_buckets, True)

    def match_anchors(batches):
        e = Entries(batches, True)
        told = e.h == 0
        yield e.answers(np.flatnonzero(told), n_buckets)
        at = np.flatnonzero(~told)
        if len(at):
            order = at[np.lexsort((e.text[at], e.h[at]))]
            h, text, sure = e.h[order], e.text[order], e.sure[order]
            group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            shared = np.zeros(group[-1] + 1, bool)
            shared[group[sure]] = True
            shared[group[1:][(h[1:] == h[:-1]) & (text[1:] != text[:-1])]] = True
            yield e.answers(order[shared[group]], n_buckets)

    anchors = rows.select("key", "text").mapInArrow(send_anchors, ENTRIES).repartition(n_buckets, "bucket").mapInArrow(match_anchors, ANSWERS)
    anchors = table(merged(anchors, n_buckets), "anchors")

    def send_windows(batches):
        sent = Known()
        for batch in pieces(batches, "text"):
            w = Words(texts_of(batch, "text"))
            begin, at = [np.zeros(0, np.int64)], batch.column("places")
            text = [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                p = places_of(at, i)
                s = np.unique((p[:, None] - np.arange(PERIOD)[None, :]).ravel())
                s = s[(s >= 0) & (s + window <= w.counts[i])]
                begin.append(s)
                text.append(np.full(len(s), i))
            place, text = np.concatenate(begin), np.concatenate(text)
            if not len(text):
                continue
            h = w.windows(window)[w.first[text] + place] | np.uint64(1)
            ids = np.array([LAST if x is None else x for x in batch.column("id").to_pylist()], np.int64)
            keys = batch.column("key").to_numpy()
            # Only texts of the smallest id that the task has seen for a window have to ask.
            order = np.lexsort((ids[text], h))
            hs, ts = h[order], text[order]
            first = np.concatenate([[True], hs[1:] != hs[:-1]])
            group = np.cumsum(first) - 1
            least = ids[ts[first]]
            held, before = sent.find(hs[first])
            least = np.where(held, np.minimum(least, before), least)
            repeated = held | (np.bincount(group) > 1)
            sent.add(hs[first][repeated], least[repeated])
            smallest = ids[ts] == least[group]
            yield pack(n_buckets, hs[smallest], place[order][smallest], ts[smallest], keys, ids, np.zeros(int(smallest.sum()), bool))
            rest = order[~smallest]
            yield _told(keys, text[rest], place[rest], n_buckets)

    def match_windows(batches):
        e = Entries(batches)
        told = e.h == 0
        yield e.answers(np.flatnonzero(told), n_buckets)
        at = np.flatnonzero(~told)
        if len(at):
            ids = e.ids[e.text]
            order = at[np.lexsort((ids[at], e.h[at]))]
            first = np.concatenate([[True], np.diff(e.h[order]) != 0])
            least = ids[order[first]][np.cumsum(first) - 1]
            yield e.answers(order[ids[order] > least], n_buckets)

    sides = salted_join(sieved(rows, F.col("key"), anchors, F.col("key"), anchors.count()), anchors, "key", copied, tasks=tasks)
    windows = sides.mapInArrow(send_windows, ENTRIES).repartition(n_buckets, "bucket").mapInArrow(match_windows, ANSWERS)
    windows = table(merged(windows, n_buckets), "windows")
    release(anchors)

    def remove(batches):
        for batch in pieces(batches, "text"):
            w = Words(texts_of(batch, "text"))
            out: list[list] = [[], [], []]
            for i in range(batch.num_rows):
                gone = np.zeros(w.counts[i] + 1, np.int64)
                p = places_of(batch.column("places"), i)
                np.add.at(gone, p, 1)
                np.add.at(gone, p + window, -1)
                stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + w.first[i]
                raw, shift = w.raw[i], w.offsets[i]
                if len(stays) == w.counts[i]:
                    kept = b" ".join(raw.split())  # bytes.split() takes the same six bytes for blanks
                else:
                    kept = b" ".join(raw[a:b] for a, b in zip((w.starts[stays] - shift).tolist(), (w.ends[stays] - shift).tolist()))
                out[0].append(int(w.counts[i] - len(stays)))
                out[1].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out[2].append(kept.decode())
            columns = [batch.column("id"), pa.array(w.counts, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out[2], pa.string())] * with_text, names)

    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    shape = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    parted = flagged(rows, F.col("key"), windows, F.col("key"), windows.count(), "marked")
    marked = salted_join(parted.filter("marked").drop("marked"), windows, "key", copied, "left", tasks).select("id", "text", "places")
    clean = parted.filter("not marked").select("id", "text", F.lit(None).cast("binary").alias("places"))  # these need not meet any
    return marked.mapInArrow(remove, shape).union(clean.mapInArrow(remove, shape)).withColumnRenamed("id", id_col)


def _told(keys: np.ndarray, text: np.ndarray, place: np.ndarray, n_buckets: int, narrow: bool = False) -> pa.RecordBatch:
    """Answers that need no question: entries of hash 0 in a bucket of their text's key."""
    at = (keys[text].view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
    parts = []
    for b in np.unique(at):
        own = at == b
        n = int(own.sum())
        one = pack(1, np.zeros(n, np.uint64), place[own], text[own], keys, None if narrow else keys, np.ones(n, bool), narrow)
        parts.append(one.set_column(0, "bucket", pa.array([int(b)], pa.int32())))
    if not parts:
        return pack(1, np.zeros(0, np.uint64), place[:0], text[:0], keys, None, np.zeros(0, bool), narrow)
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
