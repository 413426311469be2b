"""Removal of long repeated byte strings with a run-length compressed index over the contexts they can lie in."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import pieces, texts_of
from ._exchange import ANSWERS, Known, answers, buckets, merged
from ._io import release, shuffle_partitions, table, text_bytes
from ._joins import flagged, heavy_keys, salted_join, sieved
from ._words import mix
from .run_index import RunIndex

#: Different contexts of one anchor that are indexed together; with more, each window is compared by its hash.
HOT = 4096
#: Bytes of contexts in one index.
INDEX_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240603))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of a place in a piece; a text has less than 2**31 bytes.
_PLACE = np.uint64(31)
_SIZE = np.uint64(0xA0761D6478BD642F)

_ROW = "bucket int, keys binary, texts binary, h binary, c binary, v binary"
_ANSWER = ANSWERS + ", kind int"
FULL, ASK, ASK_HOT = 0, 1, 2


class Bytes:
    """A batch of texts as bytes, with hashes of any of their substrings."""

    def __init__(self, texts: list):
        self.raw = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.offsets = np.cumsum(self.sizes) - self.sizes
        n = len(self.data)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]))
        self.run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[self.data] * power[:n], dtype=np.uint64)])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of data[start:start + length]."""
        return mix((self.run[start + length] - self.run[start]) * self.back[start] + np.asarray(length).astype(np.uint64) * _SIZE)

    def contexts(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, length, anchor): maximal runs of windows with the same anchor, in places of data.

        A window's anchor is its gram of least hash, the first of them in a tie; it depends on the window's bytes alone.
        """
        n = len(self.data) - gram + 1
        none = np.zeros(0, np.int64)
        if len(self.data) < window:
            return none, none, none, none
        h = self.hash(np.arange(n), gram)
        v = (h >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
        width = window - gram + 1
        least = _sliding_least(v, width)
        starts = np.repeat(self.offsets, np.maximum(self.sizes - window + 1, 0))
        count = np.maximum(self.sizes - window + 1, 0)
        s = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count) + starts
        text = np.repeat(np.arange(len(self.sizes)), count)
        anchor = (least[s] & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(s) else none
        last = np.concatenate([first[1:] - 1, [len(s) - 1]]) if len(s) else none
        return text[first], s[first], s[last] - s[first] + window, anchor[first]


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(v)
    full = np.concatenate([v, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def _packed(start: np.ndarray, length: np.ndarray, offset: np.ndarray, sure: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(32)) | (length.astype(np.uint64) << np.uint64(16)) | (offset.astype(np.uint64) << np.uint64(1)) | sure.astype(np.uint64)


def _unpacked(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (v >> np.uint64(32)).astype(np.int64), ((v >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64), ((v >> np.uint64(1)) & np.uint64(0x7FFF)).astype(np.int64), (v & np.uint64(1)).astype(bool)


def _rows(n_buckets: int, keys: np.ndarray, text: np.ndarray, h: np.ndarray, c: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Entries as one row for each bucket; an entry whose h is 0 is an answer, sent by its text."""
    by = np.where(h == 0, mix(keys[text].view(np.uint64)), h)
    bucket = ((by >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    text, h, c, v, bucket = text[order], h[order], c[order], v[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(h)]]) if len(h) else np.zeros(1, np.int64)
    columns: list[list] = [[] for _ in range(6)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        own, number = np.unique(text[a:b], return_inverse=True)
        values = (int(bucket[a]), keys[own].tobytes(), number.astype(np.uint32).tobytes(), h[a:b].tobytes(), c[a:b].tobytes(), v[a:b].tobytes())
        for col, x in zip(columns, values):
            col.append(x)
    kinds = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], [f.split()[0] for f in _ROW.split(", ")])


class _Received:
    def __init__(self, batches):
        keys, text, h, c, v, seen = [], [], [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                keys.append(np.frombuffer(row["keys"], np.int64))
                text.append(np.frombuffer(row["texts"], np.uint32).astype(np.int64) + seen)
                for out, name in ((h, "h"), (c, "c"), (v, "v")):
                    out.append(np.frombuffer(row[name], np.uint64))
                seen += len(keys[-1])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.keys, self.text, self.h, self.c, self.v = cat(keys, np.int64), cat(text, np.int64), cat(h, np.uint64), cat(c, np.uint64), cat(v, np.uint64)

    def answers(self, which: np.ndarray, kind: int, n_buckets: int, v: np.ndarray | None = None) -> pa.RecordBatch:
        return _answers(self.keys[self.text[which]], (self.v if v is None else v)[which], kind, n_buckets)


def _answers(keys: np.ndarray, v: np.ndarray, kind: int, n_buckets: int) -> pa.RecordBatch:
    packed = answers(keys, v, n_buckets)
    return packed.append_column("kind", pa.array([kind] * packed.num_rows, pa.int32()))


def _same(x: np.ndarray) -> np.ndarray:
    """Group numbers of sorted values."""
    return np.cumsum(np.concatenate([[True], x[1:] != x[:-1]])) - 1


def _combined(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (h, c), the number of each entry's h in it, and of its (h, c)."""
    order = np.lexsort((c, h))
    hs, cs = h[order], c[order]
    new_h = np.concatenate([[True], hs[1:] != hs[:-1]])
    new_c = new_h | np.concatenate([[True], cs[1:] != cs[:-1]])
    return order, np.cumsum(new_h) - 1, np.cumsum(new_c) - 1


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    Each byte goes that a string of `window` bytes covers which also starts at any other place of any text, the same
    one included. All windows of all texts are judged, on the input.

    A window's anchor, a gram of half its length of least hash, depends on its bytes alone, so equal windows have equal
    anchors. Windows of a place are sent as contexts, runs with one anchor. First exchange: contexts by anchor. Equal
    contexts are repeated as a whole; anchors with one context are done. Different contexts of an anchor meet in the
    second exchange: there a run-length compressed Burrows-Wheeler transform is built over them, its suffixes are
    sampled at the ends of runs, and matching statistics streamed from the samples mark windows that start elsewhere.
    An anchor with over HOT contexts has its windows compared by hash instead, spread over all tasks.

    Null or empty text: 0 bytes, the digest of nothing. Repeated rows and copies lose everything from `window` bytes
    on. Null ids: a row each. Empty table: no rows. Other columns are left out.
    """
    if not 2 <= window < 1 << 14:
        raise ValueError("a window has 2 to 16,383 bytes")  # contexts are up to twice as long, and their lengths have 15 bits
    spark, gram = docs.sparkSession, window // 2
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Equal texts are one class of known size, so a key stands for one text.
    rows = rows.withColumn("key", F.xxhash64(F.lit(7), "text"))
    kind = rows.schema["id"].dataType.simpleString()
    n_bytes = text_bytes(rows, "text")
    n_buckets, tasks = buckets(n_bytes, shuffle_partitions(spark)), shuffle_partitions(spark, n_bytes)
    copied, hot = heavy_keys(rows, "key", "text", n_bytes, tasks), HOT

    def send_contexts(batches):
        sent = Known()  # contexts that the task has told to be repeated
        for batch in pieces(batches, "text"):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            texts = Bytes(texts_of(batch, "text"))
            text, start, length, anchor = texts.contexts(window, gram)
            if not len(text):
                continue
            h = texts.hash(anchor, gram) | np.uint64(1)
            c = texts.hash(start, length) + mix((anchor - start).astype(np.uint64))
            order, _, same = _combined(h, c)
            first = np.concatenate([[True], same[1:] != same[:-1]])
            held, _ = sent.find(mix(h[order] ^ mix(c[order])))
            sure = held | (np.bincount(same)[same] > 1)
            v = _packed(start - texts.offsets[text], length, anchor - start, np.zeros(len(text)))[order] | sure.astype(np.uint64)
            yield _rows(n_buckets, keys, text[order], np.where(first & ~held, h[order], 0), c[order], v)
            new = np.sort(mix(h[order] ^ mix(c[order]))[first & sure & ~held])
            sent.add(new, np.zeros(len(new), np.int64))

    def match_contexts(batches):
        e = _Received(batches)
        told = e.h == 0
        yield e.answers(np.flatnonzero(told), FULL, n_buckets)
        at = np.flatnonzero(~told)
        if not len(at):
            return
        order, group, same = _combined(e.h[at], e.c[at])
        order = at[order]
        first = np.concatenate([[True], same[1:] != same[:-1]])
        twice = (np.bincount(same) > 1) | (np.bincount(same, weights=(e.v[order] & np.uint64(1)).astype(float)) > 0)
        yield e.answers(order[twice[same]], FULL, n_buckets)
        kinds = np.bincount(group, weights=first)[group]
        v = (e.v & ~np.uint64(1)).copy()
        v[order] |= twice[same].astype(np.uint64)
        yield e.answers(order[first & (kinds > 1) & (kinds <= hot)], ASK, n_buckets, v)
        yield e.answers(order[first & (kinds > hot)], ASK_HOT, n_buckets, v)

    found = rows.select("key", "text").mapInArrow(send_contexts, _ROW).repartition(n_buckets, "bucket").mapInArrow(match_contexts, _ANSWER)
    found = table(found, "contexts")
    asked = [table(merged(found.filter(F.col("kind") == k), n_buckets, np.uint64), f"asked{k}") for k in (ASK, ASK_HOT)]
    # One copy of each text speaks for all; of texts with very many copies only those of one id are sent at all.
    one = rows.select("id", "key", "text")
    if copied is not None:
        first = rows.join(F.broadcast(copied), "key").groupBy("key").agg(F.min("id").alias("first"))
        one = one.join(F.broadcast(first), "key", "left").filter("first is null or first = id").drop("first")
    one = one.select("key", "text")
    near = [sieved(one, F.col("key"), a, F.col("key"), a.count()) for a in asked]  # most texts stay where they are
    unique = [texts.repartition(tasks, "key").join(a.repartition(tasks, "key"), "key").dropDuplicates(["key"]) for texts, a in zip(near, asked)]

    def send_bytes(batches):
        for batch in pieces(batches, "text"):
            out: dict[int, list] = {}
            for key, text, places in zip(*(batch.column(k).to_pylist() for k in ("key", "text", "places")), strict=True):
                v = np.frombuffer(places, np.uint64)
                start, length, offset, _ = _unpacked(v)
                raw = text.encode()
                for s, n, o, one in zip(start.tolist(), length.tolist(), offset.tolist(), v.tolist()):
                    anchor = int.from_bytes(hashlib.blake2b(raw[s + o : s + o + gram], digest_size=8).digest(), "little")
                    held = out.setdefault(anchor % n_buckets, [[], [], [], []])
                    for x, y in zip(held, (key, anchor, one, raw[s : s + n])):
                        x.append(y)
            parts = list(out.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(out), pa.int32()), pa.array([np.array(p[0], np.int64).tobytes() for p in parts], pa.binary())]
                + [pa.array([np.array(p[k], np.uint64).tobytes() for p in parts], pa.binary()) for k in (1, 2)]
                + [pa.array([b"".join(p[3]) for p in parts], pa.binary())],
                ["bucket", "keys", "h", "v", "data"],
            )

    def index_bytes(batches):
        keys, h, v, data = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                keys.append(np.frombuffer(row["keys"], np.int64))
                h.append(np.frombuffer(row["h"], np.uint64))
                v.append(np.frombuffer(row["v"], np.uint64))
                data.append(row["data"])
        if not keys:
            return
        keys, h, v = np.concatenate(keys), np.concatenate(h), np.concatenate(v)
        data = np.frombuffer(b"".join(data), np.uint8)
        start, length, offset, sure = _unpacked(v)
        begin = np.cumsum(length) - length
        order = np.argsort(h, kind="stable")
        size = np.cumsum(length[order])
        group = _same(h[order])
        ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) + 1  # an index takes whole anchors
        cut, held = 0, 0
        for end in ends.tolist():
            if size[end - 1] - held < INDEX_BYTES and end < len(order):
                continue
            own = order[cut:end]
            n = length[own]
            starts = np.cumsum(n) - n
            where = np.arange(int(n.sum())) + np.repeat(begin[own] - starts, n)
            marks = np.flatnonzero(RunIndex(data[where], starts).statistics() >= window)
            of = np.searchsorted(starts, marks, side="right") - 1
            keep = ~sure[own][of]
            marks, of = marks[keep], of[keep]
            if len(marks):
                first = np.concatenate([[True], (np.diff(marks) > 1) | (np.diff(of) > 0)])
                last = np.concatenate([first[1:], [True]])
                a, b = marks[first], marks[last]
                x = own[of[first]]
                yield _answers(keys[x], _packed(start[x] + a - starts[of[first]], b - a + window, np.zeros(len(a)), np.zeros(len(a))), FULL, n_buckets)
            cut, held = end, int(size[end - 1])

    shape = "bucket int, keys binary, h binary, v binary, data binary"
    marked = unique[0].mapInArrow(send_bytes, shape).repartition(n_buckets, "bucket").mapInArrow(index_bytes, _ANSWER)

    def send_windows(batches):
        for batch in pieces(batches, "text", 1 << 18):
            keys = batch.column("key").to_numpy()
            texts = Bytes(texts_of(batch, "text"))
            text, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, places in enumerate(batch.column("places").to_pylist()):
                start, length, _, _ = _unpacked(np.frombuffer(places, np.uint64))
                count = length - window + 1
                at.append(np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
                text.append(np.full(len(at[-1]), i))
            text, at = np.concatenate(text), np.concatenate(at)
            h = texts.hash(texts.offsets[text] + at, window) | np.uint64(1)
            order, _, same = _combined(h, h)
            first = np.concatenate([[True], same[1:] != same[:-1]]) if len(h) else np.zeros(0, bool)
            sure = np.bincount(same)[same] > 1 if len(h) else np.zeros(0, bool)
            v = _packed(at, np.full(len(at), window), np.zeros(len(at)), np.zeros(len(at)))[order] | sure.astype(np.uint64)
            yield _rows(n_buckets, keys, text[order], np.where(first, h[order], 0), h[order], v)

    def match_windows(batches):
        e = _Received(batches)
        yield e.answers(np.flatnonzero(e.h == 0), FULL, n_buckets)
        at = np.flatnonzero(e.h != 0)
        if len(at):
            order, _, same = _combined(e.h[at], e.h[at])
            twice = (np.bincount(same) > 1) | (np.bincount(same, weights=(e.v[at[order]] & np.uint64(1)).astype(float)) > 0)
            yield e.answers(at[order][twice[same]], FULL, n_buckets)

    written = [table(marked, "marked")]
    spans = found.filter(F.col("kind") == FULL).union(written[0])
    if asked[1].limit(1).count():
        windows = unique[1].mapInArrow(send_windows, _ROW).repartition(n_buckets, "bucket").mapInArrow(match_windows, _ANSWER)
        written.append(table(windows, "hot-windows"))
        spans = spans.union(written[-1])
    spans = table(merged(spans.drop("kind"), n_buckets, np.uint64), "spans")
    release(found, *written, *asked)

    def remove(batches):
        for batch in pieces(batches, "text"):
            out: list[list] = [[], [], [], []]
            for text, places in zip(texts_of(batch, "text"), batch.column("places").to_pylist(), strict=True):
                raw = (text or "").encode()
                gone = np.zeros(len(raw) + 1, np.int64)
                if places:
                    start, length, _, _ = _unpacked(np.frombuffer(places, np.uint64))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + length, -1)
                stays = np.cumsum(gone)[:-1] == 0
                edge = np.flatnonzero(np.diff(np.concatenate([[True], stays, [True]]).astype(np.int8)))
                kept = np.frombuffer(raw, np.uint8)[stays].tobytes() if len(edge) else raw
                for col, x in zip(out, (len(raw), len(raw) - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest())):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    shape = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    parted = flagged(rows, F.col("key"), spans, F.col("key"), spans.count(), "marked")
    marked = salted_join(parted.filter("marked").drop("marked"), spans, "key", copied, "left", tasks).select("id", "text", "places")
    clean = parted.filter("not marked").select("id", "text", F.lit(None).cast("binary").alias("places"))  # these need not meet any
    return marked.mapInArrow(remove, shape).union(clean.mapInArrow(remove, shape)).withColumnRenamed("id", id_col)
