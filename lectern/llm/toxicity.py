"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import pieces, texts_of
from ._io import release, shuffle_partitions, table

#: Labelled rows that the classifier is fitted on at most, those of the lowest hashes.
MAX_ROWS = 20_000
#: N-grams are runs of LENGTHS characters of the lower-cased text, white space as one kind of blank; hashed to 2**BITS
#: places.
LENGTHS, BITS = (3, 4, 5, 6), 20
#: N-grams that are kept: all in LEAST_DOCS texts or more whose log-count ratio is at least LEAST_Z standard errors and
#: LEAST_RATIO (twice as frequent under one label) from 0.
LEAST_Z, LEAST_RATIO, LEAST_DOCS = 3.5, float(np.log(2)), 4
THRESHOLD = 0.7
#: Bytes of text at once: where all n-grams are held, and where only the kept ones are.
ALL_BYTES, KEPT_BYTES = 1 << 18, 1 << 19
#: Texts at once where kept n-grams are looked up.
FEW = 128
#: Entries of the fitted rows that a step of the regression looks at together.
ENTRIES = 1 << 21

_CHUNKS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned: crc32 of the id as text, mod 3, is 1. A null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _hashed(texts: list):
    """(text, place) arrays of the n-grams of a batch, length by length, with repeats; before that, the places of all starts."""
    raw = [f" {(t or '').lower()} ".encode("utf-32-le", errors="replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint32)
    data = np.where((data >= 9) & (data <= 13), np.uint32(32), data)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)
    h = np.zeros(len(data), np.uint64)
    for j in range(max(LENGTHS)):
        h = h[: len(data) - j] * _STEP + data[j:] + np.uint64(1)
        if j + 1 in LENGTHS:
            yield j, ((h ^ (h >> np.uint64(29))) * _ODD[LENGTHS.index(j + 1)]) >> np.uint64(64 - BITS), ends


def ngram_hits(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place) pairs of a batch, sorted."""
    both = [np.zeros(0, np.int64)]
    for j, at, ends in _hashed(texts):
        where = np.arange(len(at))
        text = np.searchsorted(ends, where, side="right")
        inside = where + j < ends[text]
        both.append((text[inside] << BITS) | at[inside].astype(np.int64))
    both = np.unique(np.concatenate(both))
    return both >> BITS, both & ((1 << BITS) - 1)


def kept_hits(texts: list, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs of a batch for the places that have a code of 0 or more, in no order.

    Each pair notes where it stands last; only the note that is still there counts. So nothing is sorted.
    """
    own, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for j, at, ends in _hashed(texts):
        code = codes[at]
        where = np.flatnonzero(code >= 0)
        text = np.searchsorted(ends, where, side="right")
        inside = where + j < ends[text]
        own.append(text[inside])
        held.append(code[where[inside]])
    own, held = np.concatenate(own), np.concatenate(held)
    if len(own):
        flat = own * (int(held.max()) + 1) + held
        note = np.empty(int(flat.max()) + 1, np.int32)
        number = np.arange(len(flat), dtype=np.int32)
        note[flat] = number
        last = note[flat] == number
        own, held = own[last], held[last]
    return own, held


@dataclass
class Model:
    """codes: the number of each place's weight, -1 where it has none."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def constant(bias: float) -> "Model":
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), bias)

    def scores(self, texts: list) -> np.ndarray:
        z = np.zeros(len(texts))
        if len(self.weights):
            own, code = kept_hits(texts, self.codes)
            z = np.bincount(own, weights=self.weights[code], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def few(batches, limit: int, column: str = "text"):
    """Pieces of the batches with about `limit` bytes of text and FEW rows at most."""
    for batch in pieces(batches, column, limit):
        for i in range(0, batch.num_rows, FEW):
            yield batch.slice(i, FEW)


def lowest(rows: DataFrame, h: str, most: int) -> DataFrame:
    """The rows whose hashes h (60 bits) are lowest, at most `most` of them, without a sort.

    Rows are counted by hash, 15 bits at a time; each time only the bucket in which `most` is passed is split.
    """
    if rows.count() <= most:
        return rows
    cut = 0
    for shift in (45, 30, 15, 0):
        inside = rows.filter((F.col(h) >= cut) & (F.col(h) < cut + (1 << (shift + 15))))
        counts = {r.b: r.n for r in inside.groupBy(F.shiftright(F.col(h) - cut, shift).alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts):  # 2**15 numbers at most
            if counts[b] > most:
                cut += b << shift
                break
            most -= counts[b]
        else:
            cut += 1 << (shift + 15)
            break
    return rows.filter(F.col(h) < cut)


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 60) - 1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """A model from labelled rows that aren't held out, max_rows at most.

    Counts of documents by n-gram and label are summed over the executors; the driver gets those counts (2**BITS
    places) and ships the places that are kept. The regression over the fitted rows, which max_rows bounds, runs in one
    task; the driver gets the weights. A document with several labels counts as toxic if one of them says so; null
    labels and ids are left out; repeated rows count once. With one label only, every score is that label's share; with
    none, or empty tables, every score is 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", _hash("id"))
    known = lowest(known, "h", max_rows).select("id", "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    rows = rows.dropDuplicates(["id", "text"]).select("y", _hash("id", "text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    held = table(rows.repartition(shuffle_partitions(spark), "h"), "labelled-texts")
    rows = lowest(held, "h", max_rows)

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int32)
        n = [0, 0]
        for batch in pieces(batches, "text", ALL_BYTES):
            y = np.array(batch.column("y").to_pylist(), np.int64) > 0
            own, place = ngram_hits(texts_of(batch, "text"))
            for k in (0, 1):
                total[k] += np.bincount(place[y[own] == k], minlength=1 << BITS).astype(np.int32)
                n[k] += int((y == k).sum())
        if sum(n):
            parts = np.split(total, _CHUNKS, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts]), pa.array([n[0]] * _CHUNKS), pa.array([n[1]] * _CHUNKS)],
                ["chunk", "counts", "n0", "n1"],
            )

    def add(key, given):
        total, n0, n1 = np.zeros((2 << BITS) // _CHUNKS, np.int64), 0, 0
        for c, a, b in zip(*(given.column(k).to_pylist() for k in ("counts", "n0", "n1")), strict=True):
            total, n0, n1 = total + np.frombuffer(c, np.int32), n0 + a, n1 + b
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": [total.astype(np.int32).tobytes()], "n0": [n0], "n1": [n1]})

    shape = "chunk int, counts binary, n0 long, n1 long"
    sums = rows.mapInArrow(count, shape).groupBy("chunk").applyInArrow(add, shape).collect()
    if not sums:
        return Model.constant(0.0)
    sums.sort(key=lambda r: r.chunk)
    df = np.concatenate([np.frombuffer(r.counts, np.int32).reshape(2, -1) for r in sums], axis=1).astype(float)
    n0, n1 = sums[0].n0, sums[0].n1
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return Model.constant(prior)
    ratio = np.log((df[1] + 1) / (n1 + 2)) - np.log((df[0] + 1) / (n0 + 2))
    z = np.abs(ratio) / np.sqrt(1 / (df[1] + 1) + 1 / (df[0] + 1))
    chosen = np.flatnonzero((z >= LEAST_Z) & (np.abs(ratio) >= LEAST_RATIO) & (df.sum(0) >= LEAST_DOCS))
    codes = np.full(1 << BITS, -1, np.int32)
    codes[chosen] = np.arange(len(chosen))
    if not len(chosen):
        return Model.constant(prior)
    scale = ratio[chosen]
    shared = spark.sparkContext.broadcast((codes, scale))

    def places(batches):
        for batch in few(batches, KEPT_BYTES):
            own, code = kept_hits(texts_of(batch, "text"), shared.value[0])
            order = np.lexsort((code, own))
            cut = np.searchsorted(own[order], np.arange(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array([p.tobytes() for p in np.split(code[order], cut)])], ["h", "y", "codes"])

    def regress(batches):
        got = [(h, y, np.frombuffer(p, np.int32)) for batch in batches for h, y, p in zip(*(batch.column(c).to_pylist() for c in ("h", "y", "codes")), strict=True)]
        if got:
            got.sort(key=lambda g: g[:2])
            y = np.array([g[1] for g in got]) > 0
            counts, held = np.array([len(g[2]) for g in got], np.int64), np.concatenate([g[2] for g in got])
            got.clear()
            w, bias = _regress(counts, held, shared.value[1], y.astype(float), prior)
            yield pa.RecordBatch.from_arrays([pa.array([(w * shared.value[1]).astype(np.float64).tobytes()]), pa.array([bias])], ["w", "bias"])

    fitted = rows.mapInArrow(places, "h long, y int, codes binary").repartition(1).mapInArrow(regress, "w binary, bias double").first()
    release(held)
    return Model(codes, np.frombuffer(fitted.w), fitted.bias)


def _blocks(counts: np.ndarray, held: np.ndarray) -> list[tuple]:
    """The entries in blocks of about ENTRIES, by row and by code: for both the entries and where each row or code begins."""
    ends, n, out = np.cumsum(counts), len(counts), []
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(ENTRIES, ends[-1], ENTRIES)), [n]])).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        code = held[ends[a] - counts[a] : ends[b - 1]]
        if not len(code):
            continue
        rows = np.arange(a, b)[counts[a:b] > 0]
        starts = (ends[rows] - counts[rows]) - (ends[a] - counts[a])
        order = np.argsort(code, kind="stable")
        by_code = np.repeat(rows, counts[rows])[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
        out.append((code, rows, starts, by_code, code[order][first], first))
    return out


def _regress(counts: np.ndarray, held: np.ndarray, scale: np.ndarray, y: np.ndarray, bias: float, l2: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression with both labels of equal weight, by gradient steps with a momentum and a step for each weight.

    Row i has the next counts[i] entries of held, codes of n-grams.
    """
    n, m = len(y), len(scale)
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * n
    blocks = _blocks(counts, held) if counts.sum() else []
    w, b = np.zeros(m), float(bias)
    g1, g2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        v, z, g = w * scale, np.full(n, b), np.zeros(m)
        for code, rows, starts, *_ in blocks:
            z[rows] += np.add.reduceat(v[code], starts)
        e = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        for *_, by_code, codes, first in blocks:
            g[codes] += np.add.reduceat(e[by_code], first)
        g = np.concatenate([g * scale + l2 * w, [e.sum()]]) / n
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        step = 0.05 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:m], b - step[m]
    return w, b


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, held_out, score, predicted) of whole texts, in one pass without a shuffle.

    Null or empty text: the score of a text without n-grams of note. Null ids and repeated rows: a row each. Empty
    table: no rows. Other columns of docs are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in few(batches, KEPT_BYTES):
            s = shared.value.scores(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s, pa.float64())], ["id", "held_out", "score"])

    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the model does not predict to be toxic.

    Null and empty texts get the score of a text without n-grams of note, and so stay unless most texts are toxic. Null
    ids and repeated rows: each row is judged by its text. Empty table: no rows. Columns of any name stay as they are.
    """
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches):
        for batch in few(batches, KEPT_BYTES, text_col):
            yield batch.filter(pa.array(shared.value.scores(texts_of(batch, text_col)) < threshold))

    return docs.mapInArrow(run, schema)
