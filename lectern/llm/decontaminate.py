"""Benchmark decontamination: n-gram seeds find candidates, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import PIECE_BYTES, pieces, texts_of
from ._io import release, table
from ._words import Words

#: Words of a seed, and scores of the alignment.
GRAM, MATCH, OTHER, GAP = 3, 2, -1, -1
#: Share of an item's own score from which a text counts as holding it; shorter items must be there as a whole.
LEAST, WHOLE_BELOW = 0.5, 8
#: Words of items that a task and the driver hold at once; more items are held block after block.
BLOCK_WORDS = 500_000
#: Bytes of text that meet a block before the next one is taken.
HELD_BYTES = 8 << 20
#: (place, item) pairs of seeds that are looked at together; a text with more is looked at alone.
PAIRS = 1 << 20


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, words of item, words of text) of the best local alignment, and where it ends in both."""
    steps = np.arange(len(text) + 1)
    row, best, at = np.zeros(len(text) + 1, np.int64), 0, (0, 0)
    for i, word in enumerate(item):
        new = np.maximum(0, row + GAP)
        np.maximum(new[1:], row[:-1] + np.where(text == word, MATCH, OTHER), out=new[1:])
        row = np.maximum.accumulate(new - steps * GAP) + steps * GAP
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i + 1, j)
    return best, at[0], at[1]


@dataclass
class Items:
    """Items of a block: ids, word hashes, and their seeds as sorted hashes with the item and place of each."""

    ids: list[int]
    words: list[np.ndarray]
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    sieve: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> "Items":
        w = Words([t for _, t in rows], lower=True)
        words = [w.hashes[a : a + n] for a, n in zip(w.first, w.counts)]
        hashes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        grams = {k: w.windows(k) for k in range(1, GRAM + 1)}
        for i, (a, n) in enumerate(zip(w.first, w.counts)):
            k = min(GRAM, n)
            if k:
                hashes.append(grams[k][a : a + n - k + 1] + np.uint64(k))
                owner.append(np.full(n - k + 1, i))
                place.append(np.arange(n - k + 1))
        h, owner, place = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(h, kind="stable")
        sieve = np.zeros(1 << 20, bool)
        sieve[(h >> np.uint64(44)).astype(np.int64)] = True
        return Items([i for i, _ in rows], words, h[order], owner[order], place[order], sieve)

    def seeds(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the batch, hash) of each place where a seed stands inside one text."""
        at, found = [], []
        owner = w.owners()
        for k, h in _grams(w).items():
            i = np.flatnonzero(self.sieve[(h >> np.uint64(44)).astype(np.int64)])
            i = i[owner[i] == owner[i + k - 1]]
            j = np.minimum(np.searchsorted(self.hashes, h[i]), max(len(self.hashes) - 1, 0))
            i = i[self.hashes[j] == h[i]] if len(self.hashes) else i[:0]
            at.append(i)
            found.append(h[i])
        return np.concatenate(at), np.concatenate(found)

    def hits(self, w: Words) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, word after the last) of the best alignment of each item that a text holds."""
        at, h = self.seeds(w)
        if not len(at):
            return []
        owner = w.owners()[at]
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, side="right")
        share = np.cumsum(np.bincount(owner, weights=high - low)).astype(np.int64)[owner] // PAIRS
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k in np.unique(share):
            of = share == k
            self._align(w, at[of], low[of], high[of] - low[of], best)
        return [(t, i, *v) for (t, i), v in sorted(best.items())]

    def _align(self, w: Words, at: np.ndarray, low: np.ndarray, n: np.ndarray, best: dict) -> None:
        """Puts the best alignment of each text and item into best; n seeds from low on stand at each place."""
        which = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        word = np.repeat(at, n)
        text = w.owners()[word]
        start = word - w.first[text] - self.place[which]
        item = self.owner[which]
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        sizes = np.array([len(x) for x in self.words])
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > sizes[item[1:]])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(text)]]) - 1
        for a, b in zip(first.tolist(), last.tolist()):
            t, i = int(text[a]), int(item[a])
            words, size = self.words[i], int(sizes[i])
            begin, end = max(0, int(start[a]) - size), min(int(w.counts[t]), int(start[b]) + 2 * size)
            part = w.hashes[w.first[t] + begin : w.first[t] + end]
            least = (1.0 if size < WHOLE_BELOW else LEAST) * MATCH * size
            if MATCH * int(np.isin(words, part).sum()) < least:
                continue  # no alignment can score more than its matches
            score, x, y = align(words, part)
            if score >= least and score / (MATCH * size) > best.get((t, i), (0.0, 0, 0))[0]:
                _, _, back = align(words[:x][::-1], part[:y][::-1])
                best[t, i] = (score / (MATCH * size), begin + y - back, begin + y)


def _grams(w: Words) -> dict[int, np.ndarray]:
    """Hashes of one to GRAM words from each word on, computed once for all blocks."""
    if not hasattr(w, "grams"):
        w.grams = {k: w.windows(k) + np.uint64(k) for k in range(1, GRAM + 1)}
    return w.grams


def _shipped(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """The items in blocks of about BLOCK_WORDS words, dealt by hash, each a broadcast; the driver holds one at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("t is not null").distinct()
    rows = table(rows.withColumn("words", F.size(F.split("t", r"\s+"))), "benchmark-items")
    n, out = (rows.agg(F.sum("words")).first()[0] or 0) // BLOCK_WORDS + 1, []
    for b in range(n):
        block = [(r.id, r.t) for r in rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == b).select("id", "t").collect()]
        if block:
            out.append(spark.sparkContext.broadcast(Items.of(sorted(block, key=lambda r: (r[0] is None, r[0] or 0, r[1])))))
    release(rows)
    return out


def _judged(batches, column: str, blocks: list) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int | None, float, int, int]]]]:
    """Pieces of the batches, each once, with (text, item id, score, first word, end word) over all blocks of items.

    A task holds one block and one piece at a time.
    """
    for batch in pieces(batches, column, PIECE_BYTES if len(blocks) == 1 else HELD_BYTES):
        w, found = Words(texts_of(batch, column), lower=True), []
        for shared in blocks:
            items = shared.value
            found += [(t, items.ids[i], *rest) for t, i, *rest in items.hits(w)]
            if len(blocks) > 1:
                del items
                shared.__dict__.pop("_value", None)  # the worker's copy; the executor keeps the block on its disk
        yield batch, found


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, item_id, score, first_word, end_word): the items that each row of docs holds, copied or edited.

    Words are compared in lower case. Seeds are all of an item's three-word runs, however many texts hold them; an
    edited copy without three words of the item in a row is not found. Where a seed stands in a text, the item is
    aligned with the words around by Smith-Waterman; the score is a share of the item's score with itself. From LEAST on
    the text holds the item; items under WHOLE_BELOW words must be there as a whole. Where they are in the text is given
    by words, the end exclusive.
    Texts are read once; the items are shipped in blocks of bounded size, and each piece of text meets them in turn. An
    item that fits several places of a text gives its best one, the first of equal ones; each item that a text holds is a
    row, also where items overlap or are equal.

    Null or empty texts and items: no row. Null ids stay null; repeated rows: rows each. Empty tables: no rows. Other
    columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, item_id long, score double, first_word long, end_word long"
    blocks = _shipped(benchmark, item_col, item_text)
    if not blocks:
        return docs.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)

    def run(batches):
        for batch, hits in _judged(batches, "text", blocks):
            own = pa.array([t for t, *_ in hits], pa.int64())
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            cols = [pa.array([h[k + 1] for h in hits], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), *cols], ["id", "item_id", "score", "first_word", "end_word"])

    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark, by the rules of benchmark_hits; one pass.

    Null and empty texts stay. Null ids and repeated rows: each row is judged by its text. Empty docs: no rows; an empty
    benchmark: all rows. Columns of any name stay as they are.
    """
    blocks, schema = _shipped(benchmark, item_col, item_text), docs.schema
    if not blocks:
        return docs

    def run(batches):
        for batch, hits in _judged(batches, text_col, blocks):
            keep = np.ones(batch.num_rows, bool)
            keep[[h[0] for h in hits]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
