"""Reading of pending pages in the background, in small batches into a versioned cache, each page once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.models import Reader, read_pages, stub_reader
from ..sources.store import Conflict, Store

KEYS = ["doc_id", "page"]
#: Batches that stay tables of their own before they become one.
MOST_BATCHES = 16


def readings(store: Store) -> DataFrame | None:
    """(doc_id, page, lines) of all pages that have been read; None if there are none."""
    now = store.read()
    out = None
    for name in sorted(n for n in now.tables if n.startswith("readings-")):
        out = store.table(name, now) if out is None else out.unionByName(store.table(name, now))
    return out


def _next(store: Store, pages: DataFrame, n: int) -> DataFrame:
    """The n most relevant pages that have no reading yet, ties in their order."""
    done = readings(store)
    left = pages if done is None else pages.join(done.select(*KEYS), KEYS, "left_anti")
    return left.orderBy(F.desc("relevance"), *KEYS).limit(n)


def read_pending(store: Store, pages: DataFrame, most: int, batch: int = 16, reader: Reader = stub_reader, language: str = "") -> int:
    """Reads up to `most` of the pages (doc_id string, page int, content, relevance) that have no reading, best first; how many.

    Each batch is published whole, with an empty reading for pages on which nothing is found, so a run that is stopped
    loses the batch it was at, and one that starts again, or runs beside it, reads only what is left. Of two that read
    the same pages the second finds a conflict and takes others.
    """
    done = 0
    while done < most:
        base = store.read()
        chosen = store.put(_next(store, pages, min(batch, most - done)))
        todo = store.spark.read.parquet(f"{store.folder}/{chosen['path']}")
        n = todo.count()
        if not n:
            return done
        boxes = read_pages(todo, reader, language)
        lines = boxes.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda b: b["text"]).alias("lines"))
        found = todo.select(*KEYS).join(lines, KEYS, "left").select(*KEYS, F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
        held = [t for t in base.tables if t.startswith("readings-")]
        tables: dict = {f"readings-{base.version + 1:09d}": store.put(found)}
        if len(held) >= MOST_BATCHES:
            tables = {**dict.fromkeys(held), f"readings-{base.version + 1:09d}": store.put(readings(store).unionByName(found))}
        try:
            store.publish(base, tables)
        except Conflict:
            continue
        done += n
    return done
