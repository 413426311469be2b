"""Connected components of an edge table by min-label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import release, table
from ._joins import count_keys, salted_join

#: Edges that one task joins in its memory (16 bytes each); more are contracted in rounds over all tasks.
ONE_TASK = 1 << 20


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that links reach.

    Rounds of two steps, after Kiveris and others: each id's larger neighbours are hung on its smallest one, then the
    edges are turned towards the smaller end and each id's smaller neighbours are hung on the smallest. A round at
    least halves the height of long chains; the number of edges does not grow. Each step is an aggregate with partial
    sums and a join on the id that deals a common id over several tasks, so a star is never gathered in one task. As soon as at most one_task
    (ONE_TASK by default) edges are there, a single task of that bounded size joins the rest.
    """
    bound = ONE_TASK if one_task is None else one_task
    now = table(_turned(edges.select("a", "b").filter("a <> b")).distinct(), "edges")
    state = _state(now)
    while state[0] > bound:
        large = _hang(now.select(F.col("a").alias("x"), F.col("b").alias("y")).union(now.select(F.col("b").alias("x"), F.col("a").alias("y"))), True)
        small = _hang(_turned(large).select(F.col("b").alias("x"), F.col("a").alias("y")), False)
        after = table(_turned(small).distinct(), "edges")
        release(now)
        now, before, state = after, state, _state(after)
        if state == before:
            return _named(now)
    return table(now.coalesce(1).mapInArrow(_joined, "id long, component long"), "components") if state[0] else _named(now)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        stars.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )


def _joined(batches):
    """The components of all edges of one task."""
    import numpy as np
    import pyarrow as pa

    from ._unions import Forest

    sides = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for side, name in zip(sides, "ab"):
            side.append(batch.column(name).to_numpy())
    a, b = (np.concatenate(s) for s in sides)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(ids))
    forest.add(at[: len(a)], at[len(a) :])
    for k in range(0, len(ids), 1 << 16):
        part = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[forest.label[part]])], ["id", "component"])


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _hang(sides: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b) from each x's neighbours y, the larger ones or all smaller ones, to the least of x and its neighbours."""
    common = count_keys(sides, "x")
    least = sides.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    joined = salted_join(sides, least, "x", common)
    out = joined.filter("y > x" if larger else "y <> m").select(F.col("m").alias("a"), F.col("y").alias("b"))
    return out if larger else out.union(least.filter("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")))
