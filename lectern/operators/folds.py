"""Folds over ordered rows that hold one state at a time, however long a group is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Groups whose results go out together.
OUT = 4096
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, whether it begins here, rows) for each run of equal keys in each batch; a run goes on in the next batch."""
    last: Any = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                yield keys[begin], keys[begin] != last, batch.slice(begin, i - begin)
                last, begin = keys[begin], i


def fold_groups(rows: DataFrame, by: list[str], order: list[str], start: Callable[[tuple], Any], step: Callable[[Any, pa.RecordBatch], Any], out: str, finish: Callable[[Any], tuple]) -> DataFrame:
    """(by, out): finish(state) for each group, whose rows went through step in order, some at a time.

    Rows are sorted inside partitions, which spills, and pass by in Arrow batches. A task holds one state and one batch, so
    a group of millions of rows needs the memory of a small one; it is one task's work, as its order asks.
    """
    shape = StructType([*(rows.schema[c] for c in by), *StructType.fromDDL(out).fields])

    def run(batches):
        done: list[tuple] = []
        key, state, batch = None, None, None
        for now, new, part in _runs(batches, by):
            batch = batch or _packer(shape, by, part)
            if new:
                if key is not None:
                    done.append((*key, *finish(state)))
                key, state = now, start(now)
                if len(done) >= OUT:
                    yield batch(done)
                    done = []
            state = step(state, part)
        if key is not None:
            done.append((*key, *finish(state)))
        if done:
            yield batch(done)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, shape)


def _packer(shape: StructType, by: list[str], rows: pa.RecordBatch) -> Callable[[list[tuple]], pa.RecordBatch]:
    """Rows of shape as a batch; keys are of the types that they came in."""
    kinds = [*(rows.schema.field(c).type for c in by), *(_KINDS[f.dataType.simpleString()] for f in shape.fields[len(by) :])]
    return lambda done: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], shape.names)


def affine_groups(rows: DataFrame, by: list[str], order: list[str], size: int, start: Callable[[tuple], np.ndarray | None], update: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, float, float, float]]]) -> DataFrame:
    """(by, theta): a vector for each group after its rows' updates in order, w -> keep * w + rate * (goal - w.x) * x.

    update gives (x, goal, keep, rate) for each row. Such a step is an affine map, and maps compose; so rows are dealt into
    ranges of key and order, and no group is one task's work: a group that begins inside a range is folded from its start
    vector, the group that a range begins with may have begun before and is folded to a map, size by size numbers and a
    vector, and the few parts of each group that spans ranges come together in their order. Groups without a start vector
    have a null theta.
    """
    shape = StructType([*(rows.schema[c] for c in by), *StructType.fromDDL("part int, mapped boolean, theta array<double>, map array<double>").fields])
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        part, done, key, state, batch = TaskContext.get().partitionId(), [], None, None, None
        first = True

        def closed():
            w, m = state
            return (*key, part, m is not None, None if w is None else w.tolist(), None if m is None else m.ravel().tolist())

        for now, new, piece in _runs(batches, by):
            batch = batch or _packer(shape, by, piece)
            if new:
                if key is not None:
                    done.append(closed())
                key = now
                state = (np.zeros(size), np.eye(size)) if first else (start(now), None)
                first = False
                if len(done) >= OUT:
                    yield batch(done)
                    done = []
            w, m = state
            if w is not None:
                for x, goal, keep, rate in update(piece):
                    if m is not None:
                        m = keep * m - rate * np.outer(x, x @ m)
                        w = keep * w - rate * (x @ w) * x + rate * goal * x
                    else:
                        w = keep * w + rate * (goal - x @ w) * x
                state = (w, m)
        if key is not None:
            done.append(closed())
        if done:
            yield batch(done)

    parts = rows.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order).mapInArrow(run, shape)

    def joined(state, piece):
        for mapped, w, m in zip(*(piece.column(c).to_pylist() for c in ("mapped", "theta", "map"))):
            if not mapped:
                state = None if w is None else np.array(w)
            elif state is not None:
                state = np.array(m).reshape(size, size) @ state + np.array(w)
        return state

    return fold_groups(parts, by, ["part"], start, joined, "theta array<double>", lambda w: (None if w is None else w.tolist(),))
