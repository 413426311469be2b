"""Merkle manifests of tables: a hash tree for each source, a tree over the sources, and a proof for each row."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._io import free_name, release, shuffle_partitions, table

#: Children of a node, and levels that a task collapses at once: a bucket holds FANOUT**LEVELS nodes at most.
FANOUT, LEVELS = 3, 6
PROOF = ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())]))


def leaf_hash(*values: Column) -> Column:
    """The hash of a row's values: '-' for null, else the number of UTF-8 bytes, a colon, and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_hash(proof: Column) -> Column:
    """The hash of a proof's siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _climb(nodes: list[str], steps: int) -> list[list[str]]:
    """The levels above nodes, nodes first, for so many steps."""
    levels = [nodes]
    for _ in range(steps):
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(last), FANOUT)])
    return levels


def _steps(n: int, levels: int) -> int:
    """Levels to collapse in a tree whose level has n nodes: levels, or fewer if one node remains before."""
    steps = 0
    while n > 1 and steps < levels:
        n, steps = -(-n // FANOUT), steps + 1
    return steps


def _collapsed(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, i, n, digest) of the nodes so many levels above those of nodes (tree, i, n, digest), or of the root.

    n is the number of nodes of the tree's level, i the place in it; a bucket of FANOUT**levels places becomes one row.
    """
    span = FANOUT**levels

    def collapse(rows):
        import pandas as pd

        rows = rows.sort_values("i")
        n = int(rows["n"].iloc[0])
        root = _climb(rows["digest"].map(bytes.hex).tolist(), _steps(n, levels))[-1][0]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "i": [int(rows["i"].iloc[0]) // span], "n": [-(-n // span)], "digest": [bytes.fromhex(root)]})

    keyed = nodes.select("tree", "i", "n", "digest", F.expr(f"i div {span}").alias("bucket"))
    return keyed.groupBy("tree", "bucket").applyInPandas(collapse, "tree long, i long, n long, digest binary")


def _proved(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """nodes with their proofs: those inside their bucket, and then upper's (tree, bucket, upper)."""
    names = nodes.columns
    shape = StructType([*nodes.schema.fields, StructField("proof", PROOF)])

    def prove(key, rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        m, n = rows.num_rows, int(rows["n"][0].as_py())
        steps = _steps(n, levels)
        nodes_of = _climb([d.hex() for d in rows["digest"].to_pylist()], steps)
        before, after, base = [], [], np.zeros((m, steps), np.int64)
        for k, level in enumerate(nodes_of[:-1]):
            base[:, k] = len(before) + np.arange(m) // FANOUT**k
            for i in range(len(level)):
                start = i - i % FANOUT
                before.append("".join(level[start:i]))
                after.append("".join(level[i + 1 : start + FANOUT]))
        rest = above["upper"][0].as_py() or []
        base = np.hstack([base, np.broadcast_to(len(before) + np.arange(len(rest)), (m, len(rest)))]).ravel()
        before, after = before + [s["before"] for s in rest], after + [s["after"] for s in rest]
        step = pa.StructArray.from_arrays([pa.array(x, pa.string()).take(pa.array(base)) for x in (before, after)], ["before", "after"])
        offsets = pa.array(np.arange(m + 1) * (steps + len(rest)), pa.int32())
        return rows.select(names).append_column("proof", pa.ListArray.from_arrays(offsets, step))

    keyed = nodes.withColumn("bucket", F.expr(f"i div {FANOUT**levels}"))
    return keyed.groupBy("tree", "bucket").cogroup(upper.groupBy("tree", "bucket")).applyInArrow(prove, shape)


class _Trees:
    """Every so many levels of many trees, each collapsed from the last; nodes: (tree, i, n, digest, ...)."""

    def __init__(self, nodes: DataFrame, step: int):
        self.levels, self.step = [nodes], step
        below = nodes
        while not below.isEmpty() or below is nodes:
            self.levels.append(table(_collapsed(below, self.step), "tree-level"))
            below = self.levels[-1].filter("n > 1")

    def roots(self) -> DataFrame:
        """(tree, digest) of all trees. A level holds the roots of those whose level below was one bucket, and of them only."""
        found = [level.filter("n = 1").select("tree", "digest") for level in self.levels[1:]]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """The first level's nodes with their proofs, which end with those of above (tree, upper) for the trees' roots."""
        upper = None
        for k in range(len(self.levels) - 2, -1, -1):
            roots = self.levels[k + 1].filter("n = 1").select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("bucket"), "upper")
            nodes = self.levels[k]
            if k:
                nodes = nodes.filter("n > 1")
            proved = _proved(nodes, roots if upper is None else roots.union(upper), self.step)
            if k:
                upper = proved.select("tree", F.col("i").alias("bucket"), F.col("proof").alias("upper"))
        return proved


def _placed(rows: DataFrame, order: Sequence[str], tie: str) -> DataFrame:
    """rows as a written table, sorted by order over its partitions, with columns part and place; place counts in part."""
    n = shuffle_partitions(rows.sparkSession)
    sorted_rows = rows.repartitionByRange(n, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    at = F.monotonically_increasing_id()
    return sorted_rows.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1))


def _running(parts: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """parts with the sum of n over the earlier parts of the same keys: as many rows for a key as there are partitions."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(n).over(before), F.lit(0)))


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof), and carry's columns, one for each row of docs.

    A leaf is the hash of the row's columns (leaf_hash). Leaves of a source ascend by id; every FANOUT consecutive nodes
    become one, until one is left, the source's subroot; subroots, ordered by source, become the root likewise. proof has a
    step for each level from the leaf to the root: the digests before and after the node in its run, joined; fold() and
    proof_hash() read it, and fold(leaf, proof) is the root.

    Rows are numbered by a range shuffle on (source, id, leaf) and running counts, not by source, so a large source is
    spread like any other. Superblock reduction: places are dealt in buckets of FANOUT**levels, applyInPandas collapses
    so many levels of each, and the buckets' roots are the next, 729 times smaller, level; proofs inside buckets are joined
    to those of the buckets' roots from the top down. Nothing but digests and carried columns is moved.

    Null columns hash as '-'. Null ids come first in their source, the null source first of all; repeated ids are ordered
    by their leaves, and equal rows are leaves each. Empty table: no rows. Other columns of docs are left out.
    """
    spark = docs.sparkSession
    carry = carry or {}
    kept = {f"_carried{k}": c for k, c in enumerate(carry.values())}
    leaf = F.unhex(leaf_hash(*(F.col(c) for c in columns)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf.alias("digest"), F.monotonically_increasing_id().alias("tie"), *(c.alias(k) for k, c in kept.items()))
    hashed = table(rows, "leaf-hashes")  # the texts are read once; finding ranges and sorting read their hashes
    rows = table(_placed(hashed, ["source", "id", "digest"], "tie"), "leaves")
    release(hashed)
    parts = table(rows.groupBy("part", "source").agg(F.min("place").alias("first"), F.count("*").alias("rows")), "leaf-parts")
    sources = parts.groupBy("source").agg(F.sum("rows").alias("n"))
    sources = table(_placed(sources.withColumn("tie", F.lit(0)), ["source"], "tie"), "sources")
    counted = _running(sources.groupBy("part").agg(F.count("*").alias("rows")).withColumn("all", F.lit(0)), ["all"], "rows", "before")
    sources = table(sources.join(counted.select("part", "before"), "part").select(F.col("source").alias("name"), "n", (F.col("before") + F.col("place")).alias("tree")), "source-trees")
    parts = _running(parts, ["source"], "rows", "before")
    parts = table(parts.join(sources, F.col("source").eqNullSafe(F.col("name"))).select("part", F.col("source").alias("name"), "first", "before", "tree", "n"), "leaf-places")
    # Spark broadcasts these if their size allows it; otherwise a (part, source) has no more rows than a partition.
    nodes = rows.withColumnRenamed("part", "p").join(parts, (F.col("p") == F.col("part")) & F.col("source").eqNullSafe(F.col("name")))
    nodes = table(nodes.select("tree", (F.col("place") - F.col("first") + F.col("before")).alias("i"), "n", "digest", "id", *kept), "leaf-nodes")
    trees = _Trees(nodes, levels)
    subroots = table(trees.roots(), "subroots")
    n_trees = subroots.count()
    top = _Trees(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(n_trees).cast("long").alias("n"), "digest"), levels)
    root = top.roots().select(F.lower(F.hex("digest")).alias("root")).first()
    if root is None:
        proofs = subroots.select("tree", F.lit(None).cast(PROOF).alias("upper"))
    else:
        none = spark.createDataFrame([(0, [])], StructType([StructField("tree", LongType()), StructField("upper", PROOF)]))
        proofs = top.proofs(none).select(F.col("i").alias("tree"), F.col("proof").alias("upper"))
    proofs = table(proofs, "source-proofs")
    proved = trees.proofs(proofs)
    hexed = lambda c: F.lower(F.hex(c))
    out = proved.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    release(rows)
    return out.select(F.col("id").alias(id_col), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(root and root["root"]).cast("string").alias("root"), "proof", *(F.col(k).alias(name) for k, name in zip(kept, carry)))


def verified(docs: DataFrame, changed: Column, id_col: str = "doc_id", source_col: str = "source", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """manifest() of docs, and whether each row's text, replaced by changed, still folds to the root with the row's proof.

    Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified). changed may be null: as a null text.
    """
    values = [changed if c == text_col else F.col(c) for c in columns]
    name = free_name(docs, "_leaf")
    found = manifest(docs, columns, id_col, source_col, {name: F.unhex(leaf_hash(*values))}, levels)
    folded = fold(F.lower(F.hex(name)), F.col("proof"))
    found = found.select(id_col, "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
