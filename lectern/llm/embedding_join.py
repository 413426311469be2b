"""Near-duplicate vectors by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._batches import groups
from ._components import components
from ._io import release, shuffle_partitions, table
from ._joins import common_keys, count_keys, salted_join
from ._unions import Forest

#: Leading dimensions of the grid, and of the test before the exact cosine.
GRID, LEADING = 4, 24
#: Bytes of a block of the sequence, vectors of a leaf of the recursion, and groups that a node of the tree above holds.
BLOCK_BYTES, LEAF, FAN = 1 << 20, 1024, 8
#: Blocks of a group at most; a task holds two groups.
GROUP = 16
#: Groups of each side of a tile at most; the groups of the first side are held, those of the second pass by.
TILE = 4
#: Bytes of blocks that a task of the comparison reads on the mean; it holds one side of a tile at a time.
TASK_BYTES = 256 << 20
#: Room for rounding in tests that only exclude.
SLACK = 1e-4
#: Cosines of turned vectors that are as near to the threshold are decided by the vectors as they are.
TIE = 1e-9


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """Rows (id, n_links, component_id, kept) for each row of vectors; links are pairs with cosine >= least.

    Equal vectors are one class. Classes are rotated to principal dimensions, ordered by their grid cells of edge
    epsilon, and cut into blocks and groups of blocks. Pairs of intervals of that sequence are halved down to leaves,
    and left out as soon as their bounding boxes are further apart than epsilon: between groups by joins over a tree of
    boxes, inside a pair of groups by recursion. Pairs of groups are compared in tiles of up to TILE by TILE groups; a
    block is sent once for each tile. What remains is compared in double precision; cosines within 1e-9 of the threshold
    are taken from the vectors as given, dot / sqrt(square * square), so pairs that meet it exactly are links. A task
    returns counts and a spanning forest of its links, so a group of n vectors yields about n rows, not n**2. No pair is
    left out.

    Vectors that are null, empty, zero, or hold null, NaN or infinity link with nothing, nor do vectors of different
    lengths (lengths up to each power of two are joined in one go, padded with zeros). Null ids: the row counts as a
    vector, and component ids are the smallest ids that aren't null. Repeated rows link with each other. Empty table: no
    rows. Other columns of vectors are left out.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", _good(F.col("v"))).withColumn("h", F.xxhash64("v"))
    rows = table(rows, "vectors")
    classes = rows.filter("good").groupBy("h", "v").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))
    classes = table(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")
    level = F.ceil(F.log2(F.size("v"))).cast("int")
    levels = [tuple(r) for r in classes.groupBy(level.alias("k")).agg(F.max(F.size("v")), F.count("*")).collect()]
    if not levels:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found, used = None, []
    for k, size, count in levels:
        part, made = _links(classes.filter(level == k).select("uid", "v", "n"), size, count, least)
        used += made
        found = part if found is None else found.union(part)
    found = table(found, "vector-links")
    release(*used)
    counts = found.filter("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_others"))
    joined = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "uid")
    joined = classes.select("uid", "least_id").join(joined, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    joined = table(joined, "vector-components")
    least_ids = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = salted_join(joined.select("uid", "component"), least_ids, "component", count_keys(joined, "component"))
    by_class = classes.join(named.select("uid", "component_id"), "uid").join(counts, "uid", "left")
    by_class = by_class.select("h", F.col("v").alias("w"), (F.coalesce("n_others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    common = common_keys(classes.select("h", "n"), "h", "n", rows.count())
    linked = salted_join(rows.filter("good"), by_class, "h", common).filter("v = w").select("id", "n_links", "component_id")
    alone = rows.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _good(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _padded(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to d components, and their sizes."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(-1, d), sizes
    x = np.zeros((len(sizes), d))
    x[np.arange(d) < sizes[:, None]] = flat
    return x, sizes


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; powers of two that scale a row change nothing but keep squares from running over."""
    x, y = (v * np.exp2(-np.floor(np.log2(np.abs(v).max(axis=1, keepdims=True)))) for v in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def _axes(classes: DataFrame, d: int, count: int) -> np.ndarray:
    """The principal axes, the leading one first; the executors sum the products, the driver gets d * d numbers."""

    def products(batches):
        total = np.zeros((d + 1, d))
        for batch in batches:
            x = _unit(_padded(batch.column("v"), d)[0])
            total[:d] += x.T @ x
            total[d] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "row"])

    def add(key, given):
        total = np.stack(given.column("row").to_pylist()).sum(axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})

    shape = "k int, row array<double>"
    got = sorted(classes.select("v").mapInArrow(products, shape).groupBy("k").applyInArrow(add, shape).collect())
    m = np.array([r.row for r in got])
    return np.linalg.eigh(m[:d] / count - np.outer(m[d], m[d]) / count**2)[1][:, ::-1].copy()


def _links(classes: DataFrame, d: int, count: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, n): n links of a class to vectors of other classes where b is null, else a link of a spanning forest.

    Also the written tables that are of no use once those rows are written.
    """
    spark, lead = classes.sparkSession, min(d, LEADING)
    axes = spark.sparkContext.broadcast(_axes(classes, d, count))
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    grid, per_block = min(d, GRID), max(LEAF, BLOCK_BYTES // (8 * d))
    partitions = shuffle_partitions(spark)
    n_blocks = -(-count // per_block)
    # Groups are small enough for a task, and so many that their pairs keep all tasks busy.
    group = max(1, min(GROUP, n_blocks // int(np.ceil(np.sqrt(2 * partitions)))))

    def turned(batches):
        for batch in batches:
            given, sizes = _padded(batch.column("v"), d)
            r = _unit(given) @ axes.value[:, :grid]
            cells = np.floor(r / eps).astype(np.int32)
            columns = [pa.array(c) for c in cells.T]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("n"), pa.array(sizes, pa.int32()), pa.array([y.tobytes() for y in given]), *columns], ["uid", "n", "size", "v", *names]
            )

    def cut(batches):
        at, held = TaskContext.get().partitionId() << 32, []

        def block(rows):
            uid, n, size, v = zip(*rows, strict=True)
            given = b"".join(v)
            x = _unit(np.frombuffer(given).reshape(-1, d)) @ axes.value[:, :lead]
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([len(uid)], pa.int64()), *(pa.array([np.array(c, np.int64).tobytes()]) for c in (uid, n, size)), pa.array([given])]
                + [pa.array([list(f(x, axis=0))], pa.list_(pa.float64())) for f in (np.min, np.max)],
                ["at", "rows", "uids", "ns", "sizes", "vs", "lo", "hi"],
            )

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("uid", "n", "size", "v")), strict=True):
                held.append(row)
                if len(held) == per_block:
                    yield block(held)
                    held, at = [], at + 1
        if held:
            yield block(held)

    names = [f"c{i}" for i in range(grid)]
    shape = "uid long, n long, size int, v binary, " + ", ".join(f"{c} int" for c in names)
    ranges = max(1, -(-count // (per_block * group)))
    ordered = classes.mapInArrow(turned, shape).repartitionByRange(ranges, *names, "uid").sortWithinPartitions(*names, "uid")
    shape = "at long, rows long, uids binary, ns binary, sizes binary, vs binary, lo array<double>, hi array<double>"
    blocks = table(ordered.select("uid", "n", "size", "v").mapInArrow(cut, shape), "vector-blocks")
    boxes = table(_grouped(blocks.select("at", "rows", "lo", "hi"), per_block * group), "boxes")
    pairs, made = _box_pairs(boxes.groupBy("grp").agg(*_ends(lead)), eps)
    pairs = table(pairs, "group-pairs")
    # Tiles of pairs, so many that all tasks have some; a group's blocks go to a tile once for each side that it is on.
    n_groups = -(-n_blocks // group)
    width = max(1, min(TILE, n_groups // int(np.ceil(np.sqrt(4 * partitions)))))
    of = pairs.select("a", "b", F.floor(F.col("a") / width).alias("s"), F.floor(F.col("b") / width).alias("t")).withColumn("tile", F.xxhash64("s", "t"))
    second = of.groupBy("tile", "b").agg(F.collect_list("a").alias("others")).select("tile", F.lit(1).alias("side"), F.col("b").alias("grp"), "others")
    sides = of.select("tile", F.lit(0).alias("side"), F.col("a").alias("grp"), F.array().cast("array<long>").alias("others")).distinct().union(second)
    wanted = boxes.select("at", "grp").join(sides.groupBy("grp").agg(F.collect_list(F.struct("tile", "side", "others")).alias("tiles")), "grp")
    tiles = blocks.join(wanted, "at").select(F.explode("tiles").alias("e"), "grp", "at", "uids", "ns", "sizes", "vs").select("e.*", "grp", "at", "uids", "ns", "sizes", "vs")
    # A task holds one side of one tile, whatever its partition holds: its number follows the bytes, not the pairs.
    sent = of.select("tile").distinct().count() * 2 * width * group * BLOCK_BYTES
    tiles = tiles.repartition(max(partitions, min(of.count(), sent // TASK_BYTES)), "tile").sortWithinPartitions("tile", "side", "grp", "at")

    def compare(batches):
        tile, held = None, {}
        for t in groups(_numbered(batches), "run"):
            run = {c: t.column(c)[0].as_py() for c in ("tile", "side", "grp")}
            one = _side(t, d, axes.value)
            if run["tile"] != tile:
                tile, held = run["tile"], {}
            if run["side"] == 0:
                held[run["grp"]] = one
                continue
            for other in t.column("others")[0].as_py():
                same = other == run["grp"]
                yield _compare(one if same else held[other], one, same, d, least, eps)

    return tiles.mapInArrow(compare, "a long, b long, n long"), [blocks, boxes, pairs, *made]


def _numbered(batches):
    """Single rows with a number for each run of equal tile, side and group."""
    last, run = None, -1
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            now = tuple(row.column(c)[0].as_py() for c in ("tile", "side", "grp"))
            if now != last:
                last, run = now, run + 1
            yield row.append_column("run", pa.array([run], pa.int64()))


def _ends(size: int) -> list[Column]:
    """The box around boxes."""
    return [F.array(*(f(F.element_at(c, i + 1)) for i in range(size))).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]


def _grouped(blocks: DataFrame, rows: int) -> DataFrame:
    """blocks (at, rows) with grp: groups of consecutive blocks with about that many rows, however the sequence was cut.

    Running sums inside the ranges of the sequence, and over the ranges, of which there is one row each.
    """
    from pyspark.sql import Window

    def before(window):
        return F.coalesce(F.sum("rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    own = blocks.withColumn("part", F.shiftright("at", 32)).withColumn("own", before(Window.partitionBy("part").orderBy("at")))
    parts = own.groupBy("part").agg(F.sum("rows").alias("rows")).select("part", before(Window.orderBy("part")).alias("before"))
    return own.join(parts, "part").withColumn("grp", F.floor((F.col("before") + F.col("own")) / rows)).drop("part", "own", "before")


def _box_pairs(boxes: DataFrame, eps: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b), a <= b, of boxes (grp, lo, hi) within eps, found by descending a tree over the sequence; and the written tables."""
    levels = [table(boxes.withColumnRenamed("grp", "node"), "boxes")]
    n, size = levels[0].agg(F.max("node") + 1, F.max(F.size("lo"))).first()
    while n > FAN:
        n = -(-n // FAN)
        levels.append(table(levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*_ends(size)), "boxes"))
    gap = F.aggregate(F.zip_with(F.zip_with("lo1", "hi2", lambda p, q: p - q), F.zip_with("lo2", "hi1", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    made, pairs = list(levels), None
    for i, level in enumerate(levels[::-1]):
        left = level.select(F.col("node").alias("x"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
        right = level.select(F.col("node").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        if pairs is None:  # FAN nodes at most
            pairs = left.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("y"))
        else:
            kids = F.sequence(F.lit(0), F.lit(FAN - 1))
            pairs = pairs.select((F.col("x") * FAN).alias("x"), (F.col("y") * FAN).alias("y"), F.explode(kids).alias("i")).select((F.col("x") + F.col("i")).alias("x"), F.explode(F.transform(kids, lambda j: F.col("y") + j)).alias("y"))
        pairs = pairs.filter("x <= y").join(left, "x").join(right, "y").filter(gap <= eps * eps).select("x", "y")
        if i + 1 < len(levels):
            pairs = table(pairs, "box-pairs")
            made.append(pairs)
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), made


def _side(t: pa.Table, d: int, axes: np.ndarray) -> tuple:
    """The vectors of a group: ids, multiplicities, sizes, turned, their leading part, as given, and squares of lengths."""
    cols = {c: t.column(c).to_pylist() for c in ("uids", "ns", "sizes", "vs")}
    uid, n, size = (np.frombuffer(b"".join(cols[c]), np.int64) for c in ("uids", "ns", "sizes"))
    given = np.frombuffer(b"".join(cols["vs"])).reshape(-1, d)
    x = _unit(given) @ axes
    lead = min(d, LEADING)
    rest = np.sqrt(np.maximum(0, 1 - (x[:, :lead] ** 2).sum(axis=1)))
    return uid, n, size, x, np.concatenate([x[:, :lead], rest[:, None]], axis=1).astype(np.float32), given


def _compare(one: tuple, two: tuple, same: bool, d: int, least: float, eps: float) -> pa.RecordBatch:
    """Links between two sequences, or inside one."""
    (u1, n1, z1, x1, s1, v1), (u2, n2, z2, x2, s2, v2) = one, two
    mixed = z1.min() != z2.max() or z1.max() != z2.min()
    shift = 0 if same else len(u1)
    forest, counts = Forest(len(u1) + (0 if same else len(u2))), np.zeros(len(u1) + (0 if same else len(u2)), np.int64)

    def leaf(a0, a1, b0, b1):
        near = s1[a0:a1] @ s2[b0:b1].T >= least - SLACK
        i, j = np.divmod(np.flatnonzero(near), b1 - b0)
        if not len(i):
            return
        if len(i) > near.size // 16:
            cos = (x1[a0:a1] @ x2[b0:b1].T)[i, j]
        else:
            cos = np.concatenate([np.einsum("ij,ij->i", x1[a0 + i[k : k + 65536]], x2[b0 + j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        good = cos >= least
        tied = np.flatnonzero(np.abs(cos - least) <= TIE)
        for k in range(0, len(tied), 65536):
            at = tied[k : k + 65536]
            good[at] = _cosines(v1[a0 + i[at]], v2[b0 + j[at]]) >= least
        if mixed:
            good &= z1[a0 + i] == z2[b0 + j]
        i, j = a0 + i[good], b0 + j[good]
        if same:
            i, j = i[i < j], j[i < j]
        counts[:] += np.bincount(i, weights=n2[j], minlength=len(counts)).astype(np.int64)
        counts[:] += np.bincount(j + shift, weights=n1[i], minlength=len(counts)).astype(np.int64)
        forest.add(i, j + shift)

    lead = min(d, LEADING)

    def gap(a0, a1, b0, b1):
        p, q = x1[a0:a1, :lead], x2[b0:b1, :lead]
        g = np.maximum(0, np.maximum(q.min(axis=0) - p.max(axis=0), p.min(axis=0) - q.max(axis=0)))
        return (g * g).sum()

    todo = [(0, len(u1), 0, len(u2))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0 or gap(a0, a1, b0, b1) > eps * eps:
            continue
        if max(a1 - a0, b1 - b0) <= LEAF:
            leaf(a0, a1, b0, b1)
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        halves = [(p, q) for p in ((a0, am), (am, a1)) for q in ((b0, bm), (bm, b1))]
        todo += [(*p, *q) for p, q in halves if p[0] < p[1] and q[0] < q[1]]
    every = u1 if same else np.concatenate([u1, u2])
    a, b = forest.links()
    held = np.flatnonzero(counts)
    none = pa.nulls(len(held), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([every[held], every[a]]), pa.int64()),
            pa.concat_arrays([none, pa.array(every[b], pa.int64())]),
            pa.concat_arrays([pa.array(counts[held], pa.int64()), pa.nulls(len(a), pa.int64())]),
        ],
        ["a", "b", "n"],
    )
