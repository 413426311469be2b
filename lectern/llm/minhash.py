"""Near-duplicate texts by b-bit MinHash, with links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import groups, pieces, texts_of
from ._components import components
from ._io import free_name, release, shuffle_partitions, table
from ._joins import common_keys, count_keys, salted_join, sieved
from ._unions import Forest
from ._words import mix, shingle_sets

#: 32 bands of 4 minima: a pair of similarity 0.75 shares no band with a chance of 5e-6. 4 low bits of each minimum stay,
#: packed in 64-bit words.
BANDS, DEPTH, BITS = 32, 4, 4
HASHES = BANDS * DEPTH
WORDS = HASHES * BITS // 64
#: Estimates this far under the similarity are still confirmed: 5 standard errors of 128 minima at 0.75.
MARGIN = 0.2
#: Shingles and members of a block of a bucket; larger buckets are compared block by block.
BLOCK_SHINGLES, BLOCK_MEMBERS = 400_000, 512

_rng = np.random.Generator(np.random.PCG64(20240602))
_A = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_BAND = _rng.integers(0, 2**64, BANDS, dtype=np.uint64)
_ROW = _rng.integers(0, 2**64, DEPTH, dtype=np.uint64) | np.uint64(1)


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (texts, WORDS) and band keys (texts, 32) of the sets h[at[i]:at[i+1]], none of them empty."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    low = np.empty((HASHES, len(at) - 1), np.uint32)
    for k in range(HASHES):
        low[k] = np.minimum.reduceat(x * _A[k] + _B[k], at[:-1])
    rows = low.astype(np.uint64).reshape(BANDS, DEPTH, -1)
    bands = mix((mix(rows + np.uint64(1)) * _ROW[None, :, None]).sum(axis=1, dtype=np.uint64) + _BAND[:, None])
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(WORDS, 64 // BITS, -1)
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    packed = np.bitwise_or.reduce(bits << shifts, axis=1)
    return packed.T.copy(), bands.T.astype(np.uint64).view(np.int64).copy()


#: The lowest bit of each entry.
_LOWEST = np.uint64(sum(1 << i for i in range(0, 64, BITS)))


def equal_entries(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 128 packed entries agree: those whose exclusive or has no bit set."""
    apart = x ^ y
    shift = BITS // 2
    while shift:
        apart = apart | (apart >> np.uint64(shift))
        shift //= 2
    return HASHES - np.bitwise_count(apart & _LOWEST).sum(axis=-1, dtype=np.int64)


def estimate(equal: np.ndarray) -> np.ndarray:
    """The similarity that so many equal entries of 128 stand for; chance agreement of low bits is taken off."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) for each row of docs.

    Texts with 100 * intersection >= percent * union of their sets of k-word shingles are linked. Equal sets are one
    class. First round: in each band bucket every class is paired with the class that shares most buckets; pairs whose
    estimate isn't far below the threshold are confirmed on full sets, and joined to components. Second round: in
    buckets that still hold several components, every pair across components is estimated, and confirmed if need be,
    inside tasks that hold a bounded block or two of the bucket. Tasks return spanning forests, so a group of n classes
    yields about n rows. No cap is set on buckets or partners.

    Null or empty texts, or white space alone: 0 shingles, linked with nothing. Null ids: a row each; component ids are
    the smallest ids that aren't null. Repeated rows are linked. Empty table: no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    # What a text is found by in the second pass, whatever its id: 96 bits, so that no two texts of a corpus share them.
    hashed = texts.withColumn("h", F.xxhash64("text")).withColumn("h2", F.hash("text"))

    def sign(batches):
        for batch in pieces(batches, "text"):
            h, at = shingle_sets(texts_of(batch, "text"), k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            digests, sigs, bands = ([None] * len(n) for _ in range(3))
            if len(full):
                low, keys = signatures(h, np.concatenate([at[full], [len(h)]]))
                for j, i in enumerate(full):
                    digests[i] = hashlib.blake2b(h[at[i] : at[i + 1]].tobytes(), digest_size=16).digest()
                    sigs[i], bands[i] = low[j].tobytes(), keys[j]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), batch.column("h2"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "h", "h2", "n", "digest", "sig", "bands"],
            )

    rows = table(hashed.mapInArrow(sign, f"id {kind}, h long, h2 int, n long, digest binary, sig binary, bands array<long>"), "signatures")
    classes = rows.filter("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least_id"), F.min(F.struct("h", "h2")).alias("found_by"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = table(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    every = classes.select("uid", F.explode("bands").alias("key"))
    shared = table(every.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared-bands")
    crowded = common_keys(shared, "key", "m", shared.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])  # bands of large groups, dealt over many tasks
    members = table(salted_join(every, shared, "key", crowded), "buckets")
    weight = members.groupBy("uid").agg(F.sum("m").alias("weight"))
    hubs = members.join(weight, "uid").groupBy("key").agg(F.max_by("uid", F.struct("weight", "uid")).alias("hub"))
    pairs = table(salted_join(members, hubs, "key", crowded).filter("uid <> hub").select("uid", "hub").distinct(), "hub-pairs")
    light = classes.select("uid", "n", "sig")
    busy = count_keys(pairs, "hub")  # hubs of large groups
    sides = salted_join(pairs.join(light.toDF("uid", "n1", "sig1"), "uid"), light.toDF("hub", "n2", "sig2"), "hub", busy)

    def likely(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WORDS) for c in ("sig1", "sig2"))
            n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
            good = (estimate(equal_entries(x, y)) >= percent / 100 - MARGIN) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            yield batch.select(["uid", "hub"]).filter(pa.array(good))

    hubbed = table(sides.select("uid", "hub", "n1", "n2", "sig1", "sig2").mapInArrow(likely, "uid long, hub long"), "pairs")
    release(pairs, shared)
    need = hubbed.select("uid").union(hubbed.select(F.col("hub").alias("uid"))).union(members.filter("m > 2").select("uid")).distinct()
    need = table(classes.join(need, "uid").select("uid", "found_by.h", "found_by.h2", "digest"), "needed")
    near = sieved(hashed, F.col("h"), need, F.col("h"), need.count())  # most texts stay where they are
    wanted = near.select("h", "h2", "text").dropDuplicates(["h", "h2"]).join(need, ["h", "h2"]).select("uid", "digest", "text")

    def take(batches):
        for batch in pieces(batches, "text"):
            h, at = shingle_sets(texts_of(batch, "text"), k)
            sets = [h[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)]
            right = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(sets, pa.binary())], ["uid", "shingles"])
            yield out.filter(pa.array(right))

    sets = table(wanted.mapInArrow(take, "uid long, shingles binary"), "shingle-sets")
    release(need)
    shuffle = shuffle_partitions(spark)
    # A hub's set is sent once to each task that has partners of it, and stands before theirs.
    busy = count_keys(hubbed, "hub")
    parts = F.lit(1)
    if busy is not None:
        hubbed_, parts = hubbed.join(F.broadcast(busy), "hub", "left"), F.coalesce("parts", F.lit(1))
    else:
        hubbed_ = hubbed
    dealt = hubbed_.select("uid", "hub", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"))
    heads = dealt.select(F.col("hub").alias("uid"), "hub", "part").distinct()
    held = dealt.join(sets, "uid").union(_of_hubs(heads, sets, busy)).select("hub", "part", "uid", "shingles", (F.col("uid") != F.col("hub")).alias("partner"))

    def confirm(batches):
        last, own = None, np.zeros(0, np.uint64)
        for batch in pieces(batches, "shingles"):
            a, b = [], []
            for hub, part, uid, raw, partner in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "uid", "shingles", "partner")), strict=True):
                one = np.frombuffer(raw, np.uint64)
                if not partner:
                    last, own = (hub, part), one
                    continue
                assert last == (hub, part)
                both = np.sort(np.concatenate([own, one]))
                inside = int((both[1:] == both[:-1]).sum())
                if 100 * inside >= percent * (len(both) - inside):
                    a.append(min(uid, hub))
                    b.append(max(uid, hub))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    first = held.repartition(shuffle, "hub", "part").sortWithinPartitions("hub", "part", "partner")
    first = table(first.mapInArrow(confirm, "a long, b long"), "links")
    labels = table(components(first), "labels")
    named = members.filter("m > 2").join(labels.withColumnRenamed("id", "uid"), "uid", "left").withColumn("label", F.coalesce("component", "uid"))
    named = table(named.join(classes.select("uid", "n"), "uid").select("key", "uid", "label", "n"), "labelled-buckets")
    split = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum("n").alias("total"), F.count("*").alias("m")).filter("x <> y")
    cut = F.floor(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("m") / BLOCK_MEMBERS)) + 1
    open_ = salted_join(named, split.select("key", cut.cast("int").alias("parts")), "key", count_keys(named, "key"))
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tiles = open_.select("key", "uid", "label", "part", other).select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "key", "uid", "label", "part", (F.col("part") == F.col("other")).alias("own")
    )
    tiles = table(tiles, "tiles")
    release(members, labels, named, hubbed)
    # Only classes with a likely partner across components need their sets.
    light = classes.select("uid", "n", "sig", "bands")
    work = tiles.join(_asked_for(light, tiles), "uid")

    def flag(batches):
        for t in groups(batches, "tile"):
            keep = _Tile(t, percent).likely()
            if keep.any():
                yield from t.select(["tile", "key", "uid", "label", "part", "own"]).filter(pa.array(keep)).to_batches()

    shape = "tile long, key long, uid long, label long, part int, own boolean"
    left = table(work.repartition(shuffle, "tile").sortWithinPartitions("tile").mapInArrow(flag, shape), "likely")
    release(tiles)
    work = left.join(_asked_for(light, left), "uid").join(_asked_for(sets, left), "uid")

    def check(batches):
        for t in groups(batches, "tile"):
            a, b = _Tile(t, percent).confirmed()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    second = table(work.repartition(shuffle, "tile").sortWithinPartitions("tile").mapInArrow(check, "a long, b long"), "more-links")
    release(left, sets)
    joined = components(first.union(second)).withColumnRenamed("id", "uid")
    joined = classes.select("uid", "digest", "copies", "least_id").join(joined, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    joined = table(joined, "class-components")
    release(first, second, classes)
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = salted_join(joined.select("digest", "component"), least, "component", count_keys(joined, "component")).select("digest", "component_id")
    copied = common_keys(joined, "digest", "copies", rows.count())
    linked = salted_join(rows.filter("digest is not null").select("id", "n", "digest"), named, "digest", copied).select("id", "n", "component_id")
    alone = rows.filter("digest is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _asked_for(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows whose uid is in a written table, and few others: signatures and sets that nothing asks for stay where they are."""
    return sieved(rows, F.col("uid"), by, F.col("uid"), by.count())


def _of_hubs(heads: DataFrame, sets: DataFrame, busy: DataFrame | None) -> DataFrame:
    """(uid, hub, part, shingles) of hubs; a hub with many parts is joined from several tasks."""
    return salted_join(heads, sets, "uid", None if busy is None else busy.withColumnRenamed("hub", "uid")).select("uid", "hub", "part", "shingles")


class _Tile:
    """Members of one or two blocks of a bucket."""

    def __init__(self, t: pa.Table, percent: int):
        self.t, self.percent = t, percent
        self.uid, self.key, self.part = (t.column(c).to_numpy() for c in ("uid", "key", "part"))
        self.n = t.column("n").to_numpy()
        self.label = np.unique(t.column("label").to_numpy(), return_inverse=True)[1]
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(-1, WORDS)
        self.bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each member the later ones that it may link with: likely, of another component, and not in an earlier band
        together, whose own bucket has them. In a tile of two blocks only pairs across the blocks count. One member's
        pairs are held at a time.
        """
        two = len(self.t) and not self.t.column("own")[0].as_py()
        least = self.percent / 100 - MARGIN
        for i in range(len(self.uid)):
            js = np.arange(i + 1, len(self.uid))
            js = js[self.label[js] != self.label[i]]
            if two:
                js = js[self.part[js] != self.part[i]]
            js = js[100 * np.minimum(self.n[js], self.n[i]) >= self.percent * np.maximum(self.n[js], self.n[i])]
            if not len(js):
                continue
            js = js[estimate(equal_entries(self.sig[js], self.sig[i])) >= least]
            if len(js):
                same = self.bands[js] == self.bands[i]
                js = js[self.bands[i][same.argmax(axis=1)] == self.key[i]]
            if len(js):
                yield i, js

    def likely(self) -> np.ndarray:
        """Which members have a candidate."""
        keep = np.zeros(len(self.uid), bool)
        for i, js in self.candidates():
            keep[i] = keep[js] = True
        return keep

    def confirmed(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the tile that join its components into trees."""
        sets = [np.frombuffer(s, np.uint64) for s in self.t.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        inside, forest = np.zeros(int(ids.max()) + 1, bool), Forest(int(self.label.max()) + 1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, js in self.candidates():
            tree = forest.label[self.label]
            js = js[tree[js] != tree[at]]
            if not len(js):
                continue
            own = ids[ends[at] - sizes[at] : ends[at]]
            inside[own] = True
            shared = np.array([int(inside[ids[ends[x] - sizes[x] : ends[x]]].sum()) for x in js])
            inside[own] = False
            js = js[100 * shared >= self.percent * (sizes[js] + sizes[at] - shared)]
            if len(js):
                js = js[np.unique(tree[js], return_index=True)[1]]
                forest.add(self.label[np.full(len(js), at)], self.label[js])
                a.append(np.full(len(js), at))
                b.append(js)
        return self.uid[np.concatenate(a)], self.uid[np.concatenate(b)]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5) -> DataFrame:
    """docs, all columns, with one row of each group of linked texts: the one of smallest id.

    Null, empty and blank texts have no shingles and stay, each row of them. Where ids repeat or several are null, rows
    are told apart by numbers in order of the ids, nulls last; of repeated rows one stays. Empty table: no rows. Columns
    of any name, their order and their values stay as they are.
    """
    if docs.select(id_col).count() != docs.select(id_col).distinct().count():
        row = free_name(docs, "row")
        numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        # near_texts numbers components by their smallest row; the row to keep is the one of smallest id among them.
        found = near_texts(numbered.select(row, text_col), row, text_col, percent, k).select(F.col(row).alias("at"), "component_id")
        ids = numbered.select(F.col(row).alias("at"), F.col(id_col).alias("id")).join(found, "at")
        least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "at")).alias("least"))
        kept = least.select(F.col("least.at").alias("at"))
        return numbered.join(kept, numbered[row] == kept["at"], "left_semi").select(*(f"`{c}`" for c in docs.columns))
    kept = near_texts(docs, id_col, text_col, percent, k).filter("kept").select(F.col(id_col).alias(free_name(docs, "kept")))
    return docs.join(kept, docs[id_col].eqNullSafe(kept[kept.columns[0]]), "left_semi")
