"""Exact duplicates of texts by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import _folder, release, scratch_root, shuffle_partitions, table
from ._joins import common_keys, salted_join

#: Rows of a sender at most, as a power of two. A sender is a run of rows of one written partition.
SENDER_BITS = 16
#: Fingerprints that an owner decodes, on the mean: 8 bytes each, and about 40 with what tells equal ones.
OWNED = 4 << 20
#: Bits of a fingerprint beyond the logarithm of their number: one in 2**12 texts is a suspect by chance.
SPARE = 12
#: Buckets that Spark writes at most.
MOST_BUCKETS = 100_000
#: Characters that don't count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """Distinct sorted integers as Golomb-Rice code of their differences: (bits of a remainder, code).

    The code is the unary quotients, a one after as many zeros, and then the remainders. Its size is about
    log2(mean difference) + 1.8 bits a value.
    """
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    bits = max(0, int(np.log2(max(float(values[-1]) / len(values) * 0.69, 1.0))))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    remainders = (gaps[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
    return bits, np.packbits(unary).tobytes() + np.packbits(remainders).tobytes()


def decode(n: int, bits: int, code: bytes) -> np.ndarray:
    """The n integers of a code."""
    raw = np.frombuffer(code, np.uint8)
    tail = (n * bits + 7) // 8
    ones = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    quotients = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    remainders = np.zeros(n, np.uint64)
    if bits:
        low = np.unpackbits(raw[len(raw) - tail :], count=n * bits).reshape(n, bits)
        for k in range(bits):
            remainders |= low[:, k].astype(np.uint64) << np.uint64(k)
    return np.cumsum((quotients << np.uint64(bits)) + remainders, dtype=np.uint64)


def _messages(base: DataFrame, owners: int, width: int) -> DataFrame:
    """(owner, sender, n, bits, code, twice): each sender's distinct fingerprints for each owner, in order, and a bitmap of
    those that the sender itself holds more than once."""
    span = -(-(1 << width) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for sender, prints in zip(batch.column("sender").to_pylist(), batch.column("prints")):
                fp = np.sort(prints.values.to_numpy().view(np.uint64) >> np.uint64(64 - width))
                first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
                twice = np.diff(np.concatenate([first, [len(fp)]])) > 1
                fp = fp[first]
                owner = (fp // np.uint64(span)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(fp)]])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    bits, code = encode(fp[a:b] - np.uint64(int(owner[a]) * span))
                    for column, value in zip(out, (int(owner[a]), sender, int(b - a), bits, code, np.packbits(twice[a:b]).tobytes())):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["owner", "sender", "n", "bits", "code", "twice"])

    packed = base.groupBy("sender").agg(F.collect_list("print").alias("prints"))
    return packed.mapInArrow(send, "owner int, sender long, n int, bits int, code binary, twice binary")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sender, owner, bitmap): which of a sender's fingerprints are held by it twice or by another sender."""
    messages: dict[int, list[dict]] = {}
    for batch in batches:
        for m in batch.to_pylist():
            messages.setdefault(m["owner"], []).append(m)
    for owner in list(messages):
        held = messages.pop(owner)
        sizes = np.array([m["n"] for m in held])
        fp = np.concatenate([decode(m["n"], m["bits"], m["code"]) for m in held])
        order = np.argsort(fp, kind="stable")
        same = fp[order[1:]] == fp[order[:-1]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m["twice"], np.uint8), count=m["n"]) for m in held]).astype(bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        cuts = np.cumsum(sizes)
        parts = [many[a:b] for a, b in zip(cuts - sizes, cuts)]
        said = [(m["sender"], owner, np.packbits(p).tobytes()) for m, p in zip(held, parts) if p.any()]
        yield pa.RecordBatch.from_pylist([{"sender": s, "owner": o, "bitmap": b} for s, o, b in said], pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("bitmap", pa.binary())]))


def _suspects(base: DataFrame, replies: DataFrame, owners: int, width: int) -> DataFrame:
    """(sender, flags): a bit for each row of a sender, by its place; only senders that hold a suspect."""
    span = -(-(1 << width) // owners)

    def flag(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        fp = rows["print"].to_numpy().view(np.uint64) >> np.uint64(64 - width)
        place = rows["place"].to_numpy()
        distinct, at = np.unique(fp, return_inverse=True)
        owner = (distinct // np.uint64(span)).astype(np.int64)
        many = np.zeros(len(distinct), bool)
        for o, bitmap in zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist()):
            a, b = np.searchsorted(owner, [o, o + 1])
            many[a:b] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a)
        bits = np.zeros(int(place.max()) + 1 if len(place) else 0, bool)
        bits[place[many[at]]] = True
        n = int(bits.any())
        return pa.table({"sender": pa.array([key[0].as_py()] * n, pa.int64()), "flags": pa.array([np.packbits(bits).tobytes()] * n, pa.binary())})

    return base.select("sender", "place", "print").groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(flag, "sender long, flags binary")


def _bucketed(rows: DataFrame, n: int, key: str) -> tuple[DataFrame, str]:
    """rows written as a table in n buckets of key, in the shared folder, so that joins on key don't move them."""
    spark = rows.sparkSession
    name = f"exact_dedup_{uuid.uuid4().hex[:12]}"
    rows.write.bucketBy(n, key).option("path", f"{scratch_root(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name), name


def _dropped(spark, name: str) -> None:
    system, folder = _folder(spark, f"{scratch_root(spark)}/{name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    system.delete(folder, True)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one for each row of docs: its group of equal texts.

    Texts are equal if they are the same without the characters in IGNORED. Of a group the row with the most code points
    in its whole text stays, then the smallest id, ids that are null last; of rows that tie in both one stays. Each map
    task writes its normalised texts once, in buckets of senders, runs of up to 2**16 rows. Senders send their sorted
    fingerprints, Golomb-coded, to the owners of ranges of fingerprints; owners answer with bitmaps of those that are there
    twice; and only the texts of these suspects are moved, by their bytes. A text that is common costs a fingerprint for
    each sender and a copy for each task. Groups come back to rows by sha256, after the bytes have shown that it tells the
    suspects apart; otherwise the job fails.

    Null text: as empty. Empty texts, and those of ignored characters only, are one group. Null or repeated ids, repeated
    rows: a row each. Empty table: no rows. Other columns of docs, whatever their names, are left out.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", row)
    rows = rows.select("id", "row", normalised(F.col("text")).alias("text"), F.char_length(F.coalesce("text", F.lit(""))).alias("size"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("print", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long"))
    rows = rows.select(F.shiftright("row", SENDER_BITS).alias("sender"), F.col("row").bitwiseAND((1 << SENDER_BITS) - 1).cast("int").alias("place"), "id", "size", F.unhex("sha").alias("sha"), "print", "text")
    partitions = min(shuffle_partitions(spark), MOST_BUCKETS)
    base, name = _bucketed(rows, partitions, "sender")
    try:
        count = base.count()
        owners = int(max(partitions, -(-count // OWNED)))
        width = min(63, max(1, count).bit_length() + SPARE)
        replies = _messages(base, owners, width).repartition(owners, "owner").mapInArrow(_answers, "sender long, owner int, bitmap binary")
        flags = table(_suspects(base, replies, owners, width), "suspects")
        bit = F.conv(F.hex(F.substring("flags", F.expr("cast(place div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
        held = base.join(flags.hint("shuffle_hash"), "sender", "left")  # the texts are streamed, neither moved nor sorted
        suspect = F.coalesce(F.getbit(bit, (F.lit(7) - F.col("place") % 8).cast("int")) == 1, F.lit(False))
        held = held.withColumn("suspect", suspect)
        texts = held.filter("suspect").select("sha", "text").distinct().groupBy("sha").agg(F.count("*").alias("texts"))
        order = F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.struct("sender", "place").alias("row"))
        groups = held.filter("suspect").groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n"))
        told = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("different texts with one sha256")).cast("long"))
        groups = table(groups.join(texts, "sha").select("sha", "first", told.alias("n")), "groups")
        narrow = held.select("sender", "place", "id", "sha", "suspect")
        alone = narrow.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha")
        common = common_keys(groups.select("sha", "n"), "sha", "n", count)
        linked = salted_join(narrow.filter("suspect").drop("suspect"), groups, "sha", common)
        linked = linked.select("id", F.col("first.id").alias("keep_id"), "n", (F.struct("sender", "place") == F.col("first.row")).alias("kept"), "sha")
        found = table(alone.union(linked), "exact-groups")
        release(flags, groups)
    finally:
        _dropped(spark, name)
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
