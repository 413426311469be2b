"""Joins whose common keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import free_name, shuffle_partitions

#: A key with more rows than this share of a task's even load is split; so at most SPLIT keys a task are.
SPLIT = 2


def common_keys(counts: DataFrame, key: str, n: str, total: int, tasks: int | None = None, least: float = 16.0) -> DataFrame | None:
    """(key, parts): the keys of counts (key, n) with more than 1 / (SPLIT * tasks) of total; None if there is none.

    n counts rows or bytes. At most SPLIT * tasks keys qualify, whatever the data, so they may be collected and broadcast.
    """
    spark = counts.sparkSession
    each = max(total / (SPLIT * (tasks or shuffle_partitions(spark))), least)
    found = counts.filter(F.col(n) > each).select(F.col(key), F.ceil(F.col(n) / F.lit(each)).cast("int").alias("parts"))
    rows = found.collect()
    if not rows:
        return None
    return spark.createDataFrame(rows, found.schema)


def count_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """common_keys of rows themselves, from partial counts."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return common_keys(counts, key, "_n", rows.count())


def heavy_keys(rows: DataFrame, key: str, text: str, n_bytes: int, tasks: int) -> DataFrame | None:
    """common_keys of rows by the bytes of a text column, where a key has several rows; a quarter as heavy ones count."""
    sums = rows.groupBy(key).agg(F.sum(F.octet_length(text).cast("long")).alias("_n"), F.count("*").alias("_rows"))
    return common_keys(sums.filter("_rows > 1"), key, "_n", n_bytes, 4 * tasks, 4096.0)


def salted_join(rows: DataFrame, other: DataFrame, key: str, common: DataFrame | None, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """rows joined with other on key. Rows of common keys are dealt over several tasks, to which other's rows of them are copied.

    other should hold one row, or few, of a key. tasks: number of partitions of both sides; by default the session's.
    """
    salt = []
    if common is not None:
        name = free_name(rows, free_name(other, "_salt"))
        parts = F.broadcast(common.withColumnRenamed("parts", name))
        dealt: Column = F.pmod(F.monotonically_increasing_id(), F.coalesce(name, F.lit(1))).cast("int")
        copied: Column = F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1))
        rows = rows.join(parts, key, "left").withColumn(name, dealt)
        other = other.join(parts, key, "left").withColumn(name, copied)
        salt = [name]
    if tasks:
        rows, other = rows.repartition(tasks, key, *salt), other.repartition(tasks, key, *salt)
    return rows.join(other, [key, *salt], how).drop(*salt)


def flagged(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, n: int, flag: str) -> DataFrame:
    """rows with a boolean column: whether their key may be one of wanted's n keys; true for all that are, and few others.

    No row is moved for that: a bitmap of hashes, eight bits for each wanted key, but 2**27 at most, is broadcast, 2**21
    words of it then. With more keys it flags more rows.
    """
    bits = min(max((8 * n).bit_length(), 16), 27)
    place = lambda k: F.xxhash64(k).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = free_name(rows, "_word"), free_name(rows, "_bits")
    at = wanted.select(place(wanted_key).alias("p")).select(F.shiftright("p", 6).alias(word), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    words = at.groupBy(word).agg(F.bit_or("b").alias(bit))
    held = rows.withColumn(word, F.shiftright(place(key), 6)).join(F.broadcast(words), word, "left")
    mask = F.call_function("shiftright", F.coalesce(bit, F.lit(0).cast("long")), place(key).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return held.withColumn(flag, mask == 1).select(*rows.columns, flag)


def sieved(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, n: int) -> DataFrame:
    """The rows whose key may be one of wanted's n keys (see flagged)."""
    flag = free_name(rows, "_may")
    return flagged(rows, key, wanted, wanted_key, n, flag).filter(F.col(flag)).drop(flag)
