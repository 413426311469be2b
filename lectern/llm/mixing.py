"""Mixing sources to target weights by hash thresholds, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import release, table

#: Places up to which each level of the histogram resolves the hash: 15 hexadecimal digits; rows that agree in all of
#: them are equal, and are told apart by their number in the written table, 16 digits more.
LEVELS, ROW_LEVELS = (3, 6, 9, 12, 15), (22, 27, 31)
DIGITS = LEVELS[-1]
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """For each (source, source_size) the target: the sum of all sizes shared by weight, at most `most` times the size.

    Weights repeat over the sources by code point, null last. What a full source can't take is shared by weight among
    the others until none is above. That is where a common level, times the weight, meets the caps: with sources in
    order of cap / weight, the first ones stop at their caps, and the level is what remains over the weights that remain.
    The table has one row for each source and is ordered in one task.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)
    target = F.least(F.col("cap").cast("double"), free["level"] * F.col("weight"))
    return ranked.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    most: int = 3,
    seed: str = "",
) -> DataFrame:
    """Rows (id, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A source is taken whole as often as its target holds its size. Of what then remains it gives the documents whose
    hash is under a threshold. The threshold is found without sorting: sizes are summed by source and leading hash
    digits, the bucket that the budget falls into is split by the next digits, and so on, only that one bucket. The
    last bucket, one document, is taken if that comes nearer to the budget. The hash is md5 of seed, id and the md5 of
    the text, so the order of rows, the partitioning and reruns change nothing, and a larger budget takes a superset.

    Null text: size 0. Null source: a source of its own, last. Null and repeated ids are rows like others. Of rows with
    equal source, id and text as many are taken as the budget holds; which of them makes no difference. A source of size
    0 has target 0 if all are empty. Empty table: no rows. Other columns of docs are left out.
    """
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.substring(key, 1, DIGITS).alias("key"))
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    want = targets(total, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    want = want.withColumn("whole", whole)
    # prefix: the digits of the boundary bucket so far. rest: the budget from that bucket on. last, n: its words and rows.
    edge = want.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit("").alias("prefix"))
    edge = table(edge.withColumn("last", F.col("source_size")).withColumn("n", F.lit(2).cast("long")), "mix-targets")
    full = F.concat("key", F.lpad(F.lower(F.hex("row")), 16, "0"))
    for places in LEVELS + ROW_LEVELS:
        if places > DIGITS and not edge.filter("n > 1").limit(1).count():
            break  # each boundary bucket is one document
        digits = F.substring(full if places > DIGITS else F.col("key"), 1, places)
        before, edge = edge, table(_narrowed(rows, edge, digits), f"mix-edge{places}")
        release(before)
    bound = edge.withColumn("take_last", F.coalesce(F.col("rest") * 2 > F.col("last"), F.lit(False))).withColumnRenamed("source", "at")
    bound = F.broadcast(bound.drop("n")) if _small(edge) else bound.drop("n")
    under = (full < F.col("prefix")) | (full.startswith(F.col("prefix")) & F.col("take_last") & (F.col("prefix") != ""))
    taken = (F.col("whole") + F.when(under & (F.col("whole") < most), 1).otherwise(0)) * F.col("size")
    return rows.join(bound, F.col("source").eqNullSafe(F.col("at"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def _narrowed(rows: DataFrame, edge: DataFrame, digits: Column) -> DataFrame:
    """edge with each source's boundary bucket split by more digits: the last one that begins within the budget."""
    bound = F.broadcast(edge) if _small(edge) else edge
    inside = rows.join(bound.select("source", "prefix", "rest"), rows["source"].eqNullSafe(bound["source"]) & F.col("key").startswith(F.substring("prefix", 1, DIGITS)))
    inside = inside.withColumn("bucket", digits).filter(F.col("bucket").startswith(F.col("prefix")))
    sums = inside.groupBy(rows["source"], "rest", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("left", F.col("rest") - F.coalesce(F.sum("size").over(by), F.lit(0)))
    # the first bucket always begins within the budget
    found = sums.filter(F.col("left") >= 0).groupBy("source").agg(F.max(F.struct("bucket", "left", "size", "n")).alias("m"))
    found = found.select(F.col("source").alias("at"), F.col("m.bucket").alias("prefix"), F.col("m.left").alias("rest"), F.col("m.size").alias("last"), F.col("m.n").alias("n"))
    out = edge.select("source", "source_size", "target", "whole").join(found, F.col("source").eqNullSafe(F.col("at")), "left").drop("at")
    return out.withColumn("rest", F.coalesce("rest", F.lit(0.0))).withColumn("prefix", F.coalesce("prefix", F.lit("")))


#: Sources whose thresholds are shipped to every executor; with more, the join shuffles.
SMALL_SOURCES = 20_000


def _small(edge: DataFrame) -> bool:
    return edge.limit(SMALL_SOURCES + 1).count() <= SMALL_SOURCES
