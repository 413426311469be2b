"""Streams of answer traces (extra: what is streamed here is only a log in the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, strategy string, tokens double, seconds double, verified boolean"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """New JSON lines of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).json(path)


def usage(traces: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Answers, tokens and verified share by strategy and window; rows later than `late` are left out."""
    grouped = traces.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "strategy")
    sums = grouped.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.avg(F.col("verified").cast("double")).alias("verified_share"))
    return sums.select(F.col("w.start").alias("start"), "strategy", "n", "tokens", "verified_share")


def write_usage(stream: DataFrame, path: str, checkpoint: str):
    """Runs over what there is and ends."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
