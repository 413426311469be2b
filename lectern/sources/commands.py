"""A recogniser that is a program: page images go to its standard input, and its table of words comes back as lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Bytes of images and what is found in them that leave a worker at once; a larger one leaves it alone.
PIECE_BYTES = 1 << 20


def run_command(images: DataFrame, command: list[str], timeout: float = 180.0, tries: int = 2) -> DataFrame:
    """images (content) with output, what the program writes for each, and failure, why there is none.

    A process for each image, on the executors, without a shell. One that takes more than timeout seconds is killed, one
    that ends with an error is tried again, tries times in all; both cost their own image only. Null images are not sent. What is found leaves a worker in pieces of bounded bytes, whatever
    the batch holds.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    shape = StructType([*images.schema.fields, StructField("output", StringType()), StructField("failure", StringType())])

    def one(content: bytes) -> tuple[str | None, str | None]:
        why = None
        for _ in range(max(tries, 1)):
            try:
                done = subprocess.run(command, input=content, capture_output=True, timeout=timeout)
            except subprocess.TimeoutExpired:
                return None, f"took over {timeout:g} s"
            except OSError as e:
                return None, f"can't be started: {e.strerror}"
            if done.returncode == 0:
                return done.stdout.decode("utf-8", "ignore"), None
            why = f"ended with {done.returncode}"
        return None, why

    return images.mapInArrow(lambda batches: _in_pieces(batches, one), shape)


def _in_pieces(batches, one):
    """The batches with output and failure, what one(content) gives, as soon as PIECE_BYTES of them are there."""
    import pyarrow as pa

    def with_outputs(rows: pa.RecordBatch, found: list) -> pa.RecordBatch:
        columns = [pa.array(list(c), pa.string()) for c in zip(*found)]
        return pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, "output", "failure"])

    for batch in batches:
        contents = batch.column("content")
        begin, size, found = 0, 0, []
        for i in range(batch.num_rows):
            content = contents[i].as_py()
            found.append((None, None) if content is None else one(content))
            size += len(content or b"") + len(found[-1][0] or "")
            if size >= PIECE_BYTES:
                yield with_outputs(batch.slice(begin, i + 1 - begin), found)
                begin, size, found = i + 1, 0, []
        if found:
            yield with_outputs(batch.slice(begin), found)


def lines_of_words(read: DataFrame, by: list[str]) -> DataFrame:
    """(by, row, text, x0, y0, x1, y1, score): the lines of pages (by, width, height, output), top down.

    output is a table with a head and twelve columns parted by tabs: of each word its block, paragraph and line (3rd to
    5th), its place and size in pixels (7th to 10th), confidence (11th) and text (12th). Rows that are short, blank, or
    without a confidence of 0 or more are left out. Column expressions only.
    """
    rows = F.transform(F.slice(F.split("output", "\\r?\\n"), 2, 1 << 30), lambda x: F.split(x, "\\t"))
    words = read.select(*by, "width", "height", F.posexplode(rows).alias("n", "c")).filter((F.size("c") >= 12) & F.get("c", F.lit(11)).rlike(r"\S"))
    number = lambda i: F.get("c", F.lit(i)).try_cast("int")
    words = words.select(*by, "width", "height", "n", *(number(i).alias(c) for i, c in ((2, "block"), (3, "paragraph"), (4, "line"), (6, "x"), (7, "y"), (8, "w"), (9, "h"))), F.get("c", F.lit(10)).try_cast("double").alias("confidence"), F.get("c", F.lit(11)).alias("word"))
    words = words.filter((F.col("confidence") >= 0) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "n", "word"))), lambda s: s["word"]), " ")
    lines = words.groupBy(*by, "block", "paragraph", "line").agg(
        text.alias("text"), (F.min("x") / F.first("width")).alias("x0"), (F.min("y") / F.first("height")).alias("y0"), (F.max(F.col("x") + F.col("w")) / F.first("width")).alias("x1"),
        (F.max(F.col("y") + F.col("h")) / F.first("height")).alias("y1"), (F.avg("confidence") / 100).alias("score"), F.min("n").alias("n"),
    )
    order = Window.partitionBy(*by).orderBy(F.bround(F.col("y0") * 60), "x0", "n")
    return lines.select(*by, F.row_number().over(order).alias("row"), T.nfc("text").alias("text"), "x0", "y0", "x1", "y1", "score")
