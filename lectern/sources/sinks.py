"""Writers: extraction CSV, page text, traces and policies."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from .store import Snapshot, Store


def extraction_cells(fields: DataFrame) -> DataFrame:
    """The five columns of the export, guarded against formulas."""
    return fields.select(
        csv_cell("field").alias("field"), csv_cell("value").alias("value"), csv_cell("document").alias("document"),
        F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"), F.when(F.col("verified"), "true").otherwise("false").alias("verified"),
    )


def write_extraction(fields: DataFrame, path: str) -> None:
    """CSV with a header; each part begins with a byte order mark so that spreadsheets keep its script."""
    cells = extraction_cells(fields)
    cells.toDF(*(("﻿" if i == 0 else "") + c for i, c in enumerate(cells.columns))).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def page_export(name: Column, page: Column, pages: Column, source: Column, needs_ocr: Column, text: Column) -> Column:
    """A page's text under a short head."""
    note = (
        F.when(needs_ocr, "Partial cached text; this page still needs OCR.")
        .when(source == "ocr", "OCR text; check uncertain readings against the original file.")
        .otherwise("Extracted document text; original page formatting is not preserved.")
    )
    return F.concat(F.lit("Document: "), name, F.lit("\nPage: "), page.cast("string"), F.lit(" of "), pages.cast("string"), F.lit("\nSource: "), source, F.lit("\nNote: "), note, F.lit("\n\n"), text)


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def promote_policy(store: Store, policy: DataFrame) -> Snapshot:
    """Makes a policy, a table, the live one; the one before stays and can be put back. Readers see one or the other whole."""
    return store.publish(store.read(), {"policy": store.put(policy)})


def rollback_policy(store: Store) -> DataFrame | None:
    """Puts the policy before the live one back, and returns it; None, and nothing changes, if there is none before it."""
    made = store.rollback()
    return None if made is None else store.table("policy", made)


_LEFT: set[str] = set()


def _root(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors see; a local session without one uses a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/lectern-kept-{spark.sparkContext.applicationId}"


def _removed_at_end(spark: SparkSession, folder: str) -> str:
    if folder not in _LEFT:
        _LEFT.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(spark: SparkSession, source: str, name: str) -> str:
    """A folder for what is derived from a Parquet file or folder in its present state; it goes with the application.

    The state is the list of its files, their bytes, and when it was changed, as far as the store says so.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(spark.read.parquet(source).inputFiles())
    state = f"{source} {system.getFileStatus(path).getModificationTime()} {system.getContentSummary(path).getLength()} {files}"
    return _removed_at_end(spark, f"{_root(spark)}-{name}-{hashlib.sha1(state.encode()).hexdigest()[:12]}")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the application."""
    return _removed_at_end(spark, f"{_root(spark)}-{name}-{uuid.uuid4().hex[:12]}")


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """new_folder, for a with statement; what is read from it stays there for the application."""
    yield new_folder(spark, name)
