"""Sending this package to the executors, for sessions whose workers were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of the package to the application once."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="lectern-")
    path = os.path.join(folder, "lectern_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((root / "lectern").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
