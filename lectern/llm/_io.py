"""Shared folders, written intermediate tables, and names that do not clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
#: The folder of a local session that names none; one for each process.
_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint folder of the context.

    A local session that has neither uses a temporary folder of its own; a cluster must name one that all machines see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="lectern-scratch-"))
        root = _own[0]
    return f"{root.rstrip('/')}/lectern-{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    release() removes a table that nothing reads any more; the others go with the application.
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if root not in _made:
        _made.add(root)
        system, folder = _folder(spark, root)
        system.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes written tables whose readers are all written themselves."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            system, folder = _folder(df.sparkSession, path)
            system.delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column, in one pass."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def shuffle_partitions(spark: SparkSession, n_bytes: int = 0, each: int = 8 << 20) -> int:
    """The session's number of shuffle partitions, or more, so that one holds about `each` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // each + 1)
