"""Sessions that name no folder for intermediate tables, tables that are gone when nothing needs them, clashing names."""

import os
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.llm import _io, _joins

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
known = entry.queries()
for name in sorted(n for n in known if n.startswith("op")) + ["pipeline"]:
    print(name, known[name](spark, sys.argv[1]).count())
"""


def test_all_queries_run_without_a_checkpoint_folder(tmp_path):
    text = "some words that stand in a row here and once again {} some words that stand in a row here and once again"
    docs = {"doc_id": range(30), "text": [None, ""] + [text.format(i % 9) for i in range(28)], "lang": ["en"] * 30, "source": ["a", "b", None] * 10, "n_chars": [1] * 30}
    tables = {
        "documents": docs, "labels": {"doc_id": range(30), "quality": [1] * 30, "toxic": [0, 1] * 15}, "benchmark": {"item_id": [1], "text": ["not in any of them at all, never ever"]},
        "pages": {"page_id": [1], "url": ["http://a.com/"], "html": [""]}, "embeddings": {"vec_id": range(6), "embedding": [[1.0, i / 9] for i in range(6)], "label": [0] * 6},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table({k: list(v) for k, v in columns.items()}), tmp_path / f"{name}.parquet")
    (tmp_path / "conf").mkdir()
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines())
    assert len(counts) == 11 and all(counts[n] == "30" for n in counts if n[:4] in ("op1_", "op3_", "op4_", "op5_", "op6_", "op8_", "op9_"))


def test_a_cluster_must_name_its_folder():
    class Context:
        master, applicationId = "spark://far:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        _io.scratch_root(Session())


def test_released_tables_are_gone(spark):
    one, two = _io.table(spark.range(3), "one"), _io.table(spark.range(4), "two")
    _io.release(one)
    assert two.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(one._scratch).count()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("tasks", [None, 7])
def test_salted_join_equals_a_join(spark, how, tasks):
    rows = spark.createDataFrame([(i % 5 if i % 3 else 1, i) for i in range(400)] + [(None, 1), (77, 2)], "k long, _salt long")
    other = spark.createDataFrame([(k, f"v{k}") for k in range(4)], "k long, v string")
    common = _joins.count_keys(rows, "k")
    assert 0 < common.count() <= 2 * 4
    want = sorted(map(str, rows.join(other, "k", how).select("k", "_salt", "v").collect()))
    got = _joins.salted_join(rows, other, "k", common, how, tasks)
    assert sorted(map(str, got.select("k", "_salt", "v").collect())) == want and set(got.columns) == {"k", "_salt", "v"}


def test_sieve_lets_all_wanted_rows_pass(spark):
    rows = spark.range(5000).selectExpr("if(id % 50 = 0, null, id) as id", "id as _word", "cast(id as string) as t")
    wanted = spark.createDataFrame([(i,) for i in range(0, 5000, 7)] + [(None,)], "k long")
    got = _joins.sieved(rows, _joins.F.col("id"), wanted, _joins.F.col("k"), 715)
    assert got.columns == rows.columns
    passed = {r._word for r in got.collect()}
    must = {i for i in range(5000) if i % 50 == 0 or i % 7 == 0}
    assert must <= passed and len(passed - must) < 1000
