import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.oracles import ORACLES
from lectern.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, list | tuple) else v

    return sorted((repr([value(r[i]) for i in order]) for r in rows))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(rows, got.columns) == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_imports_without_llm(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run(["cp", "-r", f"{root}/lectern", f"{root}/__spark_entry__.py", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/lectern/llm"], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
