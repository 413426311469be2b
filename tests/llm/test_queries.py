import duckdb
import pytest

from lectern.llm.oracles import ORACLES
from lectern.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    norm = lambda rows, cols: sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in sorted(range(len(cols)), key=cols.__getitem__)]) for r in rows)
    assert norm(map(tuple, got.collect()), got.columns) == norm(want.fetchall(), columns)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
