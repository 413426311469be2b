import random

import brute
import numpy as np
import pytest

from lectern.llm._components import components
from lectern.llm._unions import Forest


@pytest.mark.parametrize("n, links, one_task", [(60, 40, None), (200, 160, 0), (0, 0, 0), (200, 160, 90)])
def test_random_edges(spark, n, links, one_task):
    """In one task, in rounds over all tasks, and in rounds until few edges are left."""
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(links)] + [(5, 5)] * bool(n)
    want = brute.components(list(range(n)), edges)
    ids = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {i: want[i] for i in ids}


@pytest.mark.parametrize("one_task", [None, 0])
def test_chain_and_star(spark, one_task):
    edges = [(i, i + 1) for i in range(120)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 121 + 300


def test_forest_spans_what_the_links_span():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 80))))
        f = Forest(n)
        f.add(a, b)
        x, y = f.links()
        same = lambda p, q: brute.components(list(range(n)), list(zip(p.tolist(), q.tolist())))
        assert same(a, b) == same(x, y) and len(x) == n - len(set(same(a, b)))
