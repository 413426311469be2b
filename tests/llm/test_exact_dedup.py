import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import exact_dedup


@given(st.sets(st.integers(0, 2**63 - 1), min_size=1, max_size=300))
def test_code_round_trip(values):
    fp = np.array(sorted(values), np.uint64)
    bits, code = exact_dedup.encode(fp)
    assert (exact_dedup.decode(len(fp), bits, code) == fp).all()


def test_code_is_near_its_bound():
    fp = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    assert 8 * len(exact_dedup.encode(fp)[1]) / len(fp) < np.log2((1 << 40) / len(fp)) + 2


def brute(rows):
    groups = {}
    for place, (i, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, place))
    out = [None] * len(rows)
    for text, members in groups.items():
        keep = min(members)
        for m in members:
            out[m[3]] = (rows[m[3]][0], rows[keep[3]][0], len(members), m == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def run(df):
    return [tuple(r) for r in exact_dedup.exact_groups(df).collect()]


@pytest.mark.parametrize("parts", [1, 6])
def test_equals_brute_force(spark, parts):
    texts = ["a b", "ab", "a\tb ", "A b", None, "", " \n", "é\x0b", "é", "é", " ab", "x" * 3_000_000, "x" * 2_999_999 + " x", "ab\x00"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "copy " * 3) for i in range(200)] + [(300 + i, f"text {i // 2}") for i in range(60)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, sender long, sha string").repartition(parts)
    assert sorted(run(df)) == sorted(brute(rows))


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "a"), (1, "a "), (1, "a "), (2, None), (None, "")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert sum(r[3] for r in got) == 2
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []


def test_false_suspects_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPARE", -6)  # fingerprints of so few bits that different texts share them
    rows = [(i, f"text {i}") for i in range(300)] + [(1000, "text 7")]
    assert sorted(run(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows))
