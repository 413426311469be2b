import random

import brute
import numpy as np
import pytest

from lectern.llm import cover_dedup, suffix_dedup
from lectern.llm.run_index import RunIndex


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            at, a = rng.randint(0, len(body)), rng.randint(0, 30)
            body[at:at] = passage[a : a + rng.randint(5, 70)]
        rows.append(rng.choice([" ", "\n"]).join(body))
    rows += [None, "", " ", "ab " * 3000, "ab " * 3000, "z" * 5000, "q" * 199, "q" * 200, rows[3], rows[3], " ".join(passage), " ".join(passage * 2)]
    rows += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rng.shuffle(rows)
    return rows


def test_windows_equal_brute_force(spark, texts):
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    got = sorted(tuple(r)[:4] for r in cover_dedup.drop_repeated_windows(df).collect())
    assert got == sorted(brute.repeated_windows(rows))


def test_windows_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(20)))
    rows = [(None, text), (None, text), (7, text), (7, text), (7, text + " x"), (9, "a " + text), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in cover_dedup.drop_repeated_windows(df).collect()), key=str)
    assert got == sorted(brute.repeated_windows(rows), key=str)
    assert cover_dedup.drop_repeated_windows(df.limit(0)).collect() == []


@pytest.mark.parametrize("hot, index_bytes", [(suffix_dedup.HOT, suffix_dedup.INDEX_BYTES), (2, 1000)])
def test_bytes_equal_brute_force(spark, monkeypatch, texts, hot, index_bytes):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", index_bytes)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    assert sorted(map(tuple, suffix_dedup.drop_repeated_bytes(df).collect())) == sorted(brute.repeated_bytes(rows))


def test_bytes_null_ids_and_empty(spark):
    rows = [(None, "x" * 150 + "y" * 150), (None, None), (2, "a" + "x" * 150 + "y" * 150), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.drop_repeated_bytes(df).collect()), key=str)
    assert got == sorted(brute.repeated_bytes(rows), key=str)
    assert suffix_dedup.drop_repeated_bytes(df.limit(0)).collect() == []


def test_run_index_statistics_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(25):
        parts = [rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        parts += parts[:1]
        data, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]
        own = [(p, i) for p in range(len(parts)) for i in range(len(parts[p]))]
        tails = [parts[p][i:].tobytes() for p, i in own]

        def common(a, b):
            return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

        want = [max((common(tails[i], tails[j]) for j in range(len(tails)) if j != i), default=0) for i in range(len(tails))]
        index = RunIndex(data, starts)
        assert index.statistics().tolist() == want
        assert int(index.run_lengths.sum()) == len(data)
