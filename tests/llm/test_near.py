import random

import brute
import numpy as np
import pytest

from lectern.llm import _joins, embedding_join, minhash


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefghij") * 3 if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(4)]
    rows = [edited(rng, base[i % 4], rng.choice([0, 0.01, 0.03, 0.05, 0.08])) for i in range(90)]
    rows += [" ".join(f"u{rng.randrange(9999)}" for _ in range(40)) for _ in range(30)]
    odd = [None, "", " \n\t", "one two", "One TWO", "a b c d e", "a b c d e f", "x " * 4000, "x " * 4000, rows[0], rows[0], "é É", "é é"]
    rows += odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, split", [(minhash.BLOCK_SHINGLES, 2), (1500, 1000)])
def test_texts_equal_brute_force(spark, monkeypatch, texts, block, split):
    """Also with small blocks, and with many keys taken for common ones."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(_joins, "SPLIT", split)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    assert sorted(map(tuple, minhash.near_texts(df).collect())) == sorted(brute.near_texts(rows))


def test_texts_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (9, "other words stand here now"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_texts(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (None, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 1, 9, True), (2, 0, 2, True)], key=str)
    assert minhash.near_texts(df.limit(0)).collect() == []
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in minhash.keep_one(df).collect())
    assert kept == [(False, 2, ""), (False, 4, "a b c d e f"), (False, 9, "other words stand here now"), (True, 0, "")]


def test_keep_one_leaves_columns_of_any_name(spark):
    text = "a b c d e f"
    rows = [(4, text, 1, 2, 3), (4, text, 1, 2, 3), (None, text, 5, 6, 7), (9, "other words stand here now", 8, 9, 10), (9, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, row int, `a.b` int")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
    one = spark.createDataFrame([(1, text, 5, 6), (2, text, 5, 6)], "doc_id long, text string, _kept int, kept int")
    assert [tuple(r) for r in minhash.keep_one(one).collect()] == [(1, text, 5, 6)]
    assert minhash.keep_one(df.limit(0)).collect() == []


def test_packed_entries_are_counted_by_bits():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 2**64, (2, 50, minhash.WORDS), dtype=np.uint64)
    y[:25] = np.where(rng.random((25, minhash.WORDS)) < 0.5, x[:25], y[:25])
    entries = lambda a: [[(int(w) >> s) & ((1 << minhash.BITS) - 1) for w in row for s in range(0, 64, minhash.BITS)] for row in a]
    assert minhash.equal_entries(x, y).tolist() == [sum(p == q for p, q in zip(a, b)) for a, b in zip(entries(x), entries(y))]
    h = np.sort(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    both = np.concatenate([h[:2000], h[500:2500]])
    sig, _ = minhash.signatures(both, np.array([0, 2000, 4000]))
    assert abs(float(minhash.estimate(minhash.equal_entries(sig[0], sig[1]))) - 1500 / 2500) < 0.2


def test_keep_one_of_each_group(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in brute.near_texts(rows) if r[3]]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(6):
        base = rng.normal(size=16)
        rows += [list(map(float, base + rng.normal(size=16) * s)) for s in (0, 0, 0.1, 0.2, 0.3, 0.35, 0.4)]
    rows += [list(map(float, rng.normal(size=16))) for _ in range(60)]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 0.0], [2.0, 0.0], [1.0], [-1.0], [0.0, 1.0]]
    rows += [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 0.0], [0.5, 1.0, 1.5], [0.0, -0.0, 1.0], [0.0, 0.0, 2.0]]
    rows += [rows[0], [x * 7 for x in rows[0]]]
    return [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("leaf, block, fan, group", [(embedding_join.LEAF, embedding_join.BLOCK_BYTES, embedding_join.FAN, 16), (4, 512, 2, 16), (4, 512, 2, 1)])
def test_vectors_equal_brute_force(spark, monkeypatch, vectors, leaf, block, fan, group):
    for name, value in (("LEAF", leaf), ("BLOCK_BYTES", block), ("FAN", fan), ("GROUP", group)):
        monkeypatch.setattr(embedding_join, name, value)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, n_links int")
    assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == sorted(brute.near_vectors(vectors))


def test_vectors_null_ids_and_empty(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [2.0, 0.1]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embedding_join.near_vectors(df).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (5, 0, 5, True)], key=str)
    assert embedding_join.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: 7 if i % 2 else None])
def test_texts_of_one_id_are_joined_by_their_text(spark, monkeypatch, ids):
    """Rows that share an id, or have none, cost what others do: each text is moved once."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = [(ids(i), edited(rng, base, 0.02 * (i % 4))) for i in range(120)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    moved, wrapped = [], minhash.table
    monkeypatch.setattr(minhash, "table", lambda d, name: moved.append((name, out := wrapped(d, name), out.count())[::2]) or out)
    got = sorted(map(tuple, minhash.near_texts(df).collect()), key=str)
    assert got == sorted(brute.near_texts(rows), key=str)
    assert dict(moved)["shingle-sets"] <= 120


def test_texts_of_over_one_piece(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(9000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[1000:])), (3, " ".join(long[:150_000])), (4, "short text of a few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r)[2:] for r in sorted(minhash.near_texts(df).collect())] == [(1, True), (1, False), (3, True), (4, True)]


def tied():
    """Vectors with cosines of exactly 0.9: a unit vector and the orders of (9, 3, 3, 1), at several scales."""
    import itertools

    units = [[float(i == k) for i in range(4)] for k in range(4)]
    orders = sorted(set(itertools.permutations((9.0, 3.0, 3.0, 1.0))))
    return units + [list(o) for o in orders] + [[3 * x for x in o] for o in orders[:4]] + [[0.25 * x for x in units[2]]]


@pytest.mark.parametrize("block", [embedding_join.BLOCK_BYTES, 64])
def test_vectors_that_meet_the_threshold_exactly(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(embedding_join, "LEAF", 2 if block == 64 else embedding_join.LEAF)
    rows = list(enumerate(tied()))
    got = sorted(map(tuple, embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == brute.near_vectors(rows)
    assert got[0][1] >= 3


def test_what_no_tile_asks_for_is_not_exchanged(spark):
    from lectern.llm import minhash

    rows = spark.range(4000).selectExpr("id AS uid", "cast(id AS string) AS shingles")
    asked = spark.range(0, 4000, 100).selectExpr("id AS uid")
    got = {r.uid for r in minhash._asked_for(rows, asked).collect()}
    assert {*range(0, 4000, 100)} <= got and len(got) < 1000
