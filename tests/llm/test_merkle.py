import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each node the (before, after) siblings of each level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, p in zip(proofs, places):
            start = p - p % 3
            proof.append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 3])))
        nodes, places = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in places]
    return nodes[0], proofs


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    found = []
    for source in order:
        ascending = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        found.append((ascending, *tree([leaf(r) for r in ascending])))
    root, upper = tree([f[1] for f in found])
    out = []
    for (ascending, subroot, proofs), above in zip(found, upper):
        for row, low in zip(ascending, proofs):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf((*row[:4], text))
            for before, after in low + above:
                node = h(before, node, after)
            out.append((row[0], leaf(row), subroot, root, h(*(b + a for b, a in low + above)), node, node == root))
    return out


def run(df, levels):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return [tuple(r) for r in merkle.verified(df, changed, levels=levels).collect()]


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, Tree int, digest string, bucket long"


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equals_brute_force(spark, levels):
    rows = [(i, "hot" if i % 3 else ["a", "é", None, "B", "one"][i % 5] if i > 9 else f"s{i}", None if i % 7 == 0 else "en", i, None if i % 11 == 0 else f"line {i}\nnext" * (i % 4)) for i in range(140)]
    rows += [(None, "a", None, None, "x\n"), (None, "a", None, None, "y"), (5, "hot", "en", 5, "same"), (5, "hot", "en", 5, "same"), (5, None, "", -3, "")]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], COLUMNS).repartition(5)
    assert sorted(run(df, levels), key=repr) == sorted(brute(rows), key=repr)


def test_long_texts_single_rows_and_empty(spark):
    rows = [(2, "s", "en", 1, "word\n" * 400_000)]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], COLUMNS)
    assert run(df, 6) == brute(rows)
    assert run(df.limit(0), 6) == []


def test_proofs_fold_to_the_root(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = merkle.manifest(docs)
    folded = found.select(merkle.fold(F.col("leaf"), F.col("proof")).alias("got"), "root")
    assert folded.filter("got = root").count() == docs.count()
    assert found.select("root").distinct().count() == 1
