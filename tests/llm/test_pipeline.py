import random

import brute

import corpus_pipeline
from lectern.llm import secrets


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    docs, toxic, leaked = [], set(), set()
    for i in range(300):
        words = [word() for _ in range(60)]
        kind = i % 6
        if kind == 1:
            words[10:10] = ["you", "worthless", "idiot", "scum", "moron"]
            toxic.add(i)
        if kind == 2:
            words[5:5] = items[i % 5][1].split()
            leaked.add(i)
        if kind == 3 and docs:
            words = docs[-3][1].split()[:-1] + ["changed"] if docs[-3][0] % 6 == 0 else words
        if kind == 4:
            words.append("password=hunter2222")
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 0))
    docs.append((999, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int(d[0] in toxic)) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
            now.write.parquet(f"{tmp_path}/stage{n}")
            now = spark.read.parquet(f"{tmp_path}/stage{n}")
        seen.append({r.doc_id: r for r in now.collect()})
    left = [d for d in docs if d[0] not in toxic]
    assert set(seen[0]) == {d[0] for d in left}
    kept = {r[0] for r in brute.near_texts([d[:2] for d in left]) if r[3]}
    assert set(seen[1]) == kept and len(kept) < len(left)
    assert set(seen[2]) == kept - leaked
    assert set(seen[3]) == set(seen[2])
    for i, r in seen[3].items():
        before = seen[2][i].text
        assert r.text == (secrets._redacted(before) if before else before)
        assert "hunter" not in (r.text or "")
        assert r.n_chars == (len(r.text) if r.text != before else seen[2][i].n_chars)
    size, target = brute.mix([(r.source, len((r.text or "").split())) for r in seen[3].values()])
    assert set(seen[4]) == set(seen[3])
    for i, r in seen[4].items():
        assert (r.source_size, round(r.target, 6)) == (size[seen[3][i].source], round(target[seen[3][i].source], 6)) and r.taken <= 3 * r["size"]
    whole = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: tuple(r) for i, r in seen[4].items()}


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No documents at all; repeated rows, null ids and columns whose names the operators use themselves."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, _row int, key string, `taken` int, hub int"
    text = "one two three four five six seven eight nine ten password=hunter2222 {}"
    rows = [(1, text.format(1), "en", "a", 1, 1, "k", 1, 1)] * 3 + [(None, "quite another text with other words in it", "en", None, 1, 1, "k", 1, 1)] * 2
    rows += [(None, None, None, None, None, None, None, None, None)] * 2 + [(7, "", "", "", 0, 0, "", 0, 0)]
    for name, given in (("none", []), ("odd", rows)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(given, shape).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)][: len(given)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "an item that nothing here holds at all")][: len(given)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in corpus_pipeline.run(spark, folder).collect())
        # of the repeated rows one stays; those without words all do
        assert got == ([] if not given else [(False, 1, 12), (False, 7, 0), (True, 0, 0), (True, 0, 0), (True, 0, 8)])
