import random
import zlib

import brute
import pytest

from lectern.llm import decontaminate, mixing, toxicity, url_rules


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,)])
def test_mix(spark, weights):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "c", "C", "é", None, "tiny"] if i % 50 else ["one"])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "only empty"), (1002, "x", None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = {r.doc_id: r for r in mixing.mix(df, weights=weights).collect()}
    words = {i: len((t or "").split()) for i, t, _ in rows}
    size, target = brute.mix([(s, words[i]) for i, _, s in rows], weights)
    assert len(got) == len(rows)
    for i, _, s in rows:
        r = got[i]
        assert (r["size"], r.source_size) == (words[i], size[s]) and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * words[i] and (r["size"] == 0 or r.taken % r["size"] == 0)
    for s in size:
        taken, largest = (f(x) for f, x in ((sum, [got[i].taken for i, _, t in rows if t == s]), (max, [words[i] for i, _, t in rows if t == s])))
        assert abs(taken - target[s]) <= largest
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), weights=weights).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mix(df.limit(0)).collect() == []


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y", "https://www.example.com/en/", "http://example.com/EN/", "http://x.net/es/1#z", "http://net/fr/", "http://xnet/fr/",
    "http://a.com", "http://a.com/", "http://com/x", "http://evil.org/spam/x", "http://spamfarm.org/", "http://my-example.com/en/", "ftp://example.com:80/en/", "a://b://example.com/en/", "http://é.com/\n/en/",
]


def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(brute.LOW), rest[cut:].split("?")[0].split("#")[0]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


@pytest.mark.parametrize("inline", [url_rules.INLINE_RULES, 0])
def test_urls(spark, inline):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = sorted(url_rules.judge_urls(df, inline=inline).collect())
    assert [r.page_id for r in got] == list(range(len(URLS)))
    for r, url in zip(got, URLS):
        host, path, rule, verdict = judged(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if "/spam/" in (url or "") else "allow"))
    assert url_rules.judge_urls(df.limit(0), inline=inline).collect() == []


def test_hits_and_clean_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 60)))) for i in range(30)] + [(90, "two words"), (91, None), (92, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    texts, want = [], {}
    for i in range(200):
        text = filler(rng.randint(0, 200))
        if i % 4 == 0:
            item = rng.randrange(30)
            words = [word() if rng.random() < 0.15 and i % 8 else w for w in items[item][1].split()]
            text, want[i] = f"{text} {' '.join(words).upper()} {filler(20)}", item
        texts.append((i, text))
    texts += [(500, None), (501, ""), (502, "has two words in it"), (None, items[3][1]), (503, items[5][1] * 1 + " " + items[5][1])]
    df = spark.createDataFrame([(*t, "s", "x") for t in texts], "doc_id long, text string, source string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_hits(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == {*want.items(), (502, 90), (None, 3), (503, 5)}
    for r in got:
        if r.score == 1.0 and r.doc_id is not None:
            assert dict(texts)[r.doc_id].lower().split()[r.first_word : r.end_word] == dict(items)[r.item_id].split()
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in texts} - {p[0] for p in pairs}
    assert decontaminate.benchmark_hits(df, bench.limit(0)).collect() == [] and decontaminate.benchmark_hits(df.limit(0), bench).collect() == []


def test_item_blocks_give_the_same(spark, monkeypatch, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(decontaminate.benchmark_hits(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(decontaminate.benchmark_hits(docs, bench).collect()) == one


def test_part_of_an_item_in_many_texts(spark, monkeypatch):
    """60 texts hold the first 22 of an item's 40 words: their seeds are common, and no text holds the item's others."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, filler(40)) for i in range(4)]
    texts = [(i, filler(10) + (items[0][1][:22] if i < 60 else items[1][1][5:30] if i < 65 else []) + filler(10)) for i in range(80)]
    want = {(d, i): brute.align(a, b) / 80 for d, b in texts for i, a in items}
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert len(want) >= 65
    df = spark.createDataFrame([(d, " ".join(b)) for d, b in texts], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(a)) for i, a in items], "item_id long, text string")
    for pairs in (1 << 20, 50):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert {(r.doc_id, r.item_id): r.score for r in decontaminate.benchmark_hits(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {d for d, _ in texts} - {d for d, _ in want}


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 60])
def test_hits_equal_all_pairs(spark, monkeypatch, block_words):
    """Every document with every item, among them edited, equal and overlapping items and a very long text."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(150)]
    filler = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, filler(rng.randint(1, 40))) for i in range(14)]
    items += [(20, items[3][1]), (21, items[4][1][:10] + items[5][1]), (22, items[6][1] + items[6][1])]

    def edited(words):
        out = []
        for x in words:
            r = rng.random()
            out += [] if r < 0.06 else [x, rng.choice(vocabulary)] if r < 0.12 else [rng.choice(vocabulary)] if r < 0.2 else [x]
        return out

    docs = []
    for i in range(70):
        words = filler(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng.choice(items)[1])
        docs.append((i, " ".join(words).upper() if i % 2 else "\n".join(words)))
    docs += [(100, " ".join(filler(20_000) + items[7][1] + filler(20_000))), (101, None), (102, docs[3][1]), (102, docs[3][1])]
    named = [(i, " ".join(a)) for i, a in items]
    df = spark.createDataFrame([(d, t, 0.5, 1) for d, t in docs], "doc_id long, text string, score double, item_id int").repartition(3)
    got = decontaminate.benchmark_hits(df, spark.createDataFrame(named, "item_id long, text string")).collect()
    want = brute.benchmark_hits(docs, named)
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(want) > 40
    assert len(got) == len(want) + sum(d == 102 for d, _ in want)


def test_alignment_equals_plain_table():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64) for _ in "ab")
        assert decontaminate.align(a, b)[0] == brute.align(a.tolist(), b.tolist())


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in held)
    assert hit / sum(r.toxic for r in held) >= 0.85 and hit / max(1, sum(r.predicted for r in held)) >= 0.85
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert (again.codes == model.codes).all() and abs(again.weights - model.weights).max() < 1e-9


def test_toxicity_equals_plain_python(spark, monkeypatch):
    """Scores equal those of a plain version, for accented and Bengali letters too; with many steps of few entries."""
    monkeypatch.setattr(toxicity, "ENTRIES", 500)
    rng = random.Random(8)
    common, bad = [["".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(n)] for n, letters in ((25, "abcdéüকখ "), (6, "xyzßগঘ"))]
    rows = []
    for i in range(260):
        words = [rng.choice(common) for _ in range(rng.randint(0, 15))] + [rng.choice(bad) for _ in range(4 * (i % 3 == 0))]
        rng.shuffle(words)
        rows.append((i, rng.choice(["\t", " ", "\n"]).join(words).upper() if i % 4 else " ".join(words), int(i % 3 == 0)))
    rows.append((400, None, 0))
    docs = spark.createDataFrame([(i, t, "toxic", 1) for i, t, _ in rows], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    learned = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    want, kept = brute.toxicity([t for _, t, _ in rows], learned)
    assert len(model.weights) == kept > 50
    got = {r.doc_id: r for r in toxicity.score(docs.repartition(3), model).collect()}
    for (i, _, _), s in zip(rows, want):
        assert got[i].score == pytest.approx(s, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_toxicity_bounds_rows_not_ids(spark):
    rows = [(i % 7, f"text {i} of many words", i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    h = docs.select(toxicity._hash("doc_id", "text").alias("h"))
    for most in (0, 1, 17, 299, 300, 1000):
        assert toxicity.lowest(h, "h", most).count() == min(most, 300)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, max_rows=40).scores(["text"]).shape == (1,)
    assert toxicity.fit(docs.limit(0), labels).bias == 0.0


def test_very_long_and_repeated_rows_are_judged_alike(spark):
    long = "a fine day " * 100_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, "you idiot scum " + long), (None, ""), (None, None)], "doc_id long, text string")
    model = toxicity.Model.constant(2.0)
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [1] * 5
    assert toxicity.drop_toxic(docs, model).count() == 0 and toxicity.drop_toxic(docs.limit(0), model).collect() == []
    model.bias = -2.0
    assert sorted(map(repr, toxicity.drop_toxic(docs, model).collect())) == sorted(map(repr, docs.collect()))


def test_urls_null_repeated_and_very_long(spark):
    long = "http://example.com/en/" + "x" * 1_000_000 + "?" + "spam/" * 1000
    rows = [(None, long), (None, None), (3, long), (3, long), (4, "http://a.org/" + "y/" * 200_000 + "casino/z")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for inline in (url_rules.INLINE_RULES, 0):
        got = sorted(((r.page_id, r.rule, r.verdict, len(r.path)) for r in url_rules.judge_urls(df, inline=inline).collect()), key=str)
        fits = ("example.com/en/", "block", 1_000_004)
        assert got == sorted([(None, *fits), (None, None, "allow", 0), (3, *fits), (3, *fits), (4, None, "block", 400_009)], key=str)


def test_toxicity_odd_rows(spark):
    rows = [(i, ("you idiot scum " if i % 2 else "a fine day ") * 3, i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None), (901, ""), (1, "you idiot scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 2} == {1}
    assert {r.predicted for r in got if r.doc_id is None or r.doc_id in (900, 901)} == {0}
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_mix_of_repeated_and_null_ids_comes_near_its_target(spark):
    """Rows of one id, or of none, and equal rows: each source is within half a document of its target."""
    rows = [(5, " ".join(["w"] * (10 + i % 3)) + f" {i}", "a") for i in range(400)] + [(None, f"x{i} y z", "b") for i in range(500)]
    rows += [(7, "same words here", "c")] * 900 + [(None, None, "d")] * 3 + [(8, "one two", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, weights=(1, 1, 8)).collect()
    words = [(s, len((t or "").split())) for _, t, s in rows]
    size, target = brute.mix(words, (1, 1, 8))
    taken, ids = dict.fromkeys(size, 0), {5: "a", 7: "c", 8: None}
    for r in got:
        source = next(s for s in size if size[s] == r.source_size)
        taken[source] += r.taken
        assert r.doc_id is None or ids[r.doc_id] == source
    assert len(got) == len(rows) and target["c"] > size["c"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 13 / 2
    again = mixing.mix(df.repartition(2), weights=(1, 1, 8)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, got)))
