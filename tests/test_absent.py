import math
import random
import re

import pyarrow as pa
import pytest

from lectern.functions import readers, spelling
from lectern.functions import text as T
from lectern.functions import words as W
from lectern.operators import index as ix


def brute_absent(texts, q, least=0.82):
    toks = [T.tokens_of(t) for t in texts]
    real = {t for own in toks for t in own}
    begun = real | {t[:k] for t in real for k in (3, 4, 5)}
    blob = " ".join(t.lower() for t in texts)
    out = []
    for w in dict.fromkeys(T.tokens_of(q)):
        s = T.stem_of(w)
        if len(w) >= 4 and w in blob or w in begun or any(o in begun for o in W.FORM_SYNONYMS.get(w, ())):
            continue
        if len(w) > 4 and w.endswith(("ed", "ing")) or s in begun or s[:5] in begun or len(s) <= 5 and s[:4] in begun:
            continue
        if len(w) >= 5 and any(abs(len(t) - len(w)) <= 2 and readers.ratio(w, t) >= least for t in real):
            continue
        out.append(w)
    return out


def weight(texts, w):
    n, df = max(len(texts), 1), sum(w in T.tokens_of(t) for t in texts)
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def brute_abstain(texts, q, pages):
    if not texts:
        return 0.0, False
    terms = [w for w in dict.fromkeys(T.tokens_of(q)) if w not in W.ROLE_WORDS]
    total = sum(weight(texts, w) for w in terms)
    share = sum(weight(texts, w) for w in brute_absent(texts, q) if w not in W.ROLE_WORDS) / total if total else 0.0
    best = 0.0
    every = list(dict.fromkeys(T.tokens_of(q)))
    for t in texts:
        own = T.tokens_of(t)
        covered = sum(weight(texts, w) for w in every if w in own or len(w) >= 5 and any(len(x) >= 4 and x[:4] == w[:4] for x in own))
        best = max(best, covered / (sum(weight(texts, w) for w in every) or 1.0))
    if re.search(r"['\"][^'\"]{2,40}['\"]", q) and pages < W.BIG_CORPUS_PAGES:
        return share, False
    return share, share >= W.ABSENT_SHARE and best < W.ABSTAIN_COVERAGE


def changed(rng, word):
    w = list(word)
    for _ in range(rng.randint(0, 2)):
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", rng.choice("abcde")])
    return "".join(w)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 11))) for _ in range(160)] + ["aaaaaaaa", "ababababab", "employer", "signature", "vendor", "2.3", "1993department"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(40)] + ["x.-@y, End", "Form letter"]
    asked = [" ".join(changed(rng, rng.choice(vocabulary)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    asked += ["work designation seller signed", "customer amount number", "department rtme ette", "what is the 'zzzzz yyyyy'", "aaaaaaa abababababa", "the of", "", "itemm serial 9.9 zzzzzzz"]
    return texts, asked


def units_of(spark, texts):
    return ix.add_tokens(spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string"))


def test_absent_terms_equal_plain_python(spark, case):
    texts, asked = case
    queries = spark.createDataFrame([*enumerate(asked), (999, None)], "query_id long, q string")
    got = {}
    for r in ix.absent_many(units_of(spark, texts), queries).collect():
        got.setdefault(r.query_id, set()).add(r.term)
        assert r.idf == pytest.approx(weight(texts, r.term)) and r.role == (r.term in W.ROLE_WORDS)
    assert {k: got.get(k, set()) for k in range(len(asked))} == {k: set(brute_absent(texts, q)) for k, q in enumerate(asked)}
    assert sum(map(bool, got.values())) > 10


def test_spelling_join_loses_no_pair(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 13))) for _ in range(260)} | {"aaaaa", "aaaaaaa", "abababab", "babababa"})
    df = lambda c, v: spark.createDataFrame([(w,) for w in v], f"{c} string")
    for least in (0.82, 0.7, 0.95):
        got = {r.term for r in ix._spelt(df("term", words[::2]), df("token", words[1::2]), least).collect()}
        assert got == {w for w in words[::2] if len(w) >= 5 and any(abs(len(t) - len(w)) <= 2 and readers.ratio(w, t) >= least for t in words[1::2])}


def test_few_words_are_compared_by_spelling(spark, monkeypatch):
    """Pairs with few rare letters in common were compared one by one, so time followed terms times tokens."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeinorstlh") for _ in range(rng.randint(5, 11)))
    tokens, terms = sorted({word() for _ in range(3000)}), sorted({word() for _ in range(60)} | {"%%%%%", "a" * 40})
    compared, alike = [], readers.alike
    monkeypatch.setattr(spelling, "alike", lambda *a: compared.append(1) or alike(*a))
    got = set()
    for batch in spelling.by_length(iter([pa.RecordBatch.from_pydict({"token": tokens})])):
        m, own = batch.column("m")[0].as_py(), batch.column("tokens")[0].as_py()
        near = [t for t in terms if abs(len(t) - m) <= 2]
        got |= spelling.alike_terms(near, own, 0.82) if near else set()
    assert got == {w for w in terms if any(abs(len(t) - len(w)) <= 2 and readers.ratio(w, t) >= 0.82 for t in tokens)}
    assert len(compared) < 0.01 * len(terms) * len(tokens)
    df = lambda c, v: spark.createDataFrame([(w,) for w in v], f"{c} string")
    assert {r.term for r in ix._spelt(df("term", terms), df("token", tokens), 0.82, False).collect()} == got  # also where blocks aren't broadcast


@pytest.mark.parametrize("pages", [3, 30])
def test_abstain_equals_plain_python(spark, case, pages):
    texts, asked = case
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    got = {r.query_id: r for r in ix.abstain_many(units_of(spark, texts), queries, pages).collect()}
    for k, q in enumerate(asked):
        share, abstain = brute_abstain(texts, q, pages)
        assert got[k].share == pytest.approx(share) and got[k].abstain == abstain, q
    assert 0 < sum(r.abstain for r in got.values()) < len(asked)


def test_script_and_items_are_judged_by_whole_samples(spark):
    """Short units: the sample goes on until it is as long as asked, not for a number of units."""
    texts = ["a"] * 300 + ["কখগঘ " * 200]
    queries = spark.createDataFrame([(1, "zebra giraffe okapi"), (2, "serial 4.2 zebra giraffe")], "query_id long, q string")
    got = {r.query_id: r.abstain for r in ix.abstain_many(units_of(spark, texts), queries).collect()}
    assert got[1] is False  # most letters of the sample are Bengali, which the first 20 units don't show
    held = units_of(spark, ["a"] * 40 + ["item 4.2 is here"])
    assert {r.query_id: r.abstain for r in ix.abstain_many(held, queries).collect()} == {1: True, 2: False}


def test_script_and_items_are_those_of_whole_texts(spark):
    """Only the first 3,000 characters were judged."""
    queries = spark.createDataFrame([(1, "zebra giraffe okapi"), (2, "serial 4.2 zebra giraffe"), (3, "serial ৪.২ ৪.৩ zebra giraffe")], "query_id long, q string")
    judged = lambda texts: {r.query_id: r.abstain for r in ix.abstain_many(units_of(spark, texts), queries).collect()}
    assert judged(["vendor " * 600, "কখগঘ " * 1500, None]) == {1: False, 2: False, 3: False}  # 3,600 Latin letters and then 6,000 Bengali ones
    assert judged(["vendor " * 600 + "item 4.2 is here"]) == {1: True, 2: False, 3: True}


def test_no_units_and_no_queries(spark):
    empty = units_of(spark, ["x"]).limit(0)
    queries = spark.createDataFrame([(1, "zebra giraffe"), (1, "zebra giraffe"), (2, None)], "query_id long, q string")
    assert sorted(map(tuple, ix.abstain_many(empty, queries.distinct()).collect())) == [(1, 0.0, 0.0, False), (2, 0.0, 0.0, False)]
    assert ix.abstain_many(units_of(spark, ["x y"]), queries.limit(0)).collect() == []


def test_plans_of_absent_terms_stay_small(spark):
    units = ix.add_tokens(spark.createDataFrame([(1, 1, "loan amount of Karim"), (2, 1, "note about entries")], "doc_id long, page int, text string"))
    asked = spark.createDataFrame([(1, "zyxwvut lones Karin"), (2, "quokka amount")], "query_id int, q string")
    plan = ix.absent_many(units, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") < 6
