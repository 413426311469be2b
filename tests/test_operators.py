"""Small cases of columns and operators: nulls, empty texts, ties, scopes and folds."""


import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import conversation as cv
from lectern.operators import extract as ex
from lectern.operators import index as ix
from lectern.operators import ledger as lg
from lectern.operators import verify as vf
from lectern.plans import models
from lectern.sources import documents as src
from lectern.sources import sinks
from lectern.streaming import traces


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ("The FEMALE. e&g 4.6 a.b@c", ["female", "4.6", "a.b@c"]),
        ("été café", ["caf"]),
        ("১.৭ আয়", ["1.7", "আয়"]),
        ("x -- .. 50%", ["50%"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(T.nfc("t")), t=text) == want
    assert T.tokens_of(text or "") == want


def test_composed_and_decomposed_letters_are_equal(spark):
    assert one(spark, T.tokens(T.nfc("t")), t="আয়") == one(spark, T.tokens(T.nfc("t")), t="আয়")


@pytest.mark.parametrize("word, want", [("signed", "sign"), ("bring", "bring"), ("brands", "brand"), ("gas", "gas"), ("cats", "cat"), ("boxes", "boxe")])
def test_stem(spark, word, want):
    assert one(spark, T.stem("w"), w=word) == want == T.stem_of(word)


def test_scalar_functions(spark):
    assert one(spark, T.fix_dates("t"), t="24/0212026") == "24/02/2026"
    assert one(spark, T.find_date("t"), t="45/13/2020 then 3 - 4.99") == "3/4/99"
    assert one(spark, T.find_number("t"), t="12 1,234. 567") == "1,234"
    assert one(spark, T.entities("t"), t="What Is This about Karim Rahman of New York City") == ["Karim Rahman", "New York City"]
    assert one(spark, T.item_refs("t"), t="item ১.৭ and 1.2.3") == ["1.7"]
    assert one(spark, T.item_refs("t"), t="worked 4.6 years") == []
    assert one(spark, T.tidy_amount("t"), t=" $ 48 801,10") == "$48801,10"
    assert one(spark, T.windows("t"), t="  ") == []
    assert one(spark, T.sentences("t"), t="One. Two!\n\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, T.support("a", "e", "q"), a="", e="x", q="") == 0.0
    assert one(spark, T.support("a", "e", "q"), a="red red blue total", e="red", q="total") == pytest.approx(2 / 3)
    assert not one(spark, T.same_value("a", "b"), a="", b="") and one(spark, T.same_value("a", "b"), a="1,000", b="1000")
    assert [one(spark, T.csv_cell("t"), t=x) for x in ("=1", " +1", "\tx", "ok", None)] == ["'=1", "' +1", "'\tx", "ok", ""]


def test_pages_and_chunks(spark):
    df = spark.createDataFrame([(1, "\n".join(f" line {i} " for i in range(50))), (2, None), (3, " \n ")], "doc_id long, text string")
    pages = src.pages_of_table(df)
    assert sorted((r.doc_id, r.page, len(r.lines)) for r in pages.collect()) == [(1, 1, 45), (1, 2, 5), (2, 1, 0), (3, 1, 0)]
    small = spark.createDataFrame([(1, 1, ["a" * 300, "b" * 200, "c"]), (2, 1, [])], "doc_id long, page int, lines array<string>")
    assert [(r.doc_id, r.chunk, len(r.chunk_text)) for r in src.chunks_of(small).collect()] == [(1, 0, 501), (1, 1, 1)]


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes(b"x\n\n y \xff\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "p.png").write_bytes(b"\x89PNG")
    with zipfile.ZipFile(tmp_path / "m.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p> </w:p><w:p x='1'>Bye</w:p>")
    got = {r.name: (r.kind, r.source, r.lines) for r in src.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "text", ["x", "y"]), "empty.csv": ("text", "text", []), "p.png": ("image", "none", []), "m.docx": ("docx", "text", ["Hello", "Bye"])}


def test_search_ties_scope_and_nothing_found(spark):
    rows = [(1, 1, "loan amount approved"), (2, 1, "loan amount approved"), (3, 1, "loan loan loan"), (4, 1, "nothing of note")]
    units = ix.add_tokens(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    assert [r.doc_id for r in ix.search(units, "loan amount", 3).collect()] == [1, 2, 3]
    scoped = ix.search(units, "loan amount", 3, F.col("doc_id") > 1).collect()
    assert [r.doc_id for r in scoped] == [2, 3] and scoped[0].score == ix.search(units, "loan amount", 1).first().score
    assert ix.search(units, "zebra").collect() == [] and ix.search(units, "the of").collect() == []
    assert ix.best_coverage(units.limit(0), "loan").first()[0] == 0.0
    near = ix.search_many(units, spark.createDataFrame([("q", "loan amount"), ("z", "zebra")], "query_id string, q string"), ["doc_id", "page"], 3)
    assert [(r.query_id, r.doc_id) for r in near.orderBy("rank").collect()] == [("q", 1), ("q", 2), ("q", 3)]
    assert [r.score for r in near.orderBy("rank").collect()] == [r.score for r in ix.search(units, "loan amount", 3).collect()]


def test_stored_index_gives_the_same(spark, tmp_path):
    rows = [(1, 1, "loan amount approved"), (2, 1, "loan amount of Karim Rahman"), (3, 1, "loans and the loan loan"), (4, 1, "nothing of note"), (4, 2, "")]
    units = ix.add_tokens(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    held = ix.Index.build(units, ("doc_id", "page"), f"{tmp_path}/index")
    flat = lambda df: [tuple(r[c] for c in sorted(df.columns) if c != "toks") for r in df.collect()]
    for q in ("loan amount", "What did Karim Rahman loan?", "zebra", "the of"):
        assert flat(ix.search(held, q, 3)) == flat(ix.search(units, q, 3))
        assert flat(ix.rank_pages(held, q, 3)) == flat(ix.rank_pages(units, q, 3))
        assert sorted(flat(ix.trigram_scores(held, q))) == sorted(flat(ix.trigram_scores(units, q)))
        assert flat(ix.best_coverage(held, q)) == flat(ix.best_coverage(units, q))
    assert ix.rank_pages(held, "What did Karim Rahman loan?", 1).first().doc_id == 2
    assert sorted(flat(ix.document_frequencies(ix.drop_page(held, 1, 1)))) == sorted(flat(ix.document_frequencies(units.filter("doc_id > 1"))))
    asked = spark.createDataFrame([("q", "loaned lender amounts approving zebra"), ("n", None)], "query_id string, q string")
    assert sorted(map(tuple, ix.unseen_terms(asked, held).collect())) == sorted(map(tuple, ix.unseen_terms(asked, units).collect())) == [("q", "lender"), ("q", "zebra")]


def test_absent_terms(spark):
    units = ix.add_tokens(spark.createDataFrame([(1, 1, "the applicant signature and employer 1993DEPARTMENT")], "doc_id long, page int, text string"))
    terms = {r.term for r in ix.absent_terms(units, "Was the department work signed by a zebra applicants employerr?").collect()}
    assert terms == {"zebra"}
    assert ix.should_abstain(units, "zebra giraffe okapi", 30) and not ix.should_abstain(units, "applicant signature", 30)


def test_fields(spark):
    pages = spark.createDataFrame([(1, "Owner: Maya\nTotal: 1200\nDate: 2026-10-04\nhttps://example.com\n", "text"), (2, "Total: 100\nTotal: 200", "ocr")], "doc_id long, text string, source string")
    got = [(r.doc_id, r.label, r.value) for r in ex.line_fields(pages, ["doc_id"]).orderBy("doc_id", "n").collect()]
    assert got == [(1, "Owner", "Maya"), (1, "Total", "1200"), (1, "Date", "2026-10-04"), (2, "Total", "100"), (2, "Total", "200")]
    assert {r.doc_id: r.verified for r in ex.extract_all(pages, ["doc_id"]).collect()} == {1: True, 2: False}
    assert ex.parse_labels("Name: A B\n\nDate of Birth:\n\n1 May", {"name", "date of birth"}) == [("Name", "A B", 0), ("Date of Birth", "1 May", 11)]
    fields = spark.createDataFrame([(1, "Loan Amount", "5", 0), (1, "Loan Amount", "6", 9), (2, "Loan Amount", "7", 0)], "doc_id long, label string, value string, pos int")
    assert {r.doc_id: r.answer for r in ex.field_answers(fields, ["loan", "amount"], ["doc_id"]).collect()} == {1: "Multiple matches: 5; 6", 2: "7"}


def test_lexicon_too_large_to_ship_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"Name: N{i}\n\nDate of Birth: {i}\n\nnote - Tax ID:\n\n{i}") for i in range(5)], "doc_id long, text string")
    lexicon = ex.learn_labels(pages)
    one_way = sorted(map(tuple, ex.lexicon_fields(pages, lexicon, ["doc_id"]).collect()))
    monkeypatch.setattr(ex, "MAX_LABELS", 1)
    assert sorted(map(tuple, ex.lexicon_fields(pages, lexicon, ["doc_id"]).collect())) == one_way and len(one_way) == 15


def test_ledger(spark):
    events = spark.createDataFrame([(1, i, n) for i, n in enumerate([60, 50, 30, 20, 10])], "u int, i int, n long")
    assert tuple(lg.spend(events, ["u"], ["i"], "n", 100.0).first()) == (1, 3, 100.0)
    assert [(r.used, r.overshoot) for r in lg.charge(events, ["u"], ["i"], "n", 100.0).orderBy("i").collect()] == [(60, 0.0), (110, 10.0), (140, 40.0), (160, 60.0), (170, 70.0)]
    assert tuple(lg.extensions(events, ["u"], ["i"], "n", 65.0).first()) == (1, 1, 4, 5.0)


def test_limits_and_what_is_left(spark):
    rows = spark.createDataFrame([("frugal", 1.0, {"tool_calls": 5.0, "other": 3.0}, 1.0), ("frugal", None, {"ocr_pages": 3.0}, 0.0), ("odd", None, {}, 0.0)], "preset string, own double, asked map<string,double>, used double")
    held = lg.change_limits(lg.limits(rows, overrides={"ocr_pages": "own"}), "asked").collect()
    assert [(r.changed, r.limit_ocr_pages, r.limit_tool_calls) for r in held] == [(False, 1.0, 4.0), (True, 3.0, 4.0), (False, None, None)]
    left = lg.left(F.col("limit"), F.col("allowance"), F.col("used"))
    many = spark.createDataFrame([(4.0, None, 1.0), (4.0, 9.0, 1.0), (4.0, 2.0, 1.0), (4.0, None, 6.0)], "limit double, allowance double, used double")
    assert [(r.left, r.can) for r in many.select(left.alias("left"), lg.can(left, F.lit(2.0)).alias("can")).collect()] == [(3.0, True), (3.0, True), (1.0, False), (0.0, False)]


def test_prompts_are_refused_before_they_are_paid(spark):
    rows = spark.createDataFrame([(["x" * 9000], 1500.0), (["hello"], 1500.0), (["hello"], 20.0), (None, 5.0)], "m array<string>, tokens double")
    got = models.chat_rows(rows, "m", "tokens").collect()
    assert [(r.refused, r.used, r.left_after) for r in got] == [(True, 0, 1500.0), (False, 1, 1499.0), (True, 0, 20.0), (None, 0, 5.0)]


def test_answers(spark):
    from lectern.functions import readers

    units = ix.add_tokens(spark.createDataFrame([(1, 1, "Burger 12,000\n\nTOTAL 31,000"), (2, 1, "The branch office is in Gulshan"), (3, 1, "branch office hours")], "doc_id long, page int, text string"))
    asked = [(1, "What is the total amount?", 4000, 8), (2, "zebra giraffe okapi", 4000, 8), (3, "Where is the branch office", 4000, 8), (4, "Where is the branch office", 30, 8), (5, "branch office", 4000, 0), (6, None, 4000, 8)]
    calls = spark.sparkContext.accumulator(0)

    def chat(messages, most):
        calls.add(1)
        return ("It is in Gulshan" if "Gulshan\n" in messages[-1]["content"] else "no idea"), 10

    got = {r.query_id: r for r in models.answers(units, spark.createDataFrame(asked, "query_id int, q string, tokens_left int, calls_left int"), [readers.amount_reading], chat).collect()}
    assert (got[1].answer, got[1].strategy, got[1].support, got[1].tokens_left) == ("31,000", "rows", 1.0, 4000.0)
    assert (got[2].strategy, got[2].answer, got[2].verified) == ("abstain", models.NOTHING, False)
    assert (got[3].strategy, got[3].answer, got[3].verified, got[3].place in (1, 2), got[3].tokens_left < 4000.0) == ("text", "It is in Gulshan", True, True, True)
    assert (got[4].strategy, got[4].answer, got[4].tokens_left) == ("text", models.NOTHING, 30.0)
    assert (got[5].strategy, got[5].answer) == ("budget", models.NOTHING) and got[6].answer == models.NOTHING
    assert calls.value >= 1


def test_verify_across_scripts(spark):
    rows = [("ঋণের পরিমাণ কত?", "amount 5000 taka", "amount 500", "amount 500", 0.0), ("ঋণের পরিমাণ কত?", "amount 500", "amount 500", "amount 500", 0.0)]
    got = vf.verify(spark.createDataFrame(rows, "question string, answer string, evidence string, page_text string, coverage double")).collect()
    assert [(r.final_answer, r.support, r.verified) for r in got] == [("Not found in the documents.", 0.0, False), ("amount 500", 0.55, False)]


def test_conversation(spark):
    turns = spark.createDataFrame([(1, 1, "What is the total amount?"), (1, 2, "and the subtotal?"), (1, 3, "the tax?"), (2, 1, "the tax?"), (2, 2, None)], "c int, n int, q string")
    assert [r.resolved for r in cv.resolve_turns(turns, "c", "n", "q").orderBy("c", "n").collect()] == ["What is the total amount?", "What is the subtotal?", "What is the tax?", "the tax?", None]
    asked = spark.createDataFrame([("Please tell me the Loan amount", "s"), ("What's the loan term", "s"), ("loan amount", "other")], "question string, state string")
    cache = spark.createDataFrame([("loan amount?", "s", "5")], "question string, state string, answer string")
    assert {r.question: r.cached for r in cv.cache_lookup(asked, cache).collect()} == {"Please tell me the Loan amount": "5", "What's the loan term": None, "loan amount": None}


def test_traces(spark, tmp_path):
    rows = [(f"2026-01-01 00:0{i}:00", "text", 10.0, 1.0, i % 2 == 0) for i in range(6)] + [("2026-01-02 00:00:00", "ocr", 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "ts string, strategy string, tokens double, seconds double, verified boolean")
    sinks.append_traces(df, f"{tmp_path}/traces")
    traces.write_usage(traces.usage(traces.read_traces(spark, f"{tmp_path}/traces")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.strategy, r.n, r.tokens, r.verified_share) for r in got] == [("text", 6, 60.0, 0.5)]


def test_extraction_csv(spark, tmp_path):
    fields = spark.createDataFrame([("Total", "=1+1", "d", 1, True), ("আয়", None, "d", None, False)], "field string, value string, document string, page int, verified boolean")
    sinks.write_extraction(fields.coalesce(1), f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿field,value,document,page,verified") and "Total,'=1+1,d,1,true" in text


def test_support_cuts_each_text_once(spark):
    """The answer was cut three times, and the evidence again for each token of it."""
    assert str(T.support("answer_", "evidence_", "question_")).count("answer_") == 1
    df = spark.createDataFrame([("Alpha beta beta gamma", "beta alpha", "alpha?"), (None, "x", "y"), ("aa bb", None, None)], "a string, e string, q string")
    assert [r.s for r in df.select(T.support("a", "e", "q").alias("s")).collect()] == [pytest.approx(2 / 3), 0.0, 0.0]


def test_page_evidence_judges_sentences_in_their_row(spark):
    text = " ".join(f"Sentence number {i} is about {'loan amounts' if i % 7 == 3 else 'other things'} here." for i in range(40))
    units = ix.add_tokens(spark.createDataFrame([(1, 1, text), (2, 1, "short loan")], "doc_id long, page int, text string"))
    out = ix.page_evidence(units, "What is the loan amount?")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, round(r.score, 3)): r.evidence for r in out.collect()}
    assert got[2, 1.0] == "short loan" and all("loan amounts" in e for e in got.values() if len(e) > 20) and len(got) >= 2


def test_vector_top_meets_block_by_block(spark, monkeypatch):
    """Ties, null and short vectors, null ids: as by all pairs, and no vector goes through the driver."""
    import random

    monkeypatch.setattr(ix, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(ix, "QUERY_BLOCK", 3)
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1.0, 0.5, 0.1234565, 1e-7]) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0, None, 1.0, 1.0]), (62, [1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (64, [1.0, float("nan"), 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 5 = 0 OR vec_id in (61, 62)").selectExpr("vec_id AS query_id", "embedding AS q")
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    want = ix.top(q.crossJoin(v).select("query_id", "vec_id", F.round(dot, 6).alias("score")), ["query_id"], [F.desc("score"), F.desc("vec_id")], 3)
    plain = lambda df: sorted(str(tuple(r)) for r in df.select("query_id", "vec_id", "score", "rank").collect())
    monkeypatch.setattr(type(q), "collect", lambda self, f=type(q).collect: f(self) if "q" not in self.columns else pytest.fail("vectors are collected"))
    assert plain(ix.vector_top(v, q)) == plain(want)
