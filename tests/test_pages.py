"""Second looks, sideways runs, programs that recognise, background reading and the SQL surface."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import readers, sql
from lectern.functions import words as W
from lectern.operators import geometry as geo
from lectern.sources import commands
from lectern.sources.store import Store
from lectern.streaming import reading


def test_missed_boxes_equal_all_pairs(spark):
    rng = random.Random(7)

    def boxes(n, size):
        out = []
        for i in range(n):
            x, y = rng.random() * 0.9, rng.random() * 0.9
            out.append((rng.choice(["p", "q", None]), i % 20, f"t{i}", x, y, x + rng.random() * size, y + rng.random() * size))
        return out

    first, second = boxes(60, 0.3), boxes(80, 0.3) + [("p", 1, "point", 0.5, 0.5, 0.5, 0.5)]
    schema = "p string, box_id int, text string, x0 double, y0 double, x1 double, y1 double"
    got = geo.fill_missed(spark.createDataFrame(first, schema).filter("p is not null"), spark.createDataFrame(second, schema), ["p"]).filter("look = 2").collect()
    want = []
    for b in second:
        area = max((b[5] - b[3]) * (b[6] - b[4]), 1e-12)
        covered = sum(max(0, min(b[5], a[5]) - max(b[3], a[3])) * max(0, min(b[6], a[6]) - max(b[4], a[4])) for a in first if a[0] is not None and a[0] == b[0]) / area
        if covered < 0.2:
            want.append(b[2])
    assert sorted(r.text for r in got) == sorted(want) and 5 < len(want) < 75


def test_sideways_runs(spark):
    box = lambda p, k, text, x, y, w=12, h=20: (p, k, text, x / 1000, y / 1000, (x + w) / 1000, (y + h) / 1000, 1000.0, 1000.0)
    rows = [box(1, i, c, 500 + i % 3, 100 + 28 * i) for i, c in enumerate("STAMP")]  # a stamp
    rows += [box(1, 10 + i, c, 700, 100 + 60 * i) for i, c in enumerate("FAR")]  # too far apart
    rows += [box(2, i, str(i), 100, 100 + 28 * i) for i in range(4)] + [box(2, 10 + i, "an item", 130, 100 + 28 * i, 200) for i in range(2)]  # a receipt's quantities
    rows += [box(3, i, "x", 100, 100 + 28 * i) for i in range(2)] + [box(3, 5, "a wide one", 100, 156, 300), box(3, 6, "y", 100, 184)]
    rows += [box(None, i, c, 5, 10 + 28 * i) for i, c in enumerate("NIL")]
    df = spark.createDataFrame(rows, "p int, box_id int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double")
    got = sorted(((r.p, r.run, r.fragments, r.text) for r in geo.sideways_runs(df, ["p"]).collect()), key=str)
    assert got == [(1, 1, 5, "STAMP"), (None, 1, 3, "NIL")]
    assert geo.sideways_runs(df.limit(0), ["p"]).collect() == []


def test_programs_that_die_or_hang_cost_their_page_only(spark):
    program = 'read x; case "$x" in die) exit 3;; hang) sleep 30;; *) printf "head\\n5\\t1\\t1\\t1\\t1\\t1\\t20\\t10\\t5\\t5\\t80\\tb\\n5\\t1\\t1\\t1\\t1\\t2\\t10\\t10\\t5\\t5\\t90\\t$x\\nshort\\trow\\n5\\t1\\t1\\t1\\t2\\t1\\tx\\t1\\t1\\t1\\t50\\tno place\\n5\\t1\\t1\\t1\\t3\\t1\\t1\\t1\\t1\\t1\\t-1\\tno word\\n";; esac'
    images = spark.createDataFrame([(1, b"a\n"), (2, b"die\n"), (3, b"hang\n"), (4, None), (5, b"e\n")], "p int, content binary").withColumn("width", F.lit(100.0)).withColumn("height", F.lit(100.0))
    read = commands.run_command(images, ["sh", "-c", program], timeout=2.0).persist()
    assert {r.p: r.failure for r in read.collect()} == {1: None, 2: "ended with 3", 3: "took over 2 s", 4: None, 5: None}
    lines = {r.p: tuple(r)[1:] for r in commands.lines_of_words(read, ["p"]).collect()}
    assert lines == {1: (1, "a b", 0.1, 0.1, 0.25, 0.15, pytest.approx(0.85)), 5: (1, "e b", 0.1, 0.1, 0.25, 0.15, pytest.approx(0.85))}
    missing = commands.run_command(images.limit(1), ["/no/such/program"]).first()
    assert missing.output is None and missing.failure.startswith("can't be started")
    read.unpersist()


def test_what_programs_find_leaves_in_pieces():
    """A batch's outputs were held together until its last image was read."""
    sizes = [0, 10, commands.PIECE_BYTES, 300_000, 900_000, 5]
    batch = pa.RecordBatch.from_pydict({"p": list(range(7)), "content": [b"x"] * 6 + [None]})
    begun = []

    def one(content):
        begun.append(1)
        return "y" * sizes[len(begun) - 1], None

    got = []
    for piece in commands._in_pieces(iter([batch]), one):
        got.append((piece.num_rows, len(begun)))
        assert piece.schema.names == ["p", "content", "output", "failure"]
    assert got == [(3, 3), (2, 5), (2, 6)]


def test_wide_lines_go_to_few_cells(spark):
    """A line as wide as its page went to twenty cells, with its text in each."""
    cells = geo._cells(F.lit(0.01), F.lit(0.99), F.lit(0.101), F.lit(0.12))
    assert spark.range(1).select(F.size(cells)).first()[0] == 4
    box = "p int, box_id int, text string, x0 double, y0 double, x1 double, y1 double"
    second = spark.createDataFrame([(1, 1, "wide", 0.01, 0.1, 0.99, 0.3), (1, 2, None, 0.01, 0.1, 0.99, 0.3), (2, 3, "held", 0.01, 0.1, 0.99, 0.3)], box)
    first = spark.createDataFrame([(2, 1, "there", 0.3, 0.1, 0.99, 0.3)], box)
    assert sorted((r.box_id, r.text or "", r.look) for r in geo.fill_missed(first, second, ["p"]).collect()) == [(1, "there", 1), (1, "wide", 2), (2, "", 2)]


def test_rows_of_answers_compare_few_words(monkeypatch):
    """Each word of a page was compared with each of a question's."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    bent = [w[:2] + "x" + w[2:] if i % 2 else w[:-1] + "e" for i, w in enumerate(words)]
    lines = [" ".join(rng.sample(words, 8)) for _ in range(20)] + [None, "ab"]
    wanted = [*dict.fromkeys(bent[:30])]
    like = lambda v: any(v == w or readers.ratio(v, w) > W.ROW_RATIO for w in wanted)
    compared, ratio = [], geo.alike_above
    monkeypatch.setattr(geo, "alike_above", lambda a, b: compared.append(1) or ratio(a, b))
    got = geo._shared_words.func(pd.Series([lines, None, lines]), pd.Series([wanted, wanted, None]))
    assert got[0] == [sum(map(like, (x or "").split())) if x != "ab" else 0 for x in lines] and sum(got[0]) > 5
    assert got[1] is None and got[2] is None
    assert len(compared) < 0.1 * 160 * len(wanted)


def test_background_reading_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}", 1, f"line {i}\nmore".encode() if i % 4 else b"", float(i % 5)) for i in range(23)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, content binary, relevance double")
    folder = f"file://{tmp_path}/store"
    assert reading.readings(Store(spark, folder)) is None
    assert reading.read_pending(Store(spark, folder), pages, 6, 4) == 6
    best = sorted(rows, key=lambda r: (-r[3], r[0]))[:6]
    assert {r.doc_id for r in reading.readings(Store(spark, folder)).collect()} == {r[0] for r in best}
    with monkeypatch.context() as m:  # dies after it has read, before it is published
        m.setattr(Store, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
        with pytest.raises(RuntimeError):
            reading.read_pending(Store(spark, folder), pages, 99, 4)
    monkeypatch.setattr(reading, "MOST_BATCHES", 2)
    assert reading.read_pending(Store(spark, folder), pages, 99, 6) == 17
    got = {r.doc_id: list(r.lines) for r in reading.readings(Store(spark, folder)).collect()}
    assert got == {d: [x for x in c.decode().split("\n") if x] for d, _, c, _ in rows}
    assert reading.readings(Store(spark, folder)).count() == 23 and reading.read_pending(Store(spark, folder), pages, 99) == 0


def test_functions_in_sql(spark):
    names = sql.register(spark)
    assert sql.register(spark) == names
    texts = [None, "", "a\n\nb\x0bc\r\nd", "\n".join(f"line {i} " + "x" * (i % 60) for i in range(100)), "TOTAL 1,200\nTAX 10"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    lines = spark.sql("SELECT k, page, n, line FROM {df}, LATERAL lectern_lines(text)", df=df).collect()
    assert sorted((r.page, r.n, r.line) for r in lines if r.k == 2) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")]
    assert {(r.page, r.n) for r in lines if r.k == 3} == {(i // 45 + 1, i % 45) for i in range(100)} and not [r for r in lines if r.k < 2]
    rows = spark.sql("SELECT k, n, label, last FROM {df}, LATERAL lectern_receipt(text) WHERE k = 4 ORDER BY n", df=df).collect()
    assert [(r.n, r.label.strip(), r.last) for r in rows] == [(i, x["label"].strip(), x["last"]) for i, x in enumerate(readers.parse_receipt(texts[4]))]
    one = spark.sql("SELECT lectern_content_id('x') AS id, lectern_same_value('1,200.', '1 200') AS same, lectern_support(array('a', 'b'), array('b')) AS support, lectern_support(array(), array('b')) AS none").first()
    assert (len(one.id), one.same, one.support, one.none) == (16, True, 0.5, 0.0)
