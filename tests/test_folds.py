"""Folds and boxes against plain Python."""

import random

import pytest

from lectern.functions import bengali
from lectern.operators import geometry as geo
from lectern.operators import ledger as lg
from lectern.queries import QUERIES
from lectern.sources import documents as src


def rows_plain(boxes):
    boxes = sorted(boxes, key=lambda b: ((b[2] + b[4]) / 2, b[1], b[0]))
    heights = sorted(b[4] - b[2] for b in boxes)
    limit, rows, held = 0.6 * heights[len(heights) // 2], [], []
    for b in boxes:
        mid = (b[2] + b[4]) / 2
        if not held or abs(mid - sum(held) / len(held)) > limit:
            rows.append([])
            held = []
        rows[-1].append(b)
        held.append(mid)
    return [" ".join(b[0] for b in sorted(r, key=lambda b: b[1])) for r in rows]


def test_rows_of_boxes(spark):
    rng = random.Random(1)
    pages = {p: [(f"b{i}", rng.random(), y := rng.random(), 1.0, y + 0.02 + rng.random() / 50, 0.5 + i / 100) for i in range(rng.randint(1, 30))] for p in range(12)}
    df = spark.createDataFrame([(p, *b) for p, boxes in pages.items() for b in boxes], "p int, text string, x0 double, y0 double, x1 double, y1 double, score double")
    got = geo.rows_of_boxes(df, ["p"]).orderBy("p", "row").collect()
    for p, boxes in pages.items():
        assert [r.text for r in got if r.p == p] == rows_plain(boxes)
    assert min(r.score for r in got if r.p == 0) == min(b[5] for b in pages[0])


def test_router_updates(spark):
    rng = random.Random(2)
    events = [(u, i, rng.choice(lg.ACTIONS), [rng.random() for _ in range(9)], rng.choice([-1.0, 1.0])) for u in range(3) for i in range(25)]
    want = {}
    for u, i, a, x, r in sorted(events, key=lambda e: e[:2]):
        w = want.get((u, a), list(lg.PRIOR[a]))
        error = r - sum(p * q for p, q in zip(w, x))
        want[u, a] = [0.995 * p + 0.15 * error * q for p, q in zip(w, x)]
    df = spark.createDataFrame(events, "u int, i int, action string, x array<double>, reward double")
    got = {(r.u, r.action): r.theta for r in lg.learn_router(df, ["u"], ["i"]).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_nearest_value_titles_and_columns(spark):
    shape = "p int, text string, x0 double, x1 double, y0 double, y1 double"
    labels = spark.createDataFrame([(1, "Name:", 10.0, 60.0, 100.0, 112.0), (1, "Date:", 10.0, 60.0, 300.0, 312.0)], shape)
    values = spark.createDataFrame([(1, "far", 200.0, 250.0, 101.0, 113.0), (1, "Karim", 70.0, 120.0, 104.0, 118.0), (1, "below", 70.0, 90.0, 130.0, 140.0), (2, "other", 70.0, 90.0, 300.0, 312.0)], shape)
    assert [tuple(r) for r in geo.nearest_values(labels, values, ["p"]).collect()] == [(1, "Name:", "Karim")]
    lines = spark.createDataFrame([(1, "1. numbered", 0.0, 1.0, 0.1, 0.2), (1, "LOAN", 0.0, 1.0, 0.1, 0.15), (1, "FORM", 0.0, 1.0, 0.2, 0.24), (1, "Name: x", 0.0, 1.0, 0.3, 0.5), (1, "LOW", 0.0, 1.0, 0.7, 0.9)], shape)
    assert [tuple(r) for r in geo.titles(lines, ["p"]).collect()] == [(1, "LOAN FORM")]
    cells = [(1, 0, "Gross worth", 0.82, 0.90), (1, 1, "Total", 0.30, 0.34), (1, 1, "5", 0.5, 0.6), (1, 1, "7", 0.82, 0.9), (2, 0, "Gross worth", 0.82, 0.90), (2, 1, "Total", 0.3, 0.34), (2, 1, "7", 0.8, 0.88), (2, 1, "8", 0.84, 0.9)]
    boxes = spark.createDataFrame(cells, "p int, row int, text string, x0 double, x1 double")
    assert [tuple(r) for r in geo.column_totals(boxes, ["p"], "gross worth").collect()] == [(1, "7")]


def test_promotion_and_trust(spark):
    live = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "category string, right boolean")
    better = spark.createDataFrame([("a", True), ("a", True), ("b", True)], "category string, right boolean")
    worse_in_b = spark.createDataFrame([("a", True), ("a", True), ("a", True), ("b", False)], "category string, right boolean")
    assert lg.promote(better, live).first().promoted and not lg.promote(worse_in_b, live).first().promoted
    assert not lg.promote(better.filter("category = 'a'"), live).first().promoted
    seen = spark.createDataFrame([("date", "vision", True), ("date", "ocr", False), ("amount_hw", "vision", False)], "kind string, source string, right boolean")
    assert {r.kind: r.prefer for r in lg.trust(seen).collect()} == {"date": "vision", "amount_hw": "ocr"}


def test_item_numbers_of_all_lines(spark, sf):
    pages = {(r.doc_id, r.page): r.lines for r in src.pages_of_table(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert max(map(len, pages.values())) > 9
    got = {(r.doc_id, r.page): r.rows for r in QUERIES["fn25_repair_numbers"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    for key, lines in pages.items():
        assert got[key] == "\n".join(f"{i // 9 + 1}.{i % 9 + 1} {x}" for i, x in enumerate(lines))


def test_legacy_bengali_of_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert max(len(r.text or "") for r in docs) > 1000
    got = QUERIES["fn22_legacy_bengali"](spark, sf).collect()
    want = [(r.doc_id, None if r.text is None else bengali.to_unicode("cÖwZôv‡bi bvg " + r.text)) for r in docs]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert all(r.converted is None or r.converted.startswith("প্রতিষ্ঠানের নাম ") for r in got)
