import random

import numpy as np
import pytest

from lectern.functions import raster
from lectern.operators import checkbox
from lectern.queries import ROW_SIZE, _drawn


def slow_threshold(pixels):
    best, at = -1.0, 0
    n = len(pixels)
    for t in range(256):
        low, high = [p for p in pixels if p <= t], [p for p in pixels if p > t]
        if low and high:
            between = len(low) * len(high) / n**2 * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if between > best * (1 + 1e-12) + 1e-12:
                best, at = between, t
    return at


def slow_components(w, h, raw):
    """Pixel by pixel, by flooding."""
    t = slow_threshold(list(raw)) if raw else 0
    ink = {(i % w, i // w) for i, v in enumerate(raw) if v <= t}
    out = []
    for y in range(h):
        for x in range(w):
            if (x, y) not in ink:
                continue
            todo, own = [(x, y)], []
            ink.discard((x, y))
            while todo:
                a, b = todo.pop()
                own.append((a, b))
                for near in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if near in ink:
                        ink.discard(near)
                        todo.append(near)
            xs, ys = [p[0] for p in own], [p[1] for p in own]
            out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own), sum(xs) / len(own), sum(ys) / len(own)))
    return out


def test_components_equal_flooding():
    rng = np.random.default_rng(4)
    images = [(0, 0, b""), (1, 1, b"\x05"), (7, 5, bytes(35))]
    for _ in range(60):
        w, h = rng.integers(1, 24, 2)
        images.append((int(w), int(h), rng.choice(np.array([0, 40, 200, 255], np.uint8), w * h, p=[0.3, 0.1, 0.3, 0.3]).tobytes()))
    got = raster.components(images).to_pylist()
    for (w, h, raw), found in zip(images, got):
        want = slow_components(w, h, raw)
        assert [tuple(f.values())[:5] for f in found] == [x[:5] for x in want]
        assert np.allclose([tuple(f.values())[5:] for f in found], [x[5:] for x in want]) or not want
    assert raster.components([]).to_pylist() == []


def test_threshold_equals_a_plain_search():
    rng = random.Random(2)
    for _ in range(20):
        pixels = [rng.choice([rng.randint(0, 90), rng.randint(120, 255)]) for _ in range(300)]
        assert raster.threshold(np.array(pixels, np.uint8)) == slow_threshold(pixels)


def slow_ticked(boxes, question, comps):
    """The rules over plain lists."""
    import re

    from lectern.functions.words import ROW_GENERIC

    boxes = sorted([(t.strip(), x0, y0, x1, y1) for t, x0, y0, x1, y1 in boxes], key=lambda b: b[1])
    if len(boxes) < 2:
        return None, []
    words = [w for w in re.findall("[a-z]{4,}", question.lower()) if w not in ROW_GENERIC]
    label = next((i for i, b in enumerate(boxes) if any(w in b[0].lower() for w in words)), None)
    options = []
    if label is not None and len(boxes[label][0].partition(":")[2].strip()) >= 2:
        options.append((re.sub("^[^A-Za-z]+", "", boxes[label][0].partition(":")[2].strip()), *boxes[label][1:]))
    for b in boxes[(label or 0) + 1 :]:
        if b[0].endswith(":") and options:
            break
        options.append((re.sub("^[^A-Za-z]+", "", b[0]), *b[1:]))
    names = [o[0] for o in options]
    if len(options) < 2:
        return None, names
    squares = []
    for name, x0, y0, x1, y1 in options:
        h = max(y1 - y0, 12)
        near = [c for c in comps if x0 - 0.7 * h <= c[5] <= x0 + 1.7 * h and y0 - 0.35 * h <= c[6] <= y1 + 0.35 * h and 0.45 * h <= c[3] <= 1.9 * h and 0.45 * h <= c[2] <= 2 * h and 0.55 <= c[2] / c[3] <= 1.8]
        if near:
            c = max(near, key=lambda c: c[2] * c[3])
            squares.append((name, c[4] / (c[2] * c[3]), c[4]))
    if len(squares) < 2 or len(squares) < len(options) - 1:
        return None, names
    fill, area = (sorted(squares, key=lambda s: -s[k]) for k in (1, 2))
    fuller, larger = fill[0][1] - fill[1][1] >= 0.06, area[0][2] >= 1.22 * area[1][2]
    if larger and (not fuller or fill[0] == area[0]):
        return area[0][0], names
    return (fill[0][0] if fuller and not larger else None), names


@pytest.fixture
def cases():
    rng = random.Random(6)
    rows = []
    for k in range(60):
        w, h = ROW_SIZE
        boxes = [(rng.choice(["Kind:", "Kind: One", "kind", ""]) if k % 9 else "No label", 5.0, 14.0, 60.0, 30.0)]
        boxes += [(f"{rng.choice(['', '☐ ', ' '])}Option {i}{':' if rng.random() < 0.05 else ''}", 87.0 + 80 * i + rng.uniform(-6, 6), 14.0, 130.0 + 80 * i, 30.0) for i in range(3 + k % 2)]
        rng.shuffle(boxes)
        rows.append((k, w, h, _drawn(k), boxes[: rng.choice([1, 9, 9, 9, 9, 9, 9])], "Which kind is it?"))
    return rows


SCHEMA = "doc_id int, width int, height int, grey binary, boxes array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>, question string, _boxes int, s int"


def test_ticked_equals_plain_rules(spark, cases):
    df = spark.createDataFrame([(*r, 1, 2) for r in cases], SCHEMA)
    got = {r.doc_id: r for r in checkbox.ticked(checkbox.ink_components(df)).collect()}
    for k, w, h, raw, boxes, question in cases:
        option, names = slow_ticked(boxes, question, slow_components(w, h, raw))
        assert (got[k].option, list(got[k].options)) == (option, names), (k, boxes)
        assert got[k].confident == (option is not None) and got[k].detail
    assert sum(r.confident for r in got.values()) >= 5


def test_odd_rows(spark):
    box = [("Kind:", 1.0, 1.0, 2.0, 2.0), (None, 1.0, 1.0, 2.0, 2.0)]
    rows = [(1, None, None, None, None, None), (2, 0, 3, b"", box, "kind"), (3, 9, 9, b"\x00", [], ""), (4, 2, 2, b"\x00\xff\x00\x00", box * 3, None), (4, 2, 2, b"\x00\xff\x00\x00", box * 3, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    out = checkbox.ticked(checkbox.ink_components(df))
    assert out.columns == [*df.columns, "components", "option", "confident", "options", "detail"]
    assert [(r.option, r.confident) for r in out.collect()] == [(None, False)] * 5
    assert checkbox.ticked(checkbox.ink_components(df.limit(0))).collect() == []
