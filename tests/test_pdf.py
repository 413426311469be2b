import zlib

import pytest

from lectern.queries import _pdf_file
from lectern.sources import pdf


def file_of(body: bytes, more: dict[int, bytes] | None = None, page: bytes = b"", font: bytes = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>") -> bytes:
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 200 100]>>", 5: font, **(more or {})}
    objects[3] = b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F 5 0 R>>/XObject<</I 6 0 R>>>>" + page + b">>"
    objects[4] = b"<</Length %d>>stream\n%s\nendstream" % (len(body), body)
    out, at = b"%PDF-1.4\n", {}
    for n, x in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj %s endobj\n" % (n, x)
    table = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at[n]) for n in sorted(at))
    return out + b"trailer <</Root 1 0 R/Size 9>>\nstartxref\n%d\n%%%%EOF" % table


def fragments(data: bytes):
    found = pdf.Pdf(data)
    return [(t, *(round(x, 4) for x in sides)) for page in found.pages() for t, *sides in pdf.drawn(found, page)[3]]


@pytest.mark.parametrize(
    "body, want",
    [
        (b"BT /F 10 Tf 20 50 Td (Hello) Tj ET", [("Hello", 0.1, 0.42, 0.225, 0.52)]),
        (b"BT /F 10 Tf 2 0 0 2 20 50 Tm (Hi) Tj ET", [("Hi", 0.1, 0.34, 0.2, 0.54)]),
        (b"q .5 0 0 .5 10 0 cm BT /F 10 Tf 20 50 Td (Hi) Tj ET Q BT /F 10 Tf (lo) Tj ET", [("Hi", 0.1, 0.71, 0.125, 0.76), ("lo", 0.0, 0.92, 0.05, 1.02)]),
        (b"BT /F 10 Tf 12 TL 20 50 Td (a\\(b\\)\\101\\\n) Tj T* (c) ' <64 65> Tj ET", [("a(b)A", 0.1, 0.42, 0.225, 0.52), ("cde", 0.1, 0.66, 0.175, 0.76)]),
        (b"BT /F 10 Tf 20 50 Td [(far) -2000 (away) 0 (er)] TJ ET", [("far", 0.1, 0.42, 0.175, 0.52), ("awayer", 0.275, 0.42, 0.425, 0.52)]),
        (b"BT /F 10 Tf 3 Tc 5 Tw 50 Tz 20 50 Td (a b) Tj ET", [("a b", 0.1, 0.42, 0.1725, 0.52)]),
        (b"BT /F 10 Tf 20 50 Td (1) Tj 0 -20 TD (2) Tj T* (3) Tj ET BI /W 1 ID xx(\x00 EI BT 0 0 Td (4) Tj ET", [("1", 0.1, 0.42, 0.125, 0.52), ("2", 0.1, 0.62, 0.125, 0.72), ("3", 0.1, 0.82, 0.125, 0.92), ("4", 0.0, 0.92, 0.025, 1.02)]),
        (b"% a comment (no text) Tj\nBT (no font) Tj /G 10 Tf (no such font) Tj ET", []),
    ],
)
def test_text_operators(body, want):
    assert fragments(file_of(body)) == want


def test_fonts_images_and_packed_objects():
    simple = b"<</Type/Font/Subtype/TrueType/FirstChar 65/Widths[100 200]/ToUnicode 7 0 R>>"
    cmap = b"1 beginbfchar <41> <0416> endbfchar 1 beginbfrange <42> <43> [<00660069> <D83DDE00>] endbfrange"
    more = {6: b"<</Subtype/Image/Length 1>>stream\nx\nendstream", 7: b"<</Filter/FlateDecode/Length 8 0 R>>stream\n%s\nendstream" % zlib.compress(cmap), 8: b"%d" % len(zlib.compress(cmap))}
    data = file_of(b"BT /F 10 Tf 0 50 Td (ABC) Tj ET q 100 0 0 80 10 10 cm /I Do Q", more, font=simple)
    assert fragments(data)[0][:1] == ("Жfi\U0001f600",) and fragments(data)[0][3] == round(8 / 200, 4)
    found = pdf.Pdf(data)
    assert pdf.drawn(found, found.pages()[0])[2] == pytest.approx(0.4)
    inner = {3: b"<</Type/Page/Parent 2 0 R/Contents 9 0 R/Resources<</Font<</F 5 0 R>>>>>>", 2: b"<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 200 100]>>", 5: b"<</Type/Font>>", 1: b"<</Type/Catalog/Pages 2 0 R>>"}
    heads, body = "", b""
    for n, x in inner.items():
        heads += f"{n} {len(body)} "
        body += x + b" "
    packed = zlib.compress(heads.encode() + body)
    text = b"BT /F 10 Tf 20 50 Td (inside) Tj ET"
    data = b"%%PDF-1.5\n8 0 obj <</Type/ObjStm/N 4/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n9 0 obj <</Length %d>>stream\n%s\nendstream endobj\n" % (len(heads), len(packed), packed, len(text), text)
    assert [f[0] for f in fragments(data)] == ["inside"]


def test_damaged_files_are_one_empty_page(spark):
    good = _pdf_file(1, [f"line {i}" for i in range(90)])
    files = [("a", None), ("b", b""), ("c", b"no pdf"), ("d", good), ("e", good[: len(good) // 3]), ("f", good.replace(b"trailer", b"trailxx")), ("f", good.replace(b"/Root", b"/Encrypt 1 0 R/Root")), (None, b"%PDF-1.4")]
    found = pdf.text_pages(spark.createDataFrame(files, "path string, content binary")).collect()
    pages = sorted((str(r.path), r.page, r.source, len(r.lines)) for r in found)
    whole = [(1, "text", 8), (2, "text", 8), (3, "text", 2)]
    assert [p[1:] for p in pages if p[0] == "d"] == whole
    assert sorted(p[1:] for p in pages if p[0] == "f") == [(1, "none", 0), *whole]
    assert [p for p in pages if p[0] in "abc" or p[0] == "None"] == [(k, 1, "none", 0) for k in ("None", "a", "b", "c")]
    assert pdf.text_pages(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_a_long_line_and_blocks(spark):
    data = _pdf_file(2, ["x" * 200_000] + ["word   gap"] * 6)
    rows = pdf.blocks(pdf.read_pdfs(spark.createDataFrame([("p", data)], "path string, content binary"))).orderBy("block").collect()
    assert [r.text for r in rows] == ["x" * 200_000 + "\nword gap" * 4, "word gap\nword gap"]


def test_files_are_parsed_once_and_plain_maps_at_once(spark, monkeypatch):
    from lectern.sources import pdf

    body = b"/CMapName /X def 2 beginbfchar <0041> <0042> <01> <D83DDE00> endbfchar 3 beginbfrange <0050> <0060> <0070>\n<10><1f> <0100> <0000><0002><0030> endbfrange"

    def font(cmap):
        class File:
            get = staticmethod(lambda v: v)
            content = staticmethod(lambda v: v)

        return pdf.Font(File, {"Subtype": "Type0", "ToUnicode": cmap})

    slow = font(b"% read value by value\n" + body)
    with monkeypatch.context() as m:
        m.setattr(pdf, "Parser", None)
        fast = font(body)
    assert (fast.chars, fast.ranges) == (slow.chars, slow.ranges) and not fast.sorted
    for f in (fast, slow):
        assert f.read(b"\x00\x41\x00\x55\x00\x11\x00\x01")[0] == "Bu\u0101\U0001f600"
    bounds = font(b"2 beginbfrange <0010> <001f> <0100> <0030> <003f> <0200> endbfrange")
    assert bounds.sorted and bounds.read(b"\x00\x10\x00\x1f\x00\x20\x00\x30\x00\x3f\x00\x40\x00\x0f")[0] == "\u0100\u010f\u0200\u020f"
    out = pdf.text_pages(spark.createDataFrame([("a.pdf", b"%PDF-1.4 damaged"), ("b.pdf", None)], "path string, content binary"))
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 2
