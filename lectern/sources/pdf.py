"""Text layers of PDF files: what their text operators draw, and where, as rows; lines and blocks are made by Spark."""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bengali
from ..functions import text as T
from ..operators.geometry import rows_of_boxes
from . import sinks
from .documents import page_source

FRAGMENTS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
PAGES = f"file long, path string, page int, width double, height double, scan_ratio double, fragments {FRAGMENTS}"
#: What a damaged file may raise while it is read; it then has one empty page.
BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, RecursionError, OverflowError, ZeroDivisionError)
#: Lines belong to one block if less than this share of a line's height is between them.
BLOCK_GAP = 0.7

_SPACE, _DELIMITERS = b" \t\n\r\x0c\x00", b"()<>[]{}/%"
_WORD = re.compile(rb"[^ \t\n\r\x0c\x00()<>\[\]{}/%]+")
_WHOLE, _NUMBER = re.compile(rb"[+-]?\d+"), re.compile(rb"[+-]?(\d+\.\d*|\.\d+)")
_REFERENCE = re.compile(rb"[ \t\n\r\x0c\x00]+\d+[ \t\n\r\x0c\x00]+R(?![^ \t\n\r\x0c\x00()<>\[\]{}/%])")
_PLAIN_MAPS = re.compile(rb"beginbf(char|range)((?:[ \t\n\r\x0c\x00]*<(?:[0-9A-Fa-f]{2})*>)*[ \t\n\r\x0c\x00]*)endbf\1(?![^ \t\n\r\x0c\x00()<>\[\]{}/%])")
_GAP, _HEX = re.compile(rb"(?:[ \t\n\r\x0c\x00]+|%[^\r\n]*)*"), re.compile(rb"<((?:[0-9A-Fa-f]{2})*)>")  # white space and comments
_CODES, _ENDS = re.compile(rb"<([0-9A-Fa-f]*)>"), re.compile(rb"endbf(?:char|range)|%")
_ESCAPE = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}


class Name(str):
    """A name such as /Type."""


class Word(str):
    """An operator or keyword."""


class Ref(int):
    """The number of an object that stands elsewhere."""


class Parser:
    """Values of PDF syntax, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        self.at = _GAP.match(self.data, self.at).end()

    def value(self):
        """The next value; None at the end."""
        self._skip()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        c = data[at : at + 1]
        if c == b"/":
            m = _WORD.match(data, at + 1)
            self.at = m.end() if m else at + 1
            name = (m[0] if m else b"").decode("latin-1")
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), name) if "#" in name else name)
        if c == b"(":
            return self._string()
        if data[at : at + 2] == b"<<":
            self.at += 2
            items = self._until(">>")
            return dict(zip(items[0::2], items[1::2]))
        if c == b"<":
            m = _HEX.match(data, at)
            if m:
                self.at = m.end()
                return bytes.fromhex(m[1].decode())
            end = data.index(b">", at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until("]")
        if data[at : at + 2] == b">>" or c in (b"]", b"{", b"}", b")", b">"):
            self.at += 2 if data[at : at + 2] == b">>" else 1
            return Word(data[at : self.at].decode())
        m = _WORD.match(data, at)
        self.at = m.end()
        text = m[0]
        if _WHOLE.fullmatch(text):
            follow = _REFERENCE.match(data, self.at)
            if follow:
                self.at = follow.end()
                return Ref(text)
            return int(text)
        if _NUMBER.fullmatch(text):
            return float(text)
        return {b"true": True, b"false": False}.get(text, Word(text.decode("latin-1")))

    def _until(self, end: str) -> list:
        out = []
        while (v := self.value()) is not None:
            if isinstance(v, Word) and v == end:
                return out
            out.append(None if isinstance(v, Word) and v == "null" else v)
        raise ValueError("a list or dictionary has no end")

    def _string(self) -> bytes:
        data, out, depth = self.data, bytearray(), 1
        self.at += 1
        while depth:
            c = data[self.at : self.at + 1]
            if not c:
                raise ValueError("a string has no end")
            self.at += 1
            if c == b"\\":
                m = _ESCAPE.match(data, self.at)
                self.at = m.end()
                if m[0][:1] in b"01234567":
                    out.append(int(m[0], 8) & 255)
                elif m[0][:1] not in b"\r\n":
                    out += _ESCAPES.get(m[0], m[0])
                continue
            depth += (c == b"(") - (c == b")")
            if depth:
                out += c
        return bytes(out)


class Pdf:
    """The objects of a file, found by its cross-reference tables, or by looking through the file where these don't serve."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.trailer, self.places, self.packed, self.held = data, {}, {}, {}, {}
        try:
            self._tables()
            self.pages_root()
        except BROKEN:
            self._look_through()
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    def _tables(self) -> None:
        at, seen = int(re.findall(rb"startxref\s+(\d+)", self.data)[-1]), set()
        while at is not None and at not in seen:
            seen.add(at)
            p = Parser(self.data, at)
            if p.value() != "xref":
                raise ValueError("no table")
            while isinstance(first := p.value(), int):
                for k in range(first, first + p.value()):
                    place, _, kind = p.value(), p.value(), p.value()
                    if kind == "n":
                        self.places.setdefault(k, place)
            trailer = p.value()
            self.trailer = {**trailer, **self.trailer}
            at = trailer.get("Prev")
        for k, place in self.places.items():
            if not re.match(rb"\s*%d\s+\d+\s+obj" % k, self.data[place : place + 40]):
                raise ValueError("a table points elsewhere")

    def _look_through(self) -> None:
        """Objects by their headings, those in object streams too; later ones win."""
        self.places, self.packed, self.held, self.trailer = {}, {}, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b", self.data):
            self.places[int(m[1])] = m.start()
        for m in re.finditer(rb"\btrailer\b", self.data):
            self.trailer.update(Parser(self.data, m.end()).value() or {})
        for k in list(self.places):
            try:
                held = self.get(Ref(k))
            except BROKEN:
                continue
            if isinstance(held, tuple) and held[0].get("Type") == "ObjStm":
                body = self.content(held)
                numbers = Parser(body)
                heads = [numbers.value() for _ in range(2 * self.get(held[0]["N"]))]
                for number, offset in zip(heads[0::2], heads[1::2]):
                    self.packed[number] = (body, self.get(held[0]["First"]) + offset)
            if isinstance(held, tuple) and held[0].get("Type") == "XRef":
                self.trailer.update({n: v for n, v in held[0].items() if n in ("Root", "Encrypt")})
            if isinstance(held, dict) and held.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(k))
        for number, (body, offset) in self.packed.items():
            if (v := Parser(body, offset).value()) and isinstance(v, dict) and v.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(number))
        self.pages_root()

    def pages_root(self) -> dict:
        return self.get(self.get(self.trailer["Root"])["Pages"])

    def get(self, v):
        """What a reference names, streams as (dictionary, bytes); other values as they are."""
        if not isinstance(v, Ref):
            return v
        if v not in self.held:
            if v in self.packed:
                body, at = self.packed[v]
                self.held[v] = Parser(body, at).value()
            elif v not in self.places:
                return None
            else:
                p = Parser(self.data, self.places[v])
                p.value(), p.value(), p.value()
                found = p.value()
                m = re.compile(rb"\s*stream\r?\n").match(self.data, p.at)
                if isinstance(found, dict) and m:
                    size = self.get(found.get("Length"))
                    if not isinstance(size, int) or not re.match(rb"\s*endstream", self.data[m.end() + size : m.end() + size + 20]):
                        size = self.data.index(b"endstream", m.end()) - m.end()
                    found = (found, self.data[m.end() : m.end() + size])
                self.held[v] = found
        return self.held[v]

    def content(self, stream) -> bytes:
        """A stream's bytes; nothing where it is packed otherwise than by Flate."""
        if not isinstance(stream, tuple):
            return b""
        kinds, raw = self.get(stream[0].get("Filter")), stream[1]
        for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
            if self.get(kind) not in ("FlateDecode", "Fl"):
                return b""
            unpacker = zlib.decompressobj()
            raw = unpacker.decompress(raw) + unpacker.flush()
        return raw

    def pages(self) -> list[dict]:
        """The pages in order, with what they inherit."""
        out, seen = [], set()
        todo = [(self.get(self.trailer["Root"])["Pages"], {})]
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen:
                continue
            seen.add(ref if isinstance(ref, Ref) else None)
            own = {**above, **{k: node[k] for k in ("Resources", "MediaBox") if k in node}}
            kids = self.get(node.get("Kids"))
            if kids is None:
                out.append({**node, **own})
            else:
                todo += [(k, own) for k in kids[::-1]]
        return out


class Font:
    """Characters and widths of a font's codes."""

    def __init__(self, pdf: Pdf, font: dict):
        inner = pdf.get((pdf.get(font.get("DescendantFonts")) or [None])[0])
        self.size = 2 if font.get("Subtype") == "Type0" else 1
        self.default, self.widths = 500, {}
        if inner:
            self.default = pdf.get(inner.get("DW", 1000))
            w = pdf.get(inner.get("W")) or []
            while w:
                first, second = w[0], pdf.get(w[1])
                if isinstance(second, list):
                    self.widths.update(enumerate(second, first))
                    w = w[2:]
                else:
                    self.widths.update(dict.fromkeys(range(first, second + 1), w[2]))
                    w = w[3:]
        elif "Widths" in font:
            self.widths = dict(enumerate(map(pdf.get, pdf.get(font["Widths"])), pdf.get(font.get("FirstChar", 0))))
        self.chars, self.ranges, self.known = {}, [], {}
        if "ToUnicode" in font:
            self._map(pdf.content(pdf.get(font["ToUnicode"])))
        self.starts = [a for a, *_ in self.ranges]
        self.sorted = all(a <= b < c for (a, b, *_), c in zip(self.ranges, self.starts[1:]))

    def _map(self, cmap: bytes) -> None:
        number, text = lambda b: int.from_bytes(b, "big"), lambda b: b.decode("utf-16-be", "ignore")
        if not _ENDS.search(_PLAIN_MAPS.sub(b" ", cmap)):  # all parts are plain lists of codes
            for kind, body in _PLAIN_MAPS.findall(cmap):
                codes = [bytes.fromhex(x.decode()) for x in _CODES.findall(body)]
                if kind == b"char":
                    self.chars.update({number(a): text(b) for a, b in zip(codes[0::2], codes[1::2])})
                else:
                    self.ranges += [(number(a), number(b), number(c), len(c)) for a, b, c in zip(codes[0::3], codes[1::3], codes[2::3])]
            return
        p, held = Parser(cmap), []
        while (v := p.value()) is not None:
            if not isinstance(v, Word):
                held.append(v)
                continue
            if v == "endbfchar":
                self.chars.update({number(a): text(b) for a, b in zip(held[0::2], held[1::2])})
            elif v == "endbfrange":
                for a, b, c in zip(held[0::3], held[1::3], held[2::3]):
                    if isinstance(c, list):
                        self.chars.update(zip(range(number(a), number(b) + 1), map(text, c)))
                    else:
                        self.ranges.append((number(a), number(b), number(c), len(c)))
            held = []

    def _char(self, code: int) -> bytes:
        at = bisect.bisect_right(self.starts, code) if self.sorted else 0
        near = next(((c + code - a).to_bytes(n, "big") for a, b, c, n in (self.ranges[max(at - 1, 0) : at] if self.sorted else self.ranges) if a <= code <= b), None)
        if code not in self.chars and near is not None:
            return near
        other = bytes([code]).decode("cp1252", "ignore") if self.size == 1 else ""
        return self.chars.get(code, other).encode("utf-16-be")

    def read(self, raw: bytes) -> tuple[str, float, int]:
        """A string's text, its width in thousandths of the font's size, and how many codes it has."""
        whole = raw if len(raw) % self.size == 0 else raw[:-1] + b"\0" + raw[-1:]  # half a code at the end counts as it is
        codes = struct.unpack(f">{len(whole) // self.size}{'H' if self.size == 2 else 'B'}", whole)
        for code in set(codes).difference(self.known):
            self.known[code] = self._char(code)
        parts = map(self.known.__getitem__, codes)
        text = b"".join(parts).decode("utf-16-be", "ignore")  # halves of one character may be codes of their own
        wide = sum(self.widths.get(c, self.default) for c in codes) if self.widths or not isinstance(self.default, int) else self.default * len(codes)
        return text, wide, len(codes)


def _times(m: tuple, n: tuple) -> tuple:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def drawn(pdf: Pdf, page: dict) -> tuple[float, float, float, list[tuple]]:
    """(width, height, scan ratio, fragments) of a page: each text that is shown, with its box as shares of the page from its
    upper left corner; the scan ratio is the largest share of the page that one image covers."""
    x0, y0, x1, y1 = (float(pdf.get(v)) for v in pdf.get(page.get("MediaBox")) or (0, 0, 612, 792))
    width, height = abs(x1 - x0), abs(y1 - y0)
    left, low = min(x0, x1), min(y0, y1)
    resources = pdf.get(page.get("Resources")) or {}
    named = lambda kind, name: pdf.get((pdf.get(resources.get(kind)) or {}).get(name))
    fonts: dict[str, Font] = {}
    contents = pdf.get(page.get("Contents"))
    streams = contents if isinstance(contents, list) else [contents]
    p = Parser(b"\n".join(pdf.content(pdf.get(s)) for s in streams))
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    state = {"ctm": unit, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
    stack, held, line, at, out, share = [], [], unit, unit, [], 0.0

    def box(m, corners):
        xs, ys = zip(*((m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x, y in corners))
        return (min(xs) - left) / width, 1 - (max(ys) - low) / height, (max(xs) - left) / width, 1 - (min(ys) - low) / height

    end = None

    def show(raw):
        nonlocal at, end
        if state["font"] is None or not isinstance(raw, bytes):
            return
        text, wide, codes = state["font"].read(raw)
        size = state["size"]
        across = (wide / 1000 * size + codes * state["char"] + raw.count(b" ") * state["word"] * (state["font"].size == 1)) * state["scale"]
        place = _times(at, state["ctm"])
        if text.strip():
            base = state["rise"]
            sides = box(place, [(x, y) for x in (0, across) for y in (base - 0.2 * size, base + 0.8 * size)])
            if out and end is not None and abs(place[5] - end[1]) < 1e-6 and abs(place[4] - end[0]) <= 0.15 * size * abs(place[0]):
                old = out[-1]  # goes on where the last one ended
                out[-1] = (old[0] + text, min(old[1], sides[0]), min(old[2], sides[1]), max(old[3], sides[2]), max(old[4], sides[3]))
            else:
                out.append((text, *sides))
        at = _times((1, 0, 0, 1, across, 0), at)
        end = _times(at, state["ctm"])[4:] if text.strip() else None

    def next_line(x, y):
        nonlocal line, at
        line = at = _times((1, 0, 0, 1, x, y), line)

    while (v := p.value()) is not None:
        if not isinstance(v, Word):
            held.append(v)
            continue
        a, op = held, str(v)
        held = []
        if op == "BI":  # an image inside the stream: what follows up to its end is not text
            over = re.compile(rb"[ \t\n\r]EI(?=[ \t\n\r])").search(p.data, p.at)
            p.at = over.end() if over else len(p.data)
        elif op == "q":
            stack.append(dict(state))
        elif op == "Q" and stack:
            state.update(stack.pop())
        elif op == "cm" and len(a) == 6:
            state["ctm"] = _times(tuple(map(float, a)), state["ctm"])
        elif op == "BT":
            line = at = unit
        elif op == "Tf" and len(a) == 2:
            if a[0] not in fonts:
                font = named("Font", a[0])
                fonts[a[0]] = Font(pdf, font) if isinstance(font, dict) else None
            state["font"], state["size"] = fonts[a[0]], float(a[1])
        elif op in ("Tc", "Tw", "TL", "Ts") and a:
            state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[op]] = float(a[0])
        elif op == "Tz" and a:
            state["scale"] = a[0] / 100
        elif op in ("Td", "TD") and len(a) == 2:
            if op == "TD":
                state["lead"] = -a[1]
            next_line(*a)
        elif op == "Tm" and len(a) == 6:
            line = at = tuple(map(float, a))
        elif op == "T*":
            next_line(0, -state["lead"])
        elif op == "Tj" and a:
            show(a[0])
        elif op in ("'", '"') and a:
            if op == '"' and len(a) == 3:
                state["word"], state["char"] = a[:2]
            next_line(0, -state["lead"])
            show(a[-1])
        elif op == "TJ" and a and isinstance(a[0], list):
            for part in a[0]:
                if isinstance(part, bytes):
                    show(part)
                elif isinstance(part, int | float):
                    at = _times((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), at)
        elif op == "Do" and a:
            held_object = named("XObject", a[0])
            if isinstance(held_object, tuple) and held_object[0].get("Subtype") == "Image":
                b = box(state["ctm"], [(0, 0), (1, 0), (0, 1), (1, 1)])
                share = max(share, (b[2] - b[0]) * (b[3] - b[1]))
    return width, height, share, out


def read_pdfs(files: DataFrame) -> DataFrame:
    """(file, path, page, width, height, scan_ratio, fragments) of PDF files (path, content); fragments as they are drawn.

    file numbers the rows of files, so that equal paths are told apart.

    Contents come from any store that Spark reads. A damaged or encrypted file, and a null or empty content, is one page
    without fragments; a page that can't be read is one among the others.
    """

    def run(batches):
        for batch in batches:
            for number, path, content in zip(*(batch.column(c).to_pylist() for c in ("file", "path", "content"))):
                rows, none = [], (0.0, 0.0, 0.0, [])
                try:
                    pdf = Pdf(content or b"")
                    for page in pdf.pages():
                        try:
                            rows.append(drawn(pdf, page))
                        except BROKEN:
                            rows.append(none)
                except BROKEN:
                    rows = rows or [none]
                rows = rows or [none]
                kind = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))]))
                listed = [[dict(zip(("text", "x0", "y0", "x1", "y1"), f)) for f in r[3]] for r in rows]
                columns = [pa.array([number] * len(rows), pa.int64()), pa.array([path] * len(rows), pa.string()), pa.array(range(1, len(rows) + 1), pa.int32()), *(pa.array([float(r[k]) for r in rows]) for k in range(3)), pa.array(listed, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "path", "page", "width", "height", "scan_ratio", "fragments"])

    return files.select(F.monotonically_increasing_id().alias("file"), "path", "content").mapInArrow(run, PAGES)


def blocks(pages: DataFrame, gap: float = BLOCK_GAP) -> DataFrame:
    """(file, path, page, block, text, x0, y0, x1, y1): lines of fragments, and lines that stand close below each other as blocks.

    White space inside a line is collapsed; a block's lines are joined by line breaks.
    """
    each = pages.select("file", "path", "page", F.explode("fragments").alias("f")).select("file", "path", "page", "f.*")
    each = each.withColumn("score", F.lit(1.0))
    lines = rows_of_boxes(each, ["file", "path", "page"]).withColumn("text", F.btrim(F.regexp_replace("text", r"\s+", " "))).filter("text <> ''")
    order = Window.partitionBy("file", "path", "page").orderBy("row")
    far = F.col("y0") - F.lag("y1").over(order) > gap * (F.col("y1") - F.col("y0"))
    numbered = lines.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("block", F.sum("far").over(order).cast("int"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda r: r["text"]), "\n")
    return numbered.groupBy("file", "path", "page", "block").agg(texts.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def text_pages(files: DataFrame) -> DataFrame:
    """(file, path, page, source, lines, boxes, legacy) of PDF files (path, content): the blocks of each page, top down.

    A page of under 40 characters has no text layer of use (none), one that is mostly one image another reader's
    (scan-text). Pages of a legacy Bengali font are converted and marked. What the files hold is written, as it is read
    twice; a file is parsed once.
    """
    pages, folder = read_pdfs(files), sinks.new_folder(files.sparkSession, "pdf-pages")
    pages.write.parquet(folder)
    pages = files.sparkSession.read.schema(pages.schema).parquet(folder)
    box = F.struct("block", "text", "x0", "y0", "x1", "y1")
    held = blocks(pages).groupBy("file", "page").agg(F.array_sort(F.collect_list(box)).alias("b"))
    joined = pages.select("file", "path", "page", "scan_ratio").join(held, ["file", "page"], "left")
    texts = F.coalesce(F.transform("b", lambda b: b["text"]), F.array().cast("array<string>"))
    chars = F.aggregate(texts, F.lit(0), lambda s, t: s + F.length(t))
    kept = chars >= 40
    out = joined.withColumn("source", page_source(chars, F.col("scan_ratio"))).withColumn("lines", F.when(kept, texts).otherwise(F.array().cast("array<string>")))
    place = lambda b: F.struct(*(b[c].alias(c) for c in ("x0", "y0", "x1", "y1")))
    out = out.withColumn("boxes", F.when(kept, F.transform("b", place)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")))
    out = out.withColumn("legacy", T.is_legacy(F.array_join("lines", " ")))
    return out.withColumn("lines", _converted(F.col("lines"), F.col("legacy"))).select("file", "path", "page", "source", "lines", "boxes", "legacy")


def _converted(lines: Column, legacy: Column) -> Column:
    """Lines in Unicode where they are in a legacy font; other lines don't leave the JVM."""
    import pandas as pd

    convert = F.pandas_udf(lambda s: pd.Series([None if x is None else list(map(bengali.to_unicode, x)) for x in s]), "array<string>")
    return F.when(legacy, convert(F.when(legacy, lines))).otherwise(lines)
