"""Secret scans: Aho-Corasick keywords first, anchored expressions at the hits, then checksums."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import pieces, texts_of

# The base kinds in their order, their expressions and shortest lengths.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Public token formats that end in six base-62 digits of the CRC-32 of what stands between.
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
PEM = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = (*BASE, "checked", "pem")

_is_hex = np.zeros(256, bool)
_is_hex[list(b"0123456789abcdef")] = True
_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_WORDS), ("pem", ("-----begin ",))):
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def crc_digits(body: bytes) -> bytes:
    """Six base-62 digits of a CRC-32."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS62[digit : digit + 1] + out
    return out


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Maximal runs of 24 hex digits or more. Such a run holds three places in a row that are multiples of 8."""
    a = np.frombuffer(data, np.uint8)
    probe = _is_hex[a[::8]]
    if len(probe) < 3:
        near = np.flatnonzero(probe)
    else:
        near = np.flatnonzero(probe[2:] & probe[1:-1] & probe[:-2])
    out, end = [], -1
    for p in (near * 8).tolist():
        if p < end:
            continue
        start = p
        while start and data[start - 1] in b"0123456789abcdef":
            start -= 1
        end = HEX.match(data, start).end()
        if end - start >= LEAST["hex"]:
            out.append((start, end))
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed.

    The base kinds take leftmost matches that do not overlap others of their kind; too short ones are dropped, but hold
    their place. checked: tokens whose checksum is right. pem: heads of private keys.
    """
    data = text.encode()
    found: list[tuple[int, int, int]] = []
    ends = dict.fromkeys(KINDS, 0)
    hits = [(i - n + 1, kind) for i, (kind, n) in _automaton().iter(data.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if start < ends[kind]:
            continue
        at = KINDS.index(kind)
        if kind == "assign":
            m = ASSIGN.match(data, start)
            keep = m and len(m[2]) >= LEAST[kind]
        elif kind == "access":
            m = ACCESS.match(data, start)
            keep = m and m.end() - start >= LEAST[kind]
        elif kind == "checked":
            m = CHECKED.match(data, start)
            keep = m and crc_digits(m[1]) == m[2]
        else:
            m = keep = PEM.match(data, start)
        if m:
            ends[kind] = m.end()
            if keep:
                found.append((start, at, m.end()))
    found += [(a, KINDS.index("hex"), b) for a, b in _hex_runs(data)]
    found.sort()
    if found and len(data) != len(text):
        head = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        return [(KINDS[k], int(head[a]), int(head[b])) for a, k, b in found]
    return [(KINDS[k], a, b) for a, k, b in found]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs, in one pass without a shuffle.

    Null text: as empty, no spans. Repeated rows and null ids: a row each. Empty table: no rows. Other columns of docs
    are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "text"):
            out = [scan(t or "") for t in texts_of(batch, "text")]
            base = [[s for s in x if s[0] in BASE] for x in out]
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(spans_text(x).encode()).hexdigest() for x in base], pa.string())
            spans = pa.array([spans_text(x) for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, digest, spans], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = rows.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with each span of a secret replaced by [kind], and n_chars set anew where the text changed.

    Overlapping spans become one mark, of the kind that starts first. Null text stays null, empty text empty. Null ids
    and repeated rows: each row is judged by its text. Empty table: no rows. Columns of any name, their order and the
    number of rows stay; chars_col may be missing.
    """
    schema = docs.schema
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches):
        for batch in pieces(batches, text_col):
            old = texts_of(batch, text_col)
            new = [_redacted(t) if t else t for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if chars >= 0:
                counts = batch.column(chars).to_pylist()
                columns[chars] = pa.array([c if a == b else len(b) for a, b, c in zip(old, new, counts, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def _redacted(text: str) -> str:
    out, end = [], 0
    for kind, a, b in scan(text):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join(out) + text[end:] if out else text
