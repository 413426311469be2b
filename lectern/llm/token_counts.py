"""Token counts of whole texts for tokenizers that split text into pre-tokens and then merge inside each."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import pieces, texts_of
from ._io import table

#: Pre-tokens that are counted from a broadcast table, and their longest length in bytes: 2**17 * 64 bytes at most.
HEAD_ENTRIES, HEAD_BYTES = 1 << 17, 64
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 200_000
#: Below this code point the library's character classes and those of the regex module agree, and so does lower case,
#: but for the capital sigma, whose form depends on its place in Python alone, and two letters that go beyond it.
_PLAIN = re.compile("[\x00-\u0239\u023b-\u023d\u023f-\u03a2\u03a4-\u052f]*")
_LIMIT = 0x530

_splitters: dict[int, "PreTokens"] = {}


class PreTokens:
    """Splits a text as the tokenizer does before its merges, and counts the pieces of a pre-token."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(spec)
        d = json.loads(spec)
        steps = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [s["type"] for s in steps]
        if kinds != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            raise ValueError("the tokenizer must split by one pattern and then map bytes")
        pattern = steps[0]["pattern"]["Regex"]
        classes = {c: _ranges(regex.compile(c)) for c in (r"\p{L}", r"\p{N}", r"\s")}
        self.find = re.compile(re.sub(r"\\p\{L\}|\\p\{N\}|\\s", lambda m: classes[m[0]], pattern)).findall  # for plain texts
        added = sorted((a["content"] for a in d["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        normal = [n["type"] for n in (d["normalizer"] or {}).get("normalizers", [])]
        self.ascii_lower = normal == ["NFC", "Replace", "Lowercase"]
        self.inner = Tokenizer(self.tok.model)
        self.inner.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many added tokens it holds."""
        if self.added is None or not self.added.search(text):
            return self._split(text), 0
        parts, out = self.added.split(text), []
        for part in parts:
            out += self._split(part)
        return out, len(parts) - 1

    def _split(self, text: str) -> list[str]:
        if self.ascii_lower and (text.isascii() or _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text)):
            return self.find(text.lower())
        text = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        if _PLAIN.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def sizes(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.inner.encode_batch_fast(words, add_special_tokens=False)]


def _pre(spec) -> PreTokens:
    """One splitter for each worker process and tokenizer."""
    if spec.id not in _splitters:
        _splitters[spec.id] = PreTokens(spec.value)
    return _splitters[spec.id]


def _ranges(one) -> str:
    """The plain characters of a class, as ranges for a character set of the re module."""
    out, chars = [], [c for c in range(_LIMIT) if one.fullmatch(chr(c))]
    for c in chars:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


class _Spec:
    """A tokenizer's JSON, shipped once to each executor."""

    def __init__(self, spark, text: str):
        self.shared, self.id = spark.sparkContext.broadcast(text), hash(text)

    @property
    def value(self) -> str:
        return self.shared.value

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """Rows of docs with n_bytes, n_tokens and over_limit (n_tokens > limit); nothing is truncated or padded.

    tokenizer: path of a tokenizers JSON file on the driver. Each distinct pre-token is run through the merges once.
    The commonest 2**17 of them are then counted from a broadcast table of bounded size; the others are joined to the
    documents' pre-token frequencies by a shuffle. Strings of added tokens inside a text count as one token each, as
    the library does by default.

    Null text: as empty, 0 bytes and 0 tokens. Null or repeated ids and repeated rows: a row each. Empty table: no
    rows. Other columns of docs, whatever their names, are left out.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = _Spec(spark, f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def frequencies(batches):
        pre, held = _pre(spec), Counter()
        for batch in pieces(batches, "text"):
            for text in texts_of(batch, "text"):
                if text:
                    held.update(pre.split(text)[0])
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pydict({"pre": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"pre": list(held), "n": list(held.values())})

    def counted(batches):
        pre = _pre(spec)
        for batch in pieces(batches, "pre"):
            yield batch.append_column("size", pa.array(pre.sizes(texts_of(batch, "pre")), pa.int32()))

    distinct = rows.select("text").mapInArrow(frequencies, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    sizes = table(distinct.mapInArrow(counted, "pre string, n long, size int"), "pre-tokens")
    common = sizes.filter(F.octet_length("pre") <= HEAD_BYTES).orderBy(F.desc("n"), "pre").limit(HEAD_ENTRIES)
    top = common.select("pre", "size").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(top["pre"].to_pylist(), top["size"].to_pylist(), strict=True)))

    def first(batches):
        pre, known, at = _pre(spec), head.value, TaskContext.get().partitionId() << 36
        for batch in pieces(batches, "text"):
            n_bytes, n_head, rest, counts = [], [], [], []
            for text in texts_of(batch, "text"):
                words, total = pre.split(text) if text else ([], 0)
                other = Counter()
                for word, n in Counter(words).items():
                    size = known.get(word)
                    if size is None:
                        other[word] = n
                    else:
                        total += size * n
                n_bytes.append(len(text.encode()) if text else 0)
                n_head.append(total)
                rest.append(list(other))
                counts.append(list(other.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(at, at + len(n_bytes)), pa.int64()),
                    batch.column("id"),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_head, pa.int64()),
                    pa.array(rest, pa.list_(pa.string())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["row", "id", "n_bytes", "n_head", "pre", "n"],
            )
            at += len(n_bytes)

    kind = rows.schema["id"].dataType.simpleString()
    base = table(
        rows.mapInArrow(first, f"row long, id {kind}, n_bytes long, n_head long, pre array<string>, n array<long>"), "token-base"
    )
    rest = base.select("row", F.explode(F.arrays_zip("pre", "n")).alias("e")).select("row", "e.pre", "e.n")
    rest = rest.join(sizes.select("pre", "size"), "pre").groupBy("row").agg(F.sum(F.col("n") * F.col("size")).alias("n_rest"))
    total = F.col("n_head") + F.coalesce("n_rest", F.lit(0))
    return base.drop("pre", "n").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")
    )
