"""Alignment of two tokenizers' tokens over whole texts, and corpus-wide counts of the token pairs that it links."""

from __future__ import annotations

import hashlib
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import pieces, texts_of
from ._io import release, table
from .token_counts import _PLAIN, _ranges

#: Pairs whose counts are a broadcast table, the commonest ones: 17 bytes each, 18 MB at most.
HEAD = 1 << 20
#: Distinct words of a side that a worker keeps tokens of, and their characters; beyond it starts anew.
HELD, HELD_CHARS = 100_000, 8 << 20
#: Words that are encoded at once, and bytes of text that are aligned at once: the libraries' results are large.
CHUNK, PIECE = 2048, 1 << 18
#: Distinct pairs that a task holds before it passes their counts on.
PAIRS = 1 << 21

_sides: dict[int, tuple["Words", "Words"]] = {}


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Words:
    """Tokens of the words of a text, encoded once for each distinct word; a word is a part that no token leaves."""

    def __init__(self, n_ids: int, token_bytes: list[bytes], find, encode):
        self.n_ids, self.token_bytes, self.find, self.encode = n_ids, token_bytes, find, encode
        self.sizes = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers()
        self.chars = 0
        self.ids, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.n_bytes, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of all texts, and of the text that holds it."""
        if len(self.known) > HELD or self.chars > HELD_CHARS:
            self.clear()
        found = [self.find(t) for t in texts]
        words = list(chain.from_iterable(found))
        before = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > before:
            self._learn(list(islice(reversed(self.known), len(self.known) - before))[::-1])
        return number, np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))

    def _learn(self, new: list[str]) -> None:
        text = "".join(new)
        self.chars += len(text)
        got = [ids for i in range(0, len(new), CHUNK) for ids in self.encode(new[i : i + CHUNK])]
        ids = np.fromiter(chain.from_iterable(got), np.int64)
        count = np.fromiter(map(len, got), np.int64, len(got))
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.cumsum(count)]
        size = np.diff(ends, prepend=0)
        good = np.ones(len(new), bool)
        wanted = np.fromiter((len(w.encode()) for w in new), np.int64, len(new))
        if (size != wanted).any() or not self.sizes[ids].all() or b"".join(map(self.token_bytes.__getitem__, ids.tolist())) != text.encode():
            parts = [[self.token_bytes[i] for i in x] for x in got]
            good = np.array([all(p) and b"".join(p) == w.encode() for p, w in zip(parts, new)], bool)
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        self.first = np.cumsum(self.count) - self.count
        self.good, self.n_bytes = np.concatenate([self.good, good]), np.concatenate([self.n_bytes, size])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ...: count[i] numbers for each i."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)


def _byte_level(spec: str) -> Words:
    """A byte-level BPE of the tokenizers library."""
    import regex
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_str(spec)
    tok.encode_special_tokens = True
    inner = Tokenizer(tok.model)
    inner.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    l, n, s = (_ranges(regex.compile(c)) for c in (r"\p{L}", r"\p{N}", r"\s"))
    # The pattern that the library's byte-level step splits by, for plain characters.
    find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+").findall
    if tok.normalizer is not None or not str(tok.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") or "use_regex=True" not in str(tok.pre_tokenizer):
        raise ValueError("the tokenizer must split as the byte-level step does, and change no text before that")

    def split(text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return find(text)
        return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]
    added = {t for t in tok.get_added_tokens_decoder()}
    values = [t.encode() if i in added else bytes(byte[c] for c in t) for i, t in enumerate(names)]
    return Words(len(values), values, split, lambda words: [e.ids for e in inner.encode_batch_fast(words, add_special_tokens=False)])


def _pieces(model: bytes) -> Words:
    """A sentencepiece model that writes a space before a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    values = [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in names]
    before = sp.encode("\n")
    if len(before) == 2 and not any(re.search("[^▁]▁|\n", t) for t in names):
        # No piece goes on after a line break or into a space: what lies between is encoded alone, after a line break.
        return Words(len(values), values, re.compile(r" *[^ \n]+| +|\n").findall, lambda words: [ids[2:] for ids in sp.encode(["\n" + w for w in words], num_threads=1)])
    return Words(len(values), values, lambda text: [text], lambda words: sp.encode([w[1:] for w in words], num_threads=1))


def _both(shared) -> tuple[Words, Words]:
    """Both sides, made once in each worker process."""
    if shared.id not in _sides:
        a, b = shared.value
        _sides[shared.id] = _byte_level(a), _pieces(b)
    return _sides[shared.id]


class _Shared:
    """Both tokenizers' files, sent once to each executor."""

    def __init__(self, spark, a: str, b: bytes):
        self.files, self.id = spark.sparkContext.broadcast((a, b)), hash((a, b))

    @property
    def value(self) -> tuple[str, bytes]:
        return self.files.value

    def __getstate__(self):
        return {"files": self.files, "id": self.id}


class Aligned:
    """Groups and links of a batch of texts. Arrays of the two sides hold the tokens of all texts, one after another.

    Both sides of a text cover the same bytes, so all texts of a batch are one sequence, and one merge of the two sorted
    sequences of token ends gives groups (cut where both have an end) and links (overlaps).
    """

    def __init__(self, texts: list[str | None], a: Words, b: Words):
        self.n, self.a, self.b = len(texts), a, b
        spaced = [" " + t if t else "" for t in texts]
        sides = [(w, *w.numbers(spaced)) for w in (a, b)]
        size = np.fromiter((len(t.encode()) for t in spaced), np.int64, self.n)
        fits = size > 0
        for words, number, text in sides:
            fits &= np.bincount(text, words.n_bytes[number], self.n).astype(np.int64) == size
            fits[text[~words.good[number]]] = False
        ids, ends, of = [], [], []
        for words, number, text in sides:
            number, text = number[fits[text]], text[fits[text]]
            count = words.count[number]
            ids.append(words.ids[_spread(words.first[number], count)])
            of.append(np.repeat(text, count))
            ends.append(np.cumsum(words.sizes[ids[-1]]))
        (self.ids_a, self.ids_b), (self.of_a, self.of_b), (end_a, end_b) = ids, of, ends
        begin = end_a - a.sizes[self.ids_a]
        first = np.searchsorted(end_b, begin, "right")  # the tokens of b that overlap a token of a
        last = np.searchsorted(end_b, end_a)
        self.link_a = np.repeat(np.arange(len(end_a)), last - first + 1)
        self.link_b = _spread(first, last - first + 1)
        self.cut_a = end_b[last] == end_a if len(end_a) else np.zeros(0, bool)
        self.cut_b = np.zeros(len(end_b), bool)
        self.cut_b[last[self.cut_a]] = True

    def per_text(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=self.n)

    def group_texts(self) -> list[bytes]:
        """The groups of each text as a1,a2|b1;a3|b2,b3 with decimal ids."""
        group_a, group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        upto_a, upto_b = np.flatnonzero(self.cut_a) + 1, np.concatenate([[0], np.flatnonzero(self.cut_b) + 1])
        code = np.zeros(len(group_a) + len(group_b), np.int64)
        code[np.arange(len(group_a)) + upto_b[group_a]] = 2 * self.ids_a + self.cut_a
        code[np.arange(len(group_b)) + upto_a[group_b]] = 2 * (self.a.n_ids + self.ids_b) + self.cut_b
        parts = list(map(_decimals(self.a.n_ids, self.b.n_ids).__getitem__, code.tolist()))
        cuts = np.cumsum(self.per_text(self.of_a) + self.per_text(self.of_b)).tolist()
        return [b"".join(parts[i:j])[:-1] for i, j in zip([0, *cuts], cuts)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links): each pair of ids of each text once, in order; a pair is a * (number of b's ids) + b."""
        bits = np.uint64((self.a.n_ids * self.b.n_ids).bit_length())
        pair = (self.ids_a[self.link_a] * self.b.n_ids + self.ids_b[self.link_b]).astype(np.uint64)
        both = np.sort((self.of_a[self.link_a].astype(np.uint64) << bits) | pair)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        links = np.diff(np.concatenate([first, [len(both)]]))
        both = both[first]
        return (both >> bits).astype(np.int64), (both & np.uint64((1 << int(bits)) - 1)).astype(np.int64), links


_texts: dict[tuple[int, int], list[bytes]] = {}


def _decimals(a: int, b: int) -> list[bytes]:
    if (a, b) not in _texts:
        _texts[a, b] = [b"%d%s" % (i, end) for n, last in ((a, b"|"), (b, b";")) for i in range(n) for end in (b",", last)]
    return _texts[a, b]


BLOCK = "row long, ids array<{}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, groups array<string>, pairs binary, sums binary, own binary, at binary, links binary, wide boolean"


def _blocks(docs: DataFrame, spark, a: str, b: str, id_col: str, text_col: str, with_groups: bool) -> tuple[DataFrame, int]:
    """A row for each piece of text, with the pairs of its texts; and the number of b's ids."""
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        shared = _Shared(spark, f.read(), g.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def block(batches):
        sides, at = _both(shared), TaskContext.get().partitionId() << 36
        for batch in pieces(batches, "text", PIECE):
            found = Aligned(texts_of(batch, "text"), *sides)
            n = found.n
            texts = found.group_texts()
            text, pair, links = found.pairs()
            distinct, place = np.unique(pair, return_inverse=True)
            wide = len(distinct) > 1 << 16 or bool(len(links)) and int(links.max()) >= 1 << 16
            kind = np.uint32 if wide else np.uint16
            counts = found.per_text(found.of_a), found.per_text(found.of_b), found.per_text(found.of_a[found.cut_a]), found.per_text(found.of_a[found.link_a])
            lists = [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts)]
            lists += [pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string()), pa.array([t.decode() if with_groups else None for t in texts], pa.string())]
            sums = np.bincount(place, links, len(distinct)).astype(np.int64)
            packed = [distinct.tobytes(), sums.tobytes(), np.bincount(text, minlength=n).astype(np.uint32).tobytes(), place.astype(kind).tobytes(), links.astype(kind).tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in lists), *(pa.array([x], pa.binary()) for x in packed), pa.array([wide])],
                [c.split()[0] for c in BLOCK.split(", ")],
            )
            at += n

    return table(rows.mapInArrow(block, BLOCK.format(rows.schema["id"].dataType.simpleString())), "alignments"), _pieces(shared.value[1]).n_ids


def _counts(blocks: DataFrame) -> DataFrame:
    """(pair, n): the links of each pair over all blocks; a task adds up what it has read before it is exchanged."""

    def added(batches):
        pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            pair = np.concatenate([pairs, *(p for p, _ in held)])
            distinct, at = np.unique(pair, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at, np.concatenate([sums, *(s for _, s in held)]))
            held.clear()
            return distinct, total

        def out():
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "n"])

        for batch in batches:
            for p, s in zip(batch.column("pairs").to_pylist(), batch.column("sums").to_pylist()):
                held.append((np.frombuffer(p, np.int64), np.frombuffer(s, np.int64)))
                if sum(len(x) for x, _ in held) > PAIRS // 2:
                    pairs, sums = merged()
                if len(pairs) > PAIRS:
                    yield out()
                    pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, sums = merged()
        if len(pairs):
            yield out()

    return blocks.select("pairs", "sums").mapInArrow(added, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _with_best(counts: DataFrame, n_b: int) -> DataFrame:
    """counts with the most links that each side's id has with one id of the other; both vocabularies bound the broadcast."""
    sided = counts.withColumn("a", F.expr(f"pair div {n_b}")).withColumn("b", F.col("pair") % n_b)
    for side in "ab":
        sided = sided.join(F.broadcast(counts.groupBy((F.expr(f"pair div {n_b}") if side == "a" else F.col("pair") % n_b).alias(side)).agg(F.max("n").alias(f"most_{side}"))), side)
    return sided


def pair_counts(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n, best_a, best_b): ids that links hold together, how often, and whether no other id of b's (a's) side is
    linked more often with a (b). Rows, nulls and texts as in align().
    """
    blocks, n_b = _blocks(docs, docs.sparkSession, a, b, id_col, text_col, False)
    counts = _with_best(table(_counts(blocks), "pair-counts"), n_b)
    return counts.select("a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and groups if with_groups.

    a is a tokenizers JSON file of a byte-level BPE that encodes a space and the text, b a sentencepiece model that writes
    the space itself; both are paths on the driver, and no special token is added or read. Each distinct word is encoded
    once in a worker. The ends of both sides' tokens are merged inside mapInArrow, which gives groups and links; pairs of
    ids are counted by Spark, each id's maximum is joined to them, and both come back to the documents: for the 2**20
    commonest pairs by a broadcast table of 18 MB, for all others by a join on the pair.

    n_best counts the links whose pair is as common as the commonest one of its b id, count_sum adds the pairs' counts.
    Null or empty texts, and texts that one of the sides does not give back byte by byte, have no tokens: zeros, and an
    empty string for the hash. Null or repeated ids and repeated rows: a row each. Empty table: no rows. Other columns of
    docs, whatever their names, are left out.
    """
    spark = docs.sparkSession
    blocks, n_b = _blocks(docs, spark, a, b, id_col, text_col, with_groups)
    counts = table(_counts(blocks), "pair-counts")
    level = F.floor(F.log2("n") * 4)
    least, held = None, 0
    for k, pairs in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("k")).agg(F.count("*")).collect()), reverse=True):
        held += pairs
        if held > HEAD:
            break
        least = k
    best = _with_best(counts, n_b).select("pair", "n", (F.col("n") == F.col("most_b")).alias("best"))
    top = best.filter(level >= (1 << 30 if least is None else least)).toArrow().combine_chunks()
    order = np.argsort(top["pair"].to_numpy())
    head = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "n", "best")))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def valued(batches):
        known, n, is_best = head.value
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _valued(batch.slice(i, 1), known, n, is_best)

    shape = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, best long, total long, pair array<long>, links array<long>"
    base = table(blocks.drop("sums").mapInArrow(valued, shape), "alignment-base")
    release(blocks)
    rest = base.filter(F.size("pair") > 0).select("row", F.explode(F.arrays_zip("pair", "links")).alias("e")).select("row", "e.pair", "e.links")
    rest = rest.join(best, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rest_best"), F.sum(F.col("links") * F.col("n")).alias("rest_total"))
    out = base.drop("pair", "links").join(rest, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("rest_total", F.lit(0))).alias("count_sum"), "groups_sha256", *(["groups"] if with_groups else []),
    )


def _valued(block: pa.RecordBatch, known: np.ndarray, n: np.ndarray, is_best: np.ndarray):
    """A block's rows, with the sums over pairs that are known and lists of the others."""
    get = lambda c, kind: np.frombuffer(block.column(c)[0].as_py(), kind)
    kind = np.uint32 if block.column("wide")[0].as_py() else np.uint16
    pairs, own, at, links = get("pairs", np.int64), get("own", np.uint32).astype(np.int64), get("at", kind), get("links", kind).astype(np.int64)
    place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
    there = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
    many, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    many[there], best[there] = n[place[there]], is_best[place[there]]
    cuts = np.concatenate([[0], np.cumsum(own)])
    sums = [np.concatenate([[0], np.cumsum(links * x[at])])[cuts] for x in (best, many)]
    other = np.flatnonzero(~there[at])
    offsets = pa.array(np.searchsorted(other, cuts), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[other])) for x in (pairs[at], links)]
    columns = [block.column(c).flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "sha", "groups")]
    begin = block.column("row")[0].as_py()
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "best", "total", "pair", "links"]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + len(own))), *columns, *(pa.array(np.diff(s)) for s in sums), *lists], names)
