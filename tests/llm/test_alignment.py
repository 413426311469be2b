import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "  a  b \n\n c\t", "It's <|endoftext|>fine<s>x</s> <0x41>", "a▁b", "日本語 ①² x‍y ՘ \U0001f600\U0001f600", "é é ß", "\x00\x1c\x85 z\r\n", "a" * 4000, "x y " * 2000,
    "12 345,67 -- don't we'll!!!", " lead", "trail  ", "ÿɐḀ",
]


def printed():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}


def brute(texts):
    """Per text: ids, groups and links, by two pointers over the libraries' tokens of the whole text."""
    tok, sp, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), printed()
    tok.encode_special_tokens = True
    out = []
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ta = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
        tb = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not text or b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
            out.append(([], [], [], []))
            continue
        i = j = x = y = 0
        links, groups = [], [([], [])]
        ends_a, ends_b = [x := x + len(t) for t in ta], [y := y + len(t) for t in tb]
        groups[-1][0].append(a[0]), groups[-1][1].append(b[0])
        while i < len(a):
            links.append((a[i], b[j]))
            both = ends_a[i] == ends_b[j]
            step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
            i, j = i + step_a, j + step_b
            if both and i < len(a):
                groups.append(([], []))
            if step_a and i < len(a):
                groups[-1][0].append(a[i])
            if step_b and j < len(b):
                groups[-1][1].append(b[j])
        out.append((a, b, groups, links))
    return out


def wanted(rows):
    found = brute([t for _, t in rows])
    count = Counter(link for f in found for link in f[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), sha))
    return out, count, most


@pytest.mark.parametrize("head", [alignment.HEAD, 300, 0])
def test_equals_two_pointers(spark, sf, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(120).collect()] + ODD + ODD
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, row int, Pair string").repartition(3)
    assert sorted(tuple(r) for r in alignment.align(df, A, B).collect()) == wanted(rows)[0]


def test_pairs_and_groups(spark):
    rows = [(1, "one two  three\n"), (1, "one two"), (None, "one"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, count, most = wanted(rows)
    got = {(r.a, r.b): (r.n, r.best_b) for r in alignment.pair_counts(df, A, B).collect()}
    assert got == {k: (n, n == most[k[1]]) for k, n in count.items()}
    for r in alignment.align(df, A, B, with_groups=True).collect():
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
    assert alignment.align(df.limit(0), A, B).collect() == []


def test_a_text_of_over_one_piece(spark):
    rows = [(1, "Some words, and their 123 ends.\n" * 50_000), (2, "x" * 70_000)]
    got = sorted(tuple(r) for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect())
    assert got == wanted(rows)[0]
