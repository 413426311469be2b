import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    "   \n\t",
    "It's <|endoftext|>fine<|startoftext|> <|EndOfText|>",
    "ΑΣ ΟΔΟΣ İstanbul é é ß 日本語 ①² x‍y ՘ \U0001f600\U0001f600",
    "a" * 5000,
    "12 345,67 -- don't we'll!!! \x00\x1f",
    "x y " * 3000,
]


def library(texts):
    tok = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def run(df, **kw):
    return [tuple(r) for r in token_counts.token_counts(df, PATH, **kw).collect()]


@pytest.mark.parametrize("head", [token_counts.HEAD_ENTRIES, 5])
def test_equals_library(spark, sf, monkeypatch, head):
    monkeypatch.setattr(token_counts, "HEAD_ENTRIES", head)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD + ODD
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    want = [(i, len((t or "").encode()), n, n > 2048) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))]
    assert sorted(run(df)) == want


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a"), (1, None)], "doc_id long, text string")
    assert sorted(run(df, limit=1), key=str) == [(1, 0, 0, False), (1, 1, 1, False), (1, 1, 1, False), (None, 3, 2, True)]
    assert run(df.limit(0)) == []


def test_split_equals_library_on_every_plain_character():
    with open(PATH, encoding="utf-8") as f:
        pre = token_counts.PreTokens(f.read())
    for cp in range(token_counts._LIMIT + 64):
        text = f"A{chr(cp)}b {chr(cp)}{chr(cp)}'S{chr(cp)}"
        normal = pre.tok.normalizer.normalize_str(text)
        assert pre.split(text)[0] == [normal[a:b] for _, (a, b) in pre.tok.pre_tokenizer.pre_tokenize_str(normal)], hex(cp)
