"""Interfaces of the model-backed steps, stubs with fixed outputs, and the plan of an answer.

No model comes with this package, so nothing is said about the quality of recognition or of generated text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..functions import words as W
from ..operators import index
from ..sources import sinks
from ..sources.store import Store


class Reader(Protocol):
    """Recognises a page image: (text, x0, y0, x1, y1, score) for each box."""

    def __call__(self, image: bytes, language: str) -> list[tuple[str, float, float, float, float, float]]: ...


class Chat(Protocol):
    """Answers messages: (text, tokens used)."""

    def __call__(self, messages: list[dict], max_tokens: int) -> tuple[str, int]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def stub_reader(image: bytes, language: str = "") -> list[tuple[str, float, float, float, float, float]]:
    """The bytes as lines of text, one box each."""
    lines = [x for x in image.decode("utf-8", "ignore").splitlines() if x.strip()]
    return [(x.strip(), 0.0, i / len(lines), 1.0, (i + 1) / len(lines), 1.0) for i, x in enumerate(lines)]


def stub_chat(messages: list[dict], max_tokens: int) -> tuple[str, int]:
    """The first line of the evidence."""
    body = messages[-1]["content"]
    line = next((x for x in body.splitlines() if x.startswith("[1] ")), "")
    return line[4:] or "Not found in the documents.", len(body) // 4


def stub_embedder(texts: Iterable[str], size: int = 32) -> list[list[float]]:
    """Normalised counts of hashed tokens."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in T.tokens_of(t):
            v[zlib.crc32(w.encode()) % size] += 1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def stub_decoder(content: bytes) -> list[list[str]]:
    """The bytes as lines of text, a page for each 20 of them."""
    lines = content.decode("utf-8", "ignore").split("\n")
    return [lines[i : i + 20] for i in range(0, len(lines), 20)]


def stub_fields(messages: list[dict], max_tokens: int) -> tuple[str, int]:
    """The fields that the prompt asks for, as JSON, from the evidence's lines `field: value`."""
    evidence, _, asked = messages[-1]["content"].rpartition("\n\nFields: ")
    lines = [x.partition(": ") for x in evidence.splitlines()]
    found = {name: next((v for k, _, v in lines if k.strip() == name), None) for name in asked.split(", ")}
    return json.dumps(found), len(evidence) // 4


def stub_second(crop: pd.Series) -> pd.Series:
    """A crop's text in capitals."""
    return crop.str.upper()


def chat_rows(prompts: DataFrame, texts: str, tokens_left: str, chat: Chat = stub_chat, max_tokens: int = 256) -> DataFrame:
    """prompts with estimate, refused, reply, used and left_after: a call of the model for each row, within the tokens it has left.

    A prompt whose estimate and 32 tokens more do not fit is refused before the model is called; real use is charged.
    """

    @F.pandas_udf("struct<reply:string,used:long>")
    def replies(messages: pd.Series, most: pd.Series) -> pd.DataFrame:
        got = [(None, 0) if m is None or len(m) == 0 else chat([{"role": "user", "content": c} for c in m], int(n)) for m, n in zip(messages, most)]
        return pd.DataFrame([(r and r.strip(), u) for r, u in got], columns=["reply", "used"])

    left = F.col(tokens_left)
    rows = prompts.withColumn("estimate", T.estimate_tokens(F.col(texts), 0))
    rows = rows.withColumn("refused", F.col("estimate") + 32 > F.floor(left))
    most = F.greatest(F.lit(16), F.least(F.lit(max_tokens), F.floor(left).cast("int") - F.col("estimate").cast("int")))
    rows = rows.withColumn("_r", replies(F.when(~F.col("refused"), F.col(texts)), most))
    return rows.withColumn("reply", F.col("_r.reply")).withColumn("used", F.col("_r.used")).withColumn("left_after", F.greatest(left - F.col("used"), F.lit(0.0))).drop("_r")


def second_readings(boxes: DataFrame, reader: Callable[[pd.Series], pd.Series], below: float = W.OCR_FLAG_BELOW) -> DataFrame:
    """boxes (text, score, crop) with alt: what a second reader makes of crops that the first one was unsure of, if it differs.

    Only those crops leave the JVM.
    """
    again = F.pandas_udf(reader, "string")
    unsure = F.col("score") < below
    other = F.btrim(again(F.when(unsure, F.col("crop"))))
    return boxes.withColumn("alt", F.when(unsure & (other != "") & (other != F.btrim("text")), other))


def read_pages(images: DataFrame, reader: Reader = stub_reader, language: str = "") -> DataFrame:
    """(doc_id, page, text, x0, y0, x1, y1, score) of page images (doc_id string, page int, content); read by the executors."""

    def run(batches):
        for pdf in batches:
            rows = [(d, p, *box) for d, p, c in zip(pdf["doc_id"], pdf["page"], pdf["content"]) for box in reader(c, language)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "x0", "y0", "x1", "y1", "score"])

    return images.select("doc_id", "page", "content").mapInPandas(run, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, score double")


def embed(chunks: DataFrame, text: str, embedder: Embedder = stub_embedder) -> DataFrame:
    """chunks with embedding, by batches on the executors."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def vectors(s: pd.Series) -> pd.Series:
        return pd.Series(embedder([x or "" for x in s]))

    return chunks.withColumn("embedding", vectors(F.col(text)))


# Chunks and characters of a prompt for fields, and the share of a value's words that its evidence must hold.
FIELD_CHUNKS, FIELD_CHARS, FIELD_SUPPORT = 6, 2400, 0.8


def extract_rows(units: index.Index | DataFrame, names: list[str], chat: Chat, by: str = "doc_id", per_field: int = 3) -> DataFrame:
    """(by, field, value, verified): named fields of each document, by one model call a document on its best units for them.

    Units of the same page and beginning count once. A value counts as verified if most of its words are in one of the
    units. Replies that aren't JSON, and fields that they leave out, give no value. Documents that no field's words touch
    give no row.
    """
    ix = index.Index.of(units)
    spark = ix.units.sparkSession
    asked = spark.createDataFrame(list(enumerate(names)), "query_id int, q string")
    keys = list(ix.keys)
    hits = index.search_many(ix, asked, keys, per_field, within=(by,)).join(ix.units.select(*keys, "text"), keys)
    place = [k for k in keys if k not in (by, "chunk")]
    firsts = hits.groupBy(by, *place, F.substring("text", 1, 40).alias("_begin")).agg(F.min(F.struct("query_id", "rank", "text")).alias("u"))
    gathered = firsts.groupBy(by).agg(F.transform(F.slice(F.array_sort(F.collect_list("u")), 1, FIELD_CHUNKS), lambda u: u["text"]).alias("_units"))
    evidence = F.substring(F.array_join("_units", "\n"), 1, FIELD_CHARS)

    @F.pandas_udf("string")
    def reply(text: pd.Series) -> pd.Series:
        system = {"role": "system", "content": "Return the fields as JSON; null where absent."}
        return text.map(lambda t: chat([system, {"role": "user", "content": f"Evidence:\n{t}\n\nFields: {', '.join(names)}"}], 300)[0])

    read = gathered.withColumn("_v", F.from_json(reply(evidence), "map<string,string>"))
    each = read.select(by, "_units", "_v", F.explode(F.array(*(F.lit(n) for n in names))).alias("field"))
    each = each.withColumn("value", F.try_element_at("_v", F.col("field")))
    held = F.exists("_units", lambda u: T.support(F.col("value"), u, F.lit("")) >= FIELD_SUPPORT)
    return each.select(by, "field", "value", F.coalesce((F.col("value") != "") & held, F.lit(False)).alias("verified"))


#: What is said where nothing is found.
NOTHING = "Not found in the documents."


def answers(pages: index.Index | DataFrame, questions: DataFrame, readers: list[Callable[[Column, Column], Column]], chat: Chat = stub_chat, most: int = 4) -> DataFrame:
    """(query_id, answer, support, verified, strategy, place, tokens_left): the plan of an answer, for a table of questions.

    questions: (query_id, q, tokens_left, calls_left). A question takes one call of the search, and is refused without one
    (budget). Where its words are nowhere nothing is said (abstain). Rule readers, which give struct(value, row) for a
    question and a text, are asked on its best page (rows). Otherwise the model is asked page by page, best first, until an
    answer is supported (text); a prompt that doesn't fit the tokens left ends that, and the best answer so far stands. Each
    page is one step for all questions, and is written, so no call of the model is made twice; place is the rank of the page
    that the answer is from.
    """
    from ..operators.ledger import can
    from ..operators.verify import verify

    ix = index.Index.of(pages)
    keys = list(ix.keys)
    store = Store(ix.units.sparkSession, sinks.new_folder(ix.units.sparkSession, "answers"))
    held = lambda df: store.spark.read.schema(df.schema).parquet(f"{store.folder}/{store.put(df)['path']}")
    asked = held(questions.select("query_id", "q", F.col("tokens_left").cast("double").alias("tokens_left"), F.col("calls_left").cast("double").alias("calls_left")))
    queries = asked.select("query_id", "q")
    # What several steps read is written, so that it is made once, and each step is a small plan.
    scores = held(index.scores_many(ix, queries, keys))
    best = held(index.best_of_many(ix, queries, keys, most, scores=scores)).join(ix.units.select(*keys, "text"), keys)
    found = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "coverage"))).alias("found"))
    abstain = held(index.abstain_many(ix, queries, scores=scores).select("query_id", "abstain"))
    rows = asked.join(abstain, "query_id").join(found, "query_id", "left")
    first = F.replace(F.get("found", F.lit(0))["text"], F.lit("\n\n"), F.lit("\n"))
    read = F.coalesce(F.lit(None).cast("string"), *(reader(F.col("q"), first)["value"] for reader in readers))
    able = can(F.col("calls_left"), F.lit(1.0))
    strategy = F.when(~able, "budget").when(F.col("abstain"), "abstain").when(F.col("read").isNotNull(), "rows").otherwise("text")
    rows = held(rows.withColumn("read", read)).withColumn("strategy", strategy).withColumn("open", strategy == "text")
    rows = rows.select("query_id", F.col("q").alias("question"), "found", "strategy", "open", "tokens_left", F.when(F.col("strategy") == "rows", F.col("read")).otherwise(NOTHING).alias("said"), (F.col("strategy") == "rows").cast("double").alias("sure"), F.when(F.col("strategy") == "rows", 1).alias("place"))
    kept = ["query_id", "question", "found", "strategy"]
    for i in range(most):
        page = F.get("found", F.lit(i))
        evidence = F.replace(F.substring(page["text"], 1, W.SHORT_PAGE), F.lit("\n\n"), F.lit("\n"))
        step = rows.withColumn("page_text", page["text"]).withColumn("coverage", page["coverage"]).withColumn("evidence", evidence)
        prompt = F.array(F.concat(F.lit("Evidence:\n[1] "), F.col("evidence"), F.lit("\n\nQuestion: "), F.col("question")))
        step = step.withColumn("texts", F.when(F.col("open") & F.col("page_text").isNotNull(), prompt))
        step = verify(chat_rows(step, "texts", "tokens_left", chat, 96).withColumn("answer", F.col("reply")))
        better = F.coalesce(F.col("reply").isNotNull() & (F.col("support") > F.col("sure")), F.lit(False))
        ends = F.coalesce(F.col("refused"), F.lit(False)) | (better & F.col("verified"))
        rows = held(step).select(
            *kept, (F.col("open") & ~ends).alias("open"), F.coalesce("left_after", "tokens_left").alias("tokens_left"), F.when(better, F.col("final_answer")).otherwise(F.col("said")).alias("said"),
            F.when(better, F.col("support")).otherwise(F.col("sure")).alias("sure"), F.when(better, F.lit(i + 1)).otherwise(F.col("place")).alias("place"),
        )
    return rows.select("query_id", F.col("said").alias("answer"), F.col("sure").alias("support"), (F.col("sure") >= W.SUPPORT_OK).alias("verified"), "strategy", "place", "tokens_left")
