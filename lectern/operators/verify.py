"""Checking answers against their evidence, by Column expressions over (question, answer, evidence, page) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W


def grounded(question: Column, page_text: Column, coverage: Column) -> Column:
    """Whether a page may ground an answer: open questions, cited item numbers, another script, or enough coverage with the named phrases."""
    refs, toks = T.item_refs(question), T.tokens(page_text)
    cited = (F.size(refs) > 0) & F.forall(refs, lambda r: F.array_contains(toks, r))
    held = (coverage >= W.COVER_OK) & T.has_entities(T.entities(question), page_text)
    return question.rlike("(?i)" + W.META_Q) | cited | T.script_mismatch(question, page_text) | held


def figures(text: Column) -> Column:
    """Figures of a text, without trailing commas and points."""
    plain = F.translate(text, W.BN_DIGITS, W.ASCII_DIGITS)
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\d[\d,.]*%?"), F.lit(0)), lambda n: F.rtrim(n, F.lit(",.")))


def invented(question: Column, answer: Column, page_text: Column) -> Column:
    """Whether an answer states a percentage, or a figure of two digits or more, that neither page nor question has."""
    stated = F.filter(figures(answer), lambda n: n.endswith("%") | (F.length(T.only_digits(n)) >= 2))
    return F.size(F.array_except(stated, F.concat(figures(page_text), figures(question)))) > 0


def verify(rows: DataFrame) -> DataFrame:
    """rows (question, answer, evidence, page_text, coverage) with final_answer, support and verified."""
    q, a, page = F.col("question"), F.col("answer"), F.col("page_text")
    refs, toks = T.item_refs(q), T.tokens(page)
    cited = (F.size(refs) > 0) & F.forall(refs, lambda r: F.array_contains(toks, r))
    cross = T.script_mismatch(q, page) & ~cited
    lost = a.rlike("(?i)" + W.NOT_FOUND)
    share = F.when(lost | ~grounded(q, page, F.col("coverage")), F.lit(0.0)).otherwise(T.support(a, "evidence", q))
    wrong = cross & invented(q, a, page)
    out = F.when(wrong, F.lit("Not found in the documents.")).otherwise(a)
    share = F.when(wrong, F.lit(0.0)).when(cross, F.least(share, F.lit(W.CROSS_CAP))).otherwise(share)
    share = F.when(q.rlike("(?i)" + W.NUMERIC_Q) & ~out.rlike("[0-9]"), F.lit(0.0)).otherwise(share)
    return rows.withColumn("final_answer", out).withColumn("support", share).withColumn("verified", F.col("support") >= W.SUPPORT_OK)


def refine(rows: DataFrame) -> DataFrame:
    """rows (kind, support, ocr, vision, prefer) with used, reading and support: two readings that agree, fill a gap or dispute."""
    same = T.same_value("ocr", "vision")
    no_ocr, no_vision = F.coalesce(F.col("ocr") == "", F.lit(True)), F.coalesce(F.col("vision") == "", F.lit(True))
    state = F.when(no_vision, "ocr only").when(no_ocr, "filled").when(same, "agree").otherwise("disputed")
    used = F.when(state == "filled", "vision").when(state == "disputed", F.col("prefer")).otherwise("ocr")
    better = F.when(state == "agree", F.greatest("support", F.lit(0.9))).when(state == "filled", F.greatest("support", F.lit(0.6))).otherwise(F.col("support"))
    return rows.withColumn("state", state).withColumn("used", used).withColumn("reading", F.when(used == "ocr", F.col("ocr")).otherwise(F.col("vision"))).withColumn("support", better)
