"""Follow-ups, the answer cache and the memory of confirmed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.readers import follow_up

#: Messages kept as chat context and documents' history, and memory items kept.
CONTEXT, CHAT_HISTORY, HISTORY, MEMORY = 8, 20, 100, 500


def resolve_turns(turns: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, order, text, resolved): each question in the light of the one before as it was resolved, not as it was asked.

    A fold over a conversation's ordered turns, in the JVM; conversations are short, and many. Null questions stay null,
    and what follows them stands alone; turns of equal order are folded by their text.
    """
    each = turns.select(by, F.struct(F.col(order).alias("order"), F.col(text).alias("text")).alias("turn"))
    listed = each.groupBy(by).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    kind = turns.schema[order].dataType.simpleString()
    start = F.struct(F.lit(None).cast("string").alias("before"), F.array().cast(f"array<struct<order:{kind},text:string,resolved:string>>").alias("out"))

    def step(state: Column, turn: Column) -> Column:
        resolved = follow_up(turn["text"], state["before"])
        done = F.struct(turn["order"].alias("order"), turn["text"].alias("text"), resolved.alias("resolved"))
        return F.struct(resolved.alias("before"), F.concat(state["out"], F.array(done)).alias("out"))

    folded = listed.select(by, F.explode(F.aggregate("turns", start, step, lambda s: s["out"])).alias("t"))
    return folded.select(by, F.col("t.order").alias(order), F.col("t.text").alias(text), F.col("t.resolved").alias("resolved"))


def context(turns: DataFrame, by: str, order: str, keep: int = CONTEXT) -> DataFrame:
    """The last messages of each conversation."""
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("_n") <= keep).drop("_n")


def cache_words(question: Column) -> Column:
    """The words of a question but for fillers: equal arrays are the same question."""
    low = F.replace(F.lower(question), F.lit("what's"), F.lit("what is"))
    filler = F.array(*(F.lit(w) for w in W.CACHE_FILLER))
    return F.filter(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: ~F.array_contains(filler, w))


def cache_lookup(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """questions (question, state) with the cached answer, if the same question was answered in the same state of the documents."""
    held = cache.select(cache_words(F.col("question")).alias("_w"), F.col("state").alias("_s"), F.col("answer").alias("cached"))
    held = held.groupBy("_w", "_s").agg(F.max("cached").alias("cached"))
    asked = questions.withColumn("_k", cache_words(F.col("question")))
    return asked.join(held, (F.col("_k") == F.col("_w")) & (F.col("state") == F.col("_s")), "left").drop("_k", "_w", "_s")


def evidence_there(evidence: Column, page_text: Column) -> Column:
    """Whether a page still holds the first 200 characters of the evidence, white space aside."""
    flat = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.contains(flat(page_text), F.substring(flat(evidence), 1, 200))


def cacheable(answers: DataFrame) -> DataFrame:
    """Answers that may be cached: verified, without a budget note, with nothing unread, and one value only."""
    return answers.filter("verified and not coalesce(budget_note, false) and unread = 0 and not coalesce(ambiguous, false)")


def evict(cache: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    return cache.join(bad, on, "left_anti")


def recall_words(question: Column) -> Column:
    filler = F.array(*(F.lit(w) for w in W.RECALL_FILLER))
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), F.lit(0))), filler)


def recall(questions: DataFrame, memory: DataFrame, least: float = W.RECALL_JACCARD) -> DataFrame:
    """questions (query_id, question, docs) with the remembered answer to nearly the same question on the same documents.

    Candidates share the documents and a word, which is how they are joined; the best share of words decides, the oldest
    of equals. memory: (q, a, docs, verified, ts).
    """
    old = memory.filter("verified").select(F.array_sort("docs").alias("_d"), recall_words(F.col("q")).alias("_m"), "a", "ts")
    asked = questions.select("query_id", F.array_sort("docs").alias("_d"), recall_words(F.col("question")).alias("_w"))
    left = asked.select("query_id", "_d", "_w", F.explode_outer("_w").alias("_t"))
    right = old.select("_d", "_m", "a", "ts", F.explode_outer("_m").alias("_t"))
    pairs = left.join(right, ["_d", "_t"]).select("query_id", "_w", "_m", "a", "ts").distinct()
    share = F.size(F.array_intersect("_w", "_m")) / F.greatest(F.size(F.array_union("_w", "_m")), F.lit(1))
    best = pairs.withColumn("j", share).filter(F.col("j") >= least).groupBy("query_id").agg(F.min_by("a", F.struct(-F.col("j"), F.col("ts"))).alias("recalled"))
    return questions.join(best, "query_id", "left")


def remember(memory: DataFrame, new: DataFrame, keep: int = MEMORY) -> DataFrame:
    """memory with new items instead of those with the same question and documents; the latest `keep` stay."""
    kept = memory.join(new.select("q", "docs").distinct(), ["q", "docs"], "left_anti")
    return kept.unionByName(new).orderBy(F.desc("ts"), "q").limit(keep)
