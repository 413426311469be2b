"""Budgets, learning and evaluation as ordered folds and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from .folds import affine_groups, fold_groups

# Resources, preset limits, router actions and weights, priors of trust, token defaults.
RESOURCES = ("llm_tokens", "seconds", "tool_calls", "vlm_looks", "ocr_pages")
PRESETS = {"frugal": (1500, 20, 4, 0, 2), "balanced": (4000, 60, 8, 4, 6), "thorough": (12000, 180, 20, 10, 20)}
ACTIONS = ("fields", "text", "ocr", "look")
FEATURES = ("bias", "need_ocr", "visual_kw", "extract_kw", "q_len", "top_score", "vlm_left", "tokens_left", "label_match")
PRIOR = {
    "fields": (0.55, -0.50, -0.50, 0.00, 0.00, 0.20, 0.0, 0.00, 0.90), "text": (0.30, -0.60, -0.30, 0.00, 0.00, 0.60, 0.0, 0.10, 0.00),
    "ocr": (0.10, 0.70, 0.00, 0.00, 0.00, -0.50, 0.0, 0.00, 0.00), "look": (-0.20, 0.10, 0.90, 0.00, 0.00, -0.20, 0.30, 0.00, 0.00),
}
TRUST_PRIOR = {"ocr": (1.0, 1.0), "vision": (0.5, 1.0), "ocr_hw": (3.6, 6.0), "vision_hw": (3.0, 6.0)}
TOKEN_DEFAULT = {"lookup": 1600, "list": 2000, "open": 2600, "visual": 2000}
DECAY, RATE_FEEDBACK, RATE_SELF, EMA = 0.995, 0.15, 0.03, 0.2


def limits(rows: DataFrame, preset: str = "preset", overrides: dict[str, str] | None = None) -> DataFrame:
    """rows with a limit for each resource: the preset's, or the column named in overrides where it isn't null."""
    for i, r in enumerate(RESOURCES):
        value = F.lit(None).cast("double")
        for name, numbers in PRESETS.items():
            value = F.when(F.col(preset) == name, F.lit(float(numbers[i]))).otherwise(value)
        rows = rows.withColumn(f"limit_{r}", F.coalesce(F.col(overrides[r]).cast("double"), value) if overrides and r in overrides else value)
    return rows


def change_limits(rows: DataFrame, asked: str) -> DataFrame:
    """rows (limit_*) with the limits of a map column set, all or none, and changed.

    A change must name something, known resources only, and give numbers of 0 or more, whole ones but for seconds. What is
    used is not touched.
    """
    changes = F.col(asked)
    fits = lambda name, n: name.isin(*RESOURCES) & n.isNotNull() & ~F.isnan(n) & (n >= 0) & (n < float("inf")) & ((name == "seconds") | (n == F.floor(n)))
    valid = F.coalesce((F.size(changes) > 0) & F.forall(F.map_entries(changes), lambda e: F.coalesce(fits(e["key"], e["value"]), F.lit(False))), F.lit(False))
    out = rows.withColumn("changed", valid)
    for r in RESOURCES:
        out = out.withColumn(f"limit_{r}", F.when(F.col("changed"), F.coalesce(F.try_element_at(changes, F.lit(r)), F.col(f"limit_{r}"))).otherwise(F.col(f"limit_{r}")))
    return out


def left(limit: Column, allowance: Column, used: Column) -> Column:
    """What is left under the smaller of the limit and the agent's own allowance, if it has set one."""
    return F.greatest(F.lit(0.0), F.least(F.coalesce(allowance, limit), limit) - used)


def can(remaining: Column, n: Column) -> Column:
    return remaining >= n - F.lit(1e-9)


def spend(events: DataFrame, by: list[str], order: list[str], amount: str, cap: float) -> DataFrame:
    """(by, accepted, spent): spends in order, each refused if less than it is left; what is refused isn't spent.

    A refusal changes what comes later, so a group is folded in its order, one state at a time (see folds.fold_groups).
    Null amounts are passed over.
    """

    def step(state, rows):
        accepted, spent = state
        for n in rows.column(_AMOUNT).to_pylist():
            if n is not None and max(0.0, cap - spent) >= n:
                accepted, spent = accepted + 1, spent + n
        return accepted, spent

    return fold_groups(_amounts(events, by, order, amount), by, order, lambda key: (0, 0.0), step, "accepted long, spent double", tuple)


_AMOUNT = "_amount"


def _amounts(events: DataFrame, by: list[str], order: list[str], amount: str) -> DataFrame:
    return events.select(*dict.fromkeys([*by, *order]), F.col(amount).cast("double").alias(_AMOUNT))


def charge(events: DataFrame, by: list[str], order: list[str], amount: str, cap: float) -> DataFrame:
    """events with used, the running sum, and overshoot beyond the cap; nothing is refused."""
    used = F.sum(amount).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("used", used).withColumn("overshoot", F.greatest(F.lit(0.0), F.col("used") - F.lit(cap)))


def extensions(requests: DataFrame, by: list[str], order: list[str], extra: str, room: float) -> DataFrame:
    """(by, granted, waiting, room_left): requests in order, granted without asking while the room lasts; folded as spend()."""

    def step(state, rows):
        granted, waiting, left = state
        for n in rows.column(_AMOUNT).to_pylist():
            if n is None:
                continue
            if n <= left:
                granted, left = granted + 1, left - n
            else:
                waiting += 1
        return granted, waiting, left

    return fold_groups(_amounts(requests, by, order, extra), by, order, lambda key: (0, 0, float(room)), step, "granted long, waiting long, room_left double", tuple)


def _dot(weights: tuple[float, ...], x: Column) -> Column:
    return F.aggregate(F.zip_with(F.array(*(F.lit(float(w)) for w in weights)), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def label_match(questions: DataFrame, lexicon: DataFrame, least: int = 3) -> DataFrame:
    """(query_id): questions (query_id, q) that hold all tokens of a label that the lexicon (label, n) has often enough."""
    labels = lexicon.filter((F.col("n") >= least) & (F.length("label") > 2)).select("label", F.array_distinct(T.tokens("label")).alias("_t")).filter(F.size("_t") > 0)
    asked = questions.select("query_id", F.explode(F.array_distinct(T.tokens(T.nfc("q")))).alias("_w"))
    held = asked.join(labels.select("label", F.size("_t").alias("_n"), F.explode("_t").alias("_w")), "_w")
    return held.groupBy("query_id", "label").agg(F.count("*").alias("_k"), F.first("_n").alias("_n")).filter("_k = _n").select("query_id").distinct()


def router_features(questions: DataFrame, pages, lexicon: DataFrame) -> DataFrame:
    """questions (query_id, q, vlm_left, tokens_left, tokens_limit) with x, the router's features in the order of FEATURES.

    pages: an index of units with source, or units with tokens and source. The share of unread pages and the best score of each question are those of all
    pages; a label only counts where a page scores.
    """
    from .index import Index, search_many

    need = Index.of(pages).units.agg(F.coalesce(F.avg(F.col("source").isin("none", "scan-text").cast("double")), F.lit(0.0)).alias("_need"))
    best = search_many(pages, questions.select("query_id", "q"), ["doc_id", "page"], 1).select("query_id", F.col("score").alias("_top"))
    named = label_match(questions, lexicon).withColumn("_label", F.lit(1.0))
    rows = questions.crossJoin(F.broadcast(need)).join(best, "query_id", "left").join(named, "query_id", "left")
    flag = lambda pattern: F.coalesce(F.col("q").rlike("(?i)" + pattern), F.lit(False)).cast("double")
    share = lambda c, most: F.least(c / F.lit(most), F.lit(1.0))
    x = F.array(
        F.lit(1.0), F.col("_need"), flag(W.LOOK_Q), flag(W.EXTRACT_Q), share(F.length("q"), 120.0), share(F.coalesce("_top", F.lit(0.0)), 10.0),
        can(F.col("vlm_left"), F.lit(1.0)).cast("double"), F.col("tokens_left") / F.greatest("tokens_limit", F.lit(1.0)),
        F.when(F.col("_top").isNotNull(), F.coalesce("_label", F.lit(0.0))).otherwise(0.0),
    )
    return rows.withColumn("x", x).drop("_need", "_top", "_label")


def route(rows: DataFrame, features: str = "x", digits: int = 9, explore: float = 0.0, by: str | None = None) -> DataFrame:
    """rows with actions: the strategies, best score first, ties in their fixed order. No shuffle.

    A share `explore` of the rows, chosen by the hash of column `by`, so that reruns agree, gets another strategy first.
    """
    scored = F.array(*(F.struct(F.round(-_dot(PRIOR[a], F.col(features)), digits).alias("s"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(ACTIONS)))
    actions = F.transform(F.array_sort(scored), lambda s: s["a"])
    if explore and by:
        drawn = F.crc32(F.col(by).cast("string").cast("binary"))
        first = F.element_at(actions, (F.floor(drawn / 10_000) % len(ACTIONS) + 1).cast("int"))
        actions = F.when(drawn % 10_000 < explore * 10_000, F.array_distinct(F.concat(F.array(first), actions))).otherwise(actions)
    return rows.withColumn("actions", actions)


def feedback(events: DataFrame) -> DataFrame:
    """(request, effect, what, value): what verdicts on answers change, one row an effect.

    events: request, verdict, correction, answer, action, and the reading that was used (kind, used, ocr, vision), kind
    null if there was none. evict: the answer leaves the cache, unless the verdict is good. remember: the answer, or the
    correction of a bad one. reward: 1 or -1 for a router's action. trust: a source read right or wrong; with a good
    verdict the used one was right and one that disagrees wrong, with a correction those that equal it were right.
    """
    good = F.col("verdict") == "good"
    corrected = ~good & (F.coalesce("correction", F.lit("")) != "")
    effect = lambda when, name, what, value: F.when(when, F.struct(F.lit(name).alias("effect"), what.cast("string").alias("what"), value.cast("string").alias("value")))
    effects = [
        effect(~good, "evict", F.lit("cache"), F.lit(None)),
        effect(good, "remember", F.lit("answer"), F.col("answer")),
        effect(corrected, "remember", F.lit("correction"), F.col("correction")),
        effect(F.col("action").isin(*ACTIONS), "reward", F.col("action"), F.when(good, 1).otherwise(-1)),
    ]
    used = F.when(F.col("used") == "ocr", F.col("ocr")).otherwise(F.col("vision"))
    for source in ("ocr", "vision"):
        read = F.coalesce(source, F.lit("")) != ""
        own = F.col("used") == source
        differs = read & ~T.same_value(F.coalesce(source, F.lit("")), F.coalesce(used, F.lit("")))
        right = F.when(good & own, True).when(good & differs, False).when(corrected & read, T.same_value(F.col(source), F.col("correction")))
        effects.append(effect(F.col("kind").isNotNull() & right.isNotNull(), "trust", F.concat_ws(":", "kind", F.lit(source)), right))
    rows = events.select("request", F.explode(F.filter(F.array(*effects), lambda e: e.isNotNull())).alias("e"))
    return rows.select("request", "e.*")


def learn_router(feedback: DataFrame, by: list[str], order: list[str], features: str = "x", reward: str = "reward", rate: float = RATE_FEEDBACK) -> DataFrame:
    """(by, action, theta): weights after the updates of each action, in order: shrunk, then moved along the error.

    Updates are affine maps of the weights, so a long group is composed from ranges (see folds.affine_groups). Rows with
    null features or reward are passed over; unknown actions have null weights.
    """
    import numpy as np

    def update(rows):
        for x, r in zip(rows.column("_x").to_pylist(), rows.column("_r").to_pylist()):
            if x is not None and r is not None and None not in x:
                yield np.array(x), r, DECAY, rate

    def start(key):
        return np.array(PRIOR[key[-1]]) if key[-1] in PRIOR else None

    rows = feedback.select(*dict.fromkeys([*by, "action", *order]), F.col(features).cast("array<double>").alias("_x"), F.col(reward).cast("double").alias("_r"))
    return affine_groups(rows, [*by, "action"], order, len(FEATURES), start, update)


def promote(candidate: DataFrame, live: DataFrame, gain: float = 0.0) -> DataFrame:
    """One row, promoted: the candidate's accuracy overall is that of the live policy and `gain`, and no category falls.

    Both have (category, right). Categories that the candidate lacks count as 0.
    """
    share = lambda df, n: df.groupBy("category").agg(F.avg(F.col("right").cast("double")).alias(n))
    each = share(live, "l").join(share(candidate, "c"), "category", "left").agg(F.coalesce(F.bool_and(F.coalesce("c", F.lit(0.0)) >= F.col("l") - 1e-9), F.lit(True)).alias("kept"))
    whole = lambda df, n: df.agg(F.avg(F.col("right").cast("double")).alias(n))
    return each.crossJoin(whole(candidate, "all_c")).crossJoin(whole(live, "all_l")).select((F.col("kept") & (F.col("all_c") >= F.col("all_l") + gain)).alias("promoted"))


def trust(readings: DataFrame) -> DataFrame:
    """(kind, ocr, vision, prefer): share of right readings of each source with its prior; equal shares prefer ocr."""
    counts = readings.groupBy("kind").agg(*(F.sum(F.when(F.col("source") == s, c)).alias(f"{s}_{n}") for s in ("ocr", "vision") for n, c in (("r", F.col("right").cast("int")), ("n", F.lit(1)))))

    def score(s: str) -> Column:
        hand = F.col("kind").endswith("_hw")
        prior = [F.when(hand, F.lit(TRUST_PRIOR[f"{s}_hw"][i])).otherwise(F.lit(TRUST_PRIOR[s][i])) for i in (0, 1)]
        return (prior[0] + F.coalesce(f"{s}_r", F.lit(0))) / (prior[1] + F.coalesce(f"{s}_n", F.lit(0)))

    out = counts.select("kind", score("ocr").alias("ocr"), score("vision").alias("vision"))
    return out.withColumn("prefer", F.when(F.col("ocr") >= F.col("vision"), "ocr").otherwise("vision"))


def token_allowance(records: DataFrame, order: list[str], limit: float, cls: str = "cls", used: str = "used") -> DataFrame:
    """(cls, n, ema, allowance): the running mean of tokens used, begun with the first value, and what a class may use.

    The mean is a weighted sum: a run of m values turns a mean e into (1 - EMA)**m * e plus a sum of the run's own values. So
    records are dealt into ranges of the order, each range of a class is one fold, and only the ranges' sums of a class come
    together, in order.
    """
    kept = F.lit(1 - EMA)
    value = F.col(used).cast("double")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = records.select(cls, *order, value.alias("_u")).repartitionByRange(tasks, *order).withColumn("_p", F.spark_partition_id())
    listed = ranges.groupBy(cls, "_p").agg(F.array_sort(F.collect_list(F.struct(*order, "_u"))).alias("e"))
    step = lambda s, u: kept * s + F.lit(EMA) * u
    runs = listed.select(cls, "_p", F.size("e").alias("m"), F.get("e", F.lit(0))["_u"].alias("first"), F.aggregate("e", F.lit(0.0), lambda s, e: step(s, e["_u"])).alias("sum"))
    joined = runs.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct("_p", "m", "first", "sum"))).alias("r"))
    # begun with the first value, as if it had stood there before
    ema = F.aggregate("r", F.get("r", F.lit(0))["first"], lambda s, r: F.pow(kept, r["m"]) * s + r["sum"])
    n = F.aggregate("r", F.lit(0), lambda s, r: s + r["m"])
    default = F.lit(None).cast("double")
    for name, tokens in TOKEN_DEFAULT.items():
        default = F.when(F.col(cls) == name, F.lit(float(tokens))).otherwise(default)
    out = joined.select(cls, n.alias("n"), ema.alias("ema"))
    base = F.when(F.col("n") < 5, default).otherwise(F.greatest(F.lit(0.6) * default, F.lit(2.0) * F.col("ema")))
    return out.withColumn("allowance", F.floor(F.least(F.lit(float(limit)), base)).cast("long"))


def accuracy(results: DataFrame, category: str = "category", right: str = "right") -> DataFrame:
    """(category, n, accuracy) for each category and, with category null, over all: grouping sets in one aggregate."""
    return results.rollup(category).agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("accuracy"))


def holds(answer: Column, gold: Column) -> Column:
    """Whether an answer holds a gold text; a gold word of letters must not stand inside a longer one."""
    tidy = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), ",", ""), r"\s+", " "))
    a, g = tidy(answer), tidy(gold)
    padded = F.concat(F.lit(" "), F.regexp_replace(a, "[^a-z]", " "), F.lit(" "))
    return F.when(g.rlike("^[a-z]+$"), F.contains(padded, F.concat(F.lit(" "), g, F.lit(" ")))).otherwise(F.contains(a, g))


def correct_gold(answer: Column, any_: Column, all_: Column, none_of: Column) -> Column:
    """One of any_, all of all_ and none of none_of; null lists ask nothing."""
    return (
        F.coalesce(F.exists(any_, lambda g: holds(answer, g)), F.lit(True)) & F.coalesce(F.forall(all_, lambda g: holds(answer, g)), F.lit(True))
        & ~F.coalesce(F.exists(none_of, lambda g: holds(answer, g)), F.lit(False))
    )


def first_share(rows: DataFrame, order: list[str], share: float = 0.6) -> DataFrame:
    """rows with dev: whether they are in the first share by order. For evaluation items, which one task can rank."""
    number = F.row_number().over(Window.orderBy(*order))
    total = rows.agg(F.count("*").alias("_t"))
    return rows.withColumn("_n", number).crossJoin(F.broadcast(total)).withColumn("dev", F.col("_n") <= F.floor(F.col("_t") * share)).drop("_n", "_t")
