"""Term statistics, coverage-weighted BM25, trigram ranking and vector search over units (pages or chunks)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grams
from ..functions import text as T
from ..functions import words as W
from ..functions.spelling import by_length, spelt
from ..sources import sinks
from ..sources.store import Snapshot, Store

#: Queries that are shipped to every executor at once; more of them are joined by term.
BROADCAST_QUERIES = 5_000
#: Terms that are kept in the plan as a set, so that other tokens don't leave their row.
LITERAL_TERMS = 10_000
#: Terms up to which a stored index is asked for each of them; beyond, its postings are read as a whole.
NEAR_TERMS = 200


def add_tokens(units: DataFrame, text: str = "text", compose: bool = True) -> DataFrame:
    """units with toks and n_toks."""
    source = T.nfc(text) if compose else F.col(text)
    return units.withColumn("toks", T.tokens(source)).withColumn("n_toks", F.size("toks"))


@dataclass(frozen=True)
class Index:
    """Units (keys, text, toks, n_toks, ...) and, where they are stored, what questions are answered from without the texts.
    Parts that are not stored are made from the units.

    postings: (term, keys, n_toks, f), one row a unit and term; grams: (gram, uids), the packed numbers of units that hold a
    trigram, a row for each trigram and piece of text, both sorted by what is looked up, so that a question reads the few
    row groups that hold it; terms: (term, df); runs: (run), see absent_many; totals: one row (n, total). Functions take
    units as a DataFrame as well; then the parts that a question needs are made from it each time.
    """

    units: DataFrame
    keys: tuple[str, ...] = ("doc_id", "page")
    postings: DataFrame | None = None
    grams: DataFrame | None = None
    totals: DataFrame | None = None
    terms: DataFrame | None = None
    runs: DataFrame | None = None

    @staticmethod
    def of(units: "Index | DataFrame", keys: tuple[str, ...] = ("doc_id", "page")) -> "Index":
        return units if isinstance(units, Index) else Index(units, tuple(keys))

    @staticmethod
    def build(units: DataFrame, keys: tuple[str, ...], folder: str) -> "Index":
        """An index of units with tokens in a folder that all executors see; what was built there before is replaced."""
        held = IndexStore(units.sparkSession, folder, keys)
        held.replace(units)
        return held.open()

    def near(self, terms: list[str]) -> DataFrame:
        """Postings of terms, and of tokens that share the first four letters of one that may be matched so."""
        heads = sorted({t[:4] for t in terms if len(t) >= 5})
        if self.postings is None:
            rows = self.units.select(*self.keys, "n_toks", F.explode(_near(F.col("toks"), terms)).alias("term"))
            return rows.groupBy("term", *self.keys, "n_toks").agg(F.count("*").alias("f"))
        return self.postings.filter(reduce(lambda x, y: x | y, (F.col("term").startswith(h) for h in heads), F.col("term").isin(*terms)))

    def every_posting(self) -> DataFrame:
        return _postings(self.units, self.keys) if self.postings is None else self.postings

    def holding(self, lists: list[list[str]]) -> DataFrame:
        """(keys, _g0, _g1, ...): how many trigrams of each list a unit's text holds; units that hold none have no row."""
        names = [f"_g{i}" for i in range(len(lists))]
        if self.grams is None:
            page = self.units.select(*self.keys, _flat().alias("_page"))
            counts = [sum((F.contains("_page", F.lit(g)).cast("long") for g in own), F.lit(0).cast("long")).alias(n) for n, own in zip(names, lists)]
            return page.select(*self.keys, *counts).filter(reduce(lambda x, y: x | y, (F.col(n) > 0 for n in names)))
        packed = self.grams.filter(F.col("gram").isin(*sorted({g for own in lists for g in own})))
        sums = packed.mapInArrow(grams.counted(lists), "uid long, " + ", ".join(f"{n} long" for n in names)).groupBy("uid").agg(*(F.sum(n).alias(n) for n in names))
        return self.units.select(F.col("_uid").alias("uid"), *self.keys).join(sums, "uid").drop("uid")

    def total(self) -> DataFrame:
        return _totals(self.units) if self.totals is None else self.totals

    def without(self, condition: Column) -> "Index":
        """The index without the units that a condition on the keys is true of; stored statistics are counted anew."""
        kept = lambda df: None if df is None else df.filter(~F.coalesce(condition, F.lit(False)))
        return Index(kept(self.units), self.keys, kept(self.postings), self.grams, None)

    def rows(self, best: DataFrame, order: list[Column]) -> DataFrame:
        """The units of a few best rows (keys and scores), in their order. The rows are bounded, and name what is read."""
        found = best.collect()
        if not found:
            return self.units.limit(0).join(best, list(self.keys)).drop("_uid")
        held = best.sparkSession.createDataFrame(found, best.schema)
        named = reduce(lambda x, y: x & y, (F.col(k).isin(*{r[k] for r in found}) for k in self.keys))
        return self.units.filter(named).join(F.broadcast(held), list(self.keys)).drop("_uid").orderBy(*order)


def _postings(units: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return units.select(*keys, "n_toks", F.explode("toks").alias("term")).groupBy("term", *keys, "n_toks").agg(F.count("*").alias("f"))


#: Bytes of a segment's units for which its postings and trigrams get a partition, and from which all tasks are used.
PART_BYTES, LEAST_BYTES = 32 << 20, 1 << 20
#: Segments, and share of the units that are dropped, from which an index is merged into one segment.
MOST_SEGMENTS, MOST_DROPPED = 8, 0.25
#: What a segment may hold besides its units.
PARTS_OF_INDEX = ("postings", "grams", "terms", "runs")


class IndexStore:
    """An index that changes: segments of units, each built once, and what has been dropped from them, in a versioned store.

    Adding or dropping units writes about as much as they are: a segment of the new ones, and the keys of dropped ones with
    what they take off the terms' counts and the totals. Changes are versions: a build that fails leaves the index as it
    was, and a reader keeps the version that it has opened. From MOST_SEGMENTS segments, or MOST_DROPPED of the units
    dropped, the live units become one segment.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = ("doc_id", "page")):
        self.spark, self.keys, self.store = spark, tuple(keys), Store(spark, folder)

    def built(self, parts: tuple[str, ...] = ()) -> bool:
        held = self.store.read().values
        return "segments" in held and set(parts) <= set(held.get("parts", PARTS_OF_INDEX))

    def open(self, snapshot: Snapshot | None = None) -> Index:
        now = snapshot or self.store.read()
        table = lambda name: self.store.table(name, now)
        segments, dropped = now.values["segments"], now.values["dropped"]
        parts = now.values.get("parts", PARTS_OF_INDEX)

        def live(part: str) -> DataFrame:
            """A part of all segments, without what was dropped from each since."""
            out = []
            for s in segments:
                rows = table(f"{part}-{s}")
                for d, of in dropped.items():
                    if s in of["segments"]:
                        gone = table(f"dropped-{d}")
                        same = reduce(lambda x, y: x & y, (rows[k].eqNullSafe(gone[k]) for k in self.keys))
                        rows = rows.join(gone, same, "left_anti")
                out.append(rows)
            return reduce(DataFrame.unionByName, out)

        whole = lambda part: reduce(DataFrame.union, (table(f"{part}-{s}") for s in segments)) if part in parts else None
        terms = whole("terms")
        if terms is not None and (dropped or len(segments) > 1):
            less = [table(f"dropped-terms-{d}").withColumn("df", -F.col("df")) for d in dropped]
            terms = reduce(DataFrame.unionByName, less, terms).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        n, total = (sum(s[c] for s in segments.values()) - sum(d[c] for d in dropped.values()) for c in ("n", "total"))
        totals = self.spark.createDataFrame([(n, total)], "n long, total long")
        # A run that only dropped units hold would pass for one that is there.
        runs = None if dropped or "runs" not in parts else whole("runs") if len(segments) == 1 else whole("runs").distinct()
        return Index(live("units"), self.keys, live("postings") if "postings" in parts else None, whole("grams"), totals, terms, runs)

    def replace(self, units: DataFrame, parts: tuple[str, ...] = PARTS_OF_INDEX) -> Snapshot:
        """Units with tokens as the only segment, with some parts; complete() adds others."""
        base = self.store.read()
        tables, values = self._segment(units, 0, parts)
        gone = dict.fromkeys(n for n in base.tables)
        return self.store.publish(base, {**gone, **tables}, {"segments": {"0": values}, "dropped": {}, "next": 1, "parts": list(parts)})

    def complete(self, parts: tuple[str, ...] = PARTS_OF_INDEX) -> Snapshot:
        """Adds the parts that the segments don't have yet."""
        base = self.store.read()
        held = base.values.get("parts", PARTS_OF_INDEX)
        new = tuple(p for p in parts if p not in held)
        if not new:
            return base
        tables = {}
        for s in base.values["segments"]:
            tables |= self._parts(base.tables, s, new)
        return self.store.publish(base, tables, {"parts": [*held, *new]})

    def add(self, units: DataFrame) -> Snapshot:
        """Adds units with tokens; they take the place of units of the same keys."""
        base = self.store.read()
        number = base.values["next"]
        tables, values = self._segment(units, number, tuple(base.values.get("parts", PARTS_OF_INDEX)))
        dropped = dict(base.values["dropped"])
        more, what = self._gone(base, self.store.spark.read.parquet(f"{self.store.folder}/{tables[f'units-{number}']['path']}").select(*self.keys), number)
        if what:
            dropped[str(number)] = what
        made = self.store.publish(base, {**tables, **more}, {"segments": {**base.values["segments"], str(number): values}, "dropped": dropped, "next": number + 1})
        return self._kept_small(made)

    def drop(self, keys: DataFrame) -> Snapshot:
        """Drops the units of some keys; keys that it doesn't have change nothing."""
        base = self.store.read()
        number = base.values["next"]
        tables, what = self._gone(base, keys.select(*self.keys), number)
        if not what:
            return base
        made = self.store.publish(base, tables, {"dropped": {**base.values["dropped"], str(number): what}, "next": number + 1})
        return self._kept_small(made)

    def merge(self) -> Snapshot:
        """The live units as one segment."""
        return self.replace(self.open().units.drop("_uid"), tuple(self.store.read().values.get("parts", PARTS_OF_INDEX)))

    def _kept_small(self, made: Snapshot) -> Snapshot:
        n = sum(s["n"] for s in made.values["segments"].values())
        gone = sum(d["n"] for d in made.values["dropped"].values())
        return self.merge() if len(made.values["segments"]) > MOST_SEGMENTS or gone > MOST_DROPPED * n else made

    def _gone(self, base: Snapshot, keys: DataFrame, number: int) -> tuple[dict, dict | None]:
        """What dropping the live units of keys writes: their keys and their terms' counts."""
        held = self.open(base).units
        wanted = keys.distinct().alias("wanted")
        same = reduce(lambda x, y: x & y, (held[k].eqNullSafe(F.col(f"wanted.`{k}`")) for k in self.keys))
        own = self.store.put(held.join(wanted, same, "left_semi").select(*self.keys, "n_toks", F.array_distinct("toks").alias("toks")))
        written = self.spark.read.parquet(f"{self.store.folder}/{own['path']}")
        sums = _totals(written).first()
        if not sums.n:
            return {}, None
        tables = {f"dropped-{number}": self.store.put(written.select(*self.keys)), f"dropped-terms-{number}": self.store.put(written.select(F.explode("toks").alias("term")).groupBy("term").agg(F.count("*").alias("df")))}
        return tables, {"n": sums.n, "total": sums.total, "segments": list(base.values["segments"])}

    def _segment(self, units: DataFrame, number: int, parts: tuple[str, ...]) -> tuple[dict, dict]:
        """The tables of a segment, and its totals."""
        uid = (F.monotonically_increasing_id() + F.lit(number << 52)).alias("_uid")
        own = {f"units-{number}": self.store.put(units.select("*", uid))}
        sums = _totals(self._written(own[f"units-{number}"])).first()
        return {**own, **self._parts(own, str(number), parts)}, {"n": sums.n, "total": sums.total}

    def _written(self, table: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.folder}/{table['path']}")

    def _parts(self, tables: dict, number: str, parts: tuple[str, ...]) -> dict:
        """Some parts of a segment whose units are written. Partitions follow its bytes."""
        own, out = tables[f"units-{number}"], {}
        held = self._written(own)
        size = self.store._files.getContentSummary(self.store._path(own["path"])).getLength()
        tasks = max(size // PART_BYTES + 1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES + 1))
        if "postings" in parts:
            # A range is cut inside a common term too, by the units' keys.
            out["postings"] = self.store.put(_postings(held, self.keys).repartitionByRange(tasks, "term", *self.keys).sortWithinPartitions("term", *self.keys))
        if "grams" in parts:
            packed = held.select(F.col("_uid").alias("uid"), _flat().alias("flat")).mapInArrow(grams.packed, "gram string, uids binary")
            out["grams"] = self.store.put(packed.repartitionByRange(tasks, "gram", F.xxhash64("uids")).sortWithinPartitions("gram"))
        if "terms" in parts:
            posted = out.get("postings") or tables.get(f"postings-{number}")
            rows = Index(held, self.keys, None if posted is None else self._written(posted))
            out["terms"] = self.store.put(document_frequencies(rows))
        if "runs" in parts:
            out["runs"] = self.store.put(_words(Index(held, self.keys)))
        return {f"{name}-{number}": table for name, table in out.items()}


def _flat(text: str = "text") -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "), F.lit(" "))


def _totals(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_toks"), F.lit(0)).cast("long").alias("total"))


def term_frequencies(units: Index | DataFrame, keys: list[str] = ("doc_id", "page")) -> DataFrame:
    """(keys, term, f): one shuffle by unit and term, after partial counts; none where the index is stored."""
    return Index.of(units, tuple(keys)).every_posting().select(*keys, "term", "f")


def document_frequencies(units: Index | DataFrame) -> DataFrame:
    """(term, df): units that hold a term. A unit's distinct terms are found in its row, so only terms are shuffled."""
    if isinstance(units, Index) and units.terms is not None:
        return units.terms
    if isinstance(units, Index) and units.postings is not None:
        return units.postings.groupBy("term").agg(F.count("*").alias("df"))
    return Index.of(units).units.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def drop_page(units: Index | DataFrame, doc_id, page: int) -> Index:
    return Index.of(units).without(F.col("doc_id").eqNullSafe(F.lit(doc_id)) & (F.col("page") == page))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _near(toks: Column, terms: list[str]) -> Column:
    """Tokens that are terms, or share the first four letters of one that may be matched so."""
    heads = sorted({t[:4] for t in terms if len(t) >= 5})
    if not terms:
        return F.array().cast("array<string>")
    if not heads:
        return F.filter(toks, lambda t: t.isin(*terms))
    return F.filter(toks, lambda t: t.isin(*terms) | F.substring(t, 1, 4).isin(*heads))


def _scored(units: Index | DataFrame, question: str) -> tuple[DataFrame, list[str]]:
    """(keys, n_toks, bm25, coverage, score) of the units that a term of the question touches; the others' scores are 0.

    Statistics are those of all units, whatever is searched. The question's terms are known, so both they and a unit's
    scores are sums over the postings of its few terms. Where no postings are stored, units are cut into tokens once: of
    each its keys, its length and its tokens near the terms are written, no text and no other token.
    """
    ix, terms = Index.of(units), list(dict.fromkeys(T.tokens_of(question)))
    kinds = ", ".join(f"{k} {ix.units.schema[k].dataType.simpleString()}" for k in ix.keys)
    if not terms:
        return ix.units.sparkSession.createDataFrame([], f"{kinds}, n_toks int, bm25 double, coverage double, score double"), terms
    if ix.postings is None:
        ix = replace(ix, units=_written(ix.units.select(*ix.keys, "n_toks", _near(F.col("toks"), terms).alias("toks")), "near"))
    near = ix.near(terms)
    counts = near.agg(*(F.count_if(F.col("term") == t).alias(f"_d{i}") for i, t in enumerate(terms)))
    stats = counts.crossJoin(ix.total().select(F.greatest("n", F.lit(1)).alias("_n"), F.col("total").alias("_len")))  # one row each
    shares = lambda t: (F.col("term") == t) if len(t) < 5 else (F.col("term") == t) | ((F.length("term") >= 4) & F.col("term").startswith(t[:4]))
    each = near.groupBy(*ix.keys, "n_toks").agg(
        *(F.sum(F.when(F.col("term") == t, F.col("f")).otherwise(0)).alias(f"_f{i}") for i, t in enumerate(terms)), *(F.max(shares(t)).alias(f"_c{i}") for i, t in enumerate(terms))
    )
    rows = each.crossJoin(F.broadcast(stats))
    average = F.when(F.col("_len") > 0, F.col("_len") / F.col("_n")).otherwise(F.lit(1.0))
    bm25, total, covered = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in range(len(terms)):
        f, weight = F.col(f"_f{i}"), idf(F.col("_n"), F.col(f"_d{i}"))
        bm25 = bm25 + weight * f * F.lit(W.K1 + 1) / (f + F.lit(W.K1) * (F.lit(1 - W.B) + F.lit(W.B) * F.col("n_toks") / average))
        total = total + weight
        covered = covered + F.when(F.col(f"_c{i}"), weight).otherwise(F.lit(0.0))
    rows = rows.select(*ix.keys, "n_toks", bm25.alias("bm25"), (covered / F.when(total == 0, F.lit(1.0)).otherwise(total)).alias("coverage"))
    return rows.withColumn("score", F.col("bm25") * (F.lit(0.25) + F.lit(0.75) * F.col("coverage"))), terms


def _all_units(ix: Index, scores: DataFrame, columns: list[str], others: list[str] = ()) -> DataFrame:
    """The keys and some columns of all units with scores, 0 where there is none; texts are not read."""
    left = ix.units.select(*ix.keys, *others).join(scores.select(*ix.keys, *columns), list(ix.keys), "left")
    return left.select(*ix.keys, *others, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))


def coverage(units: Index | DataFrame, question: str) -> DataFrame:
    """(keys, coverage) of all units."""
    return _all_units(Index.of(units), _scored(units, question)[0], ["coverage"])


def search(units: Index | DataFrame, question: str, k: int = 4, scope: Column | None = None, order: list[str] = ("doc_id", "page"), digits: int = 6) -> DataFrame:
    """The k best units by score, above 0, ties by `order`. scope, a condition on the keys, limits what is ranked, not the statistics."""
    ix, (scored, _) = Index.of(units), _scored(units, question)
    if scope is not None:
        scored = scored.filter(scope)
    ranked = scored.filter("bm25 > 0").withColumn("score", F.round("score", digits)).drop("n_toks")
    by = [F.desc("score"), *map(F.col, order)]
    return ix.rows(ranked.orderBy(*by).limit(k), by)


def best_coverage(units: Index | DataFrame, question: str, scope: Column | None = None) -> DataFrame:
    scored, _ = _scored(units, question)
    return (scored if scope is None else scored.filter(scope)).agg(F.coalesce(F.max("coverage"), F.lit(0.0)).alias("coverage"))


def scores_many(units: Index | DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, keys, bm25, coverage) of the units that a term of a query (query_id, q) touches.

    Only tokens that some query has, or whose first four letters it shares, leave a unit's row; the statistics of the
    terms are an aggregate over those. Queries are broadcast up to BROADCAST_QUERIES of them, joined by term beyond.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.tokens(T.nfc("q")))).alias("term"))
    small = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    hint = F.broadcast if small else (lambda df: df)
    ix = Index.of(units, tuple(keys))
    totals = ix.total().select(F.greatest("n", F.lit(1)).alias("n"), (F.col("total") / F.greatest("n", F.lit(1))).alias("avg"))
    terms = wanted.select("term").distinct()
    known = [r.term for r in terms.limit(LITERAL_TERMS + 1).collect()] if small else []
    own = ix.near(sorted(known)) if 0 < len(known) <= (LITERAL_TERMS if ix.postings is None else NEAR_TERMS) else ix.every_posting()
    heads = wanted.filter(F.length("term") >= 5).select(F.substring("term", 1, 4).alias("head")).distinct()
    exact = own.join(hint(terms), "term", "left_semi")
    df = exact.groupBy("term").agg(F.count("*").alias("df")) if ix.terms is None else ix.terms.join(hint(terms), "term", "left_semi")
    weights = wanted.join(df, "term", "left").crossJoin(F.broadcast(totals)).select("query_id", "term", "avg", idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))
    total = weights.groupBy("query_id").agg(F.sum("idf").alias("total"))
    part = F.col("idf") * F.col("f") * (W.K1 + 1) / (F.col("f") + W.K1 * ((1 - W.B) + W.B * F.col("n_toks") / F.col("avg")))
    hits = exact.join(hint(weights), "term").select("query_id", *keys, "term", "idf", part.alias("part"))
    near = own.filter(F.length("term") >= 4).select(*keys, F.substring("term", 1, 4).alias("head")).join(hint(heads), "head", "left_semi")
    long = weights.filter(F.length("term") >= 5).select("query_id", "term", "idf", F.substring("term", 1, 4).alias("head"))
    also = near.join(hint(long), "head").select("query_id", *keys, "term", "idf", F.lit(0.0).alias("part"))
    # One exchange serves both sums; tokens of one beginning that a unit repeats fall together in the first.
    each = hits.union(also).repartition("query_id", *keys).groupBy("query_id", *keys, "term").agg(F.max("idf").alias("idf"), F.max("part").alias("part"))
    sums = each.groupBy("query_id", *keys).agg(F.sum("part").alias("bm25"), F.sum("idf").alias("covered")).join(hint(total), "query_id")
    return sums.select("query_id", *keys, "bm25", (F.col("covered") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("coverage"))


def best_of_many(units: Index | DataFrame, queries: DataFrame, keys: list[str], k: int = 10, digits: int = 6, within: tuple[str, ...] = (), scores: DataFrame | None = None) -> DataFrame:
    """(query_id, keys, score, rank, coverage): the k best units of each query (query_id, q), ties by keys; within: of each group of units.

    scores: what scores_many gave for the queries, if it is there already.
    """
    score = F.round(F.col("bm25") * (0.25 + 0.75 * F.col("coverage")), digits)
    scored = (scores_many(units, queries, keys) if scores is None else scores).filter("bm25 > 0").withColumn("score", score)
    return top(scored, ["query_id", *within], [F.desc("score"), *keys], k).select("query_id", *keys, "score", "rank", "coverage")


def search_many(units: Index | DataFrame, queries: DataFrame, keys: list[str], k: int = 10, digits: int = 6, within: tuple[str, ...] = ()) -> DataFrame:
    """best_of_many without coverage."""
    return best_of_many(units, queries, keys, k, digits, within).drop("coverage")


def top(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def _touched(ix: Index, question: str) -> DataFrame:
    """(keys, bm25, coverage, score, fuzzy) of the units that share a term or a trigram with the question; the others' are 0."""
    scored = _scored(ix, question)[0].drop("n_toks")
    words = [w for w in dict.fromkeys(T.tokens_of(question)) if len(w) >= 4]
    if not words:
        return scored.withColumn("fuzzy", F.lit(0.0))
    padded = [f" {re.sub('[^a-z0-9]+', ' ', w)} " for w in words]
    lists = [sorted({p[j : j + 3] for j in range(len(p) - 2)}) for p in padded]
    counts = ix.near(words).agg(*(F.count_if(F.col("term") == w).alias(f"_w{i}") for i, w in enumerate(words)))
    stats = counts.crossJoin(ix.total().select(F.greatest("n", F.lit(1)).alias("_n")))
    fuzzy = F.lit(0.0)
    for i, own in enumerate(lists):
        fuzzy = fuzzy + idf(F.col("_n"), F.col(f"_w{i}")) * F.col(f"_g{i}") / F.lit(float(max(len(own), 1)))
    near = ix.holding(lists).crossJoin(F.broadcast(stats)).select(*ix.keys, fuzzy.alias("fuzzy"))
    both = near.join(scored, list(ix.keys), "full")
    return both.select(*ix.keys, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bm25", "coverage", "score", "fuzzy")))


def trigram_scores(units: Index | DataFrame, question: str) -> DataFrame:
    """(keys, bm25, coverage, score, fuzzy) of all units. fuzzy: for question words of four letters or more, idf times the
    share of the word's trigrams in the text."""
    ix = Index.of(units)
    return _all_units(ix, _touched(ix, question), ["bm25", "coverage", "score", "fuzzy"])


def _relevance(scored: DataFrame, digits: int = 6) -> DataFrame:
    """scored with relevance: BM25 and trigram scores, each as a share of the best."""
    tops = scored.agg(F.max(F.when(F.col("bm25") > 0, F.col("score"))).alias("_b"), F.max("fuzzy").alias("_f"))
    share = lambda c, m: c / F.when(F.coalesce(m, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(m)
    both = F.round(share(F.col("score"), F.col("_b")) + share(F.col("fuzzy"), F.col("_f")), digits)
    return scored.crossJoin(F.broadcast(tops)).withColumn("relevance", both).drop("_b", "_f")


def _named(ix: Index, question: str) -> DataFrame | None:
    """(keys): the units that hold the phrases that a question names; None if it names none.

    A text that holds a phrase holds its trigrams, so only texts that hold all of them are read.
    """
    phrases = ix.units.sparkSession.range(1).select(T.entities(F.lit(question)).alias("e")).first().e
    if not phrases:
        return None
    flat = [re.sub("[^a-z0-9]+", " ", p.lower()).strip() for p in phrases]
    own = sorted({p[j : j + 3] for p in flat for j in range(len(p) - 2)})
    units = ix.units.select(*ix.keys, "text")
    if own and ix.grams is not None:
        units = units.join(ix.holding([own]).filter(F.col("_g0") == len(own)).select(*ix.keys), list(ix.keys), "left_semi")
    return units.filter(T.has_entities(F.array(*(F.lit(p) for p in phrases)), "text")).select(*ix.keys)


def rank_pages(units: Index | DataFrame, question: str, k: int = 4, scope: Column | None = None, order: list[str] = ("doc_id", "page"), digits: int = 6) -> DataFrame:
    """The k best pages by BM25 and trigram scores, each as a share of the best; pages that hold the named phrases first.

    Only the pages that share something with the question are ranked; others, all of score 0, fill up what is left of k.
    """
    ix = Index.of(units)
    within = lambda df: df if scope is None else df.filter(scope)
    scored = _relevance(within(_touched(ix, question)), digits)
    named = _named(ix, question)
    columns = ("bm25", "coverage", "score", "fuzzy", "relevance")
    if named is None:
        scored = scored.select(*ix.keys, *columns, F.lit(True).alias("named"))
    else:
        scored = scored.join(within(named).withColumn("named", F.lit(True)), list(ix.keys), "full").select(*ix.keys, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns), F.coalesce("named", F.lit(False)).alias("named"))
    by = [F.desc("named"), F.desc("relevance"), *map(F.col, order)]
    best = scored.orderBy(*by).limit(k).collect()
    held = ix.units.sparkSession.createDataFrame(best, scored.schema)
    if len(best) < k:
        zeros = [F.lit(0.0).alias(c) for c in columns]
        rest = within(ix.units.select(*ix.keys)).join(F.broadcast(held.select(*ix.keys)), list(ix.keys), "left_anti")
        held = held.union(rest.select(*ix.keys, *zeros, F.lit(named is None).alias("named")).orderBy(*map(F.col, order)).limit(k - len(best)))
    return ix.rows(held, by)


def retrieve(pages: Index | DataFrame, chunks: Index | DataFrame, question: str, k_pages: int = 2, k_chunks: int = 3) -> DataFrame:
    """The best chunks inside the best pages: candidates by score, those with the named phrases first."""
    inner = Index.of(chunks, ("doc_id", "page", "chunk"))
    near = search(pages, question, k_pages * 4)
    named = T.has_entities(T.entities(F.lit(question)), "text")
    chosen = near.orderBy(F.desc(named), F.desc("score"), "doc_id", "page").limit(k_pages).select("doc_id", "page")
    scored, _ = _scored(inner, question)
    inside = scored.filter("bm25 > 0").drop("n_toks").join(F.broadcast(chosen), ["doc_id", "page"], "left_semi")
    by = [F.desc("score"), F.col("doc_id"), F.col("page"), F.col("chunk")]
    return inner.rows(inside.withColumn("score", F.round("score", 6)).orderBy(*by).limit(k_chunks), by)


def pending_pages(pages: Index | DataFrame, question: str | None = None, limit: int | None = None) -> DataFrame:
    """Unread pages of PDF and image documents; with a question the most relevant first."""
    ix = Index.of(pages)
    unread = F.col("kind").isin("pdf", "image") & F.col("source").isin("none", "scan-text")
    if question is None:
        out = ix.units.filter(unread).orderBy("doc_id", "page")
    else:
        ranked = _relevance(_touched(ix, question)).select(*ix.keys, F.col("relevance").alias("_r"))
        out = ix.units.filter(unread).join(ranked, list(ix.keys), "left").withColumn("relevance", F.coalesce("_r", F.lit(0.0))).drop("_r").orderBy(F.desc("relevance"), "doc_id", "page")
    out = out.drop("_uid")
    return out if limit is None else out.limit(limit)


def find_text(pages: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Pages that hold a string in any case, with an excerpt; the first `limit` in page order and the count of all."""
    at = F.locate(query.strip().lower(), F.lower(F.col("text")))
    hits = pages.withColumn("at", at).filter("at > 0")
    start = F.greatest(F.col("at") - 80, F.lit(1))
    cut = F.substring(F.col("text"), start, F.col("at") + F.lit(len(query.strip()) + 160) - start)
    total = hits.agg(F.count("*").alias("total"))
    return hits.withColumn("excerpt", cut).orderBy("doc_id", "page").limit(limit).crossJoin(F.broadcast(total))


#: Vectors, and queries, that are multiplied at once.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024


def _blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(size, ids, rows): up to `size` keys, largest first, nulls last, with their vectors of one length as packed doubles.

    Vectors that are null or hold nulls have no products and are left out.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            held: dict[int, list] = {}
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v")):
                own = v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else None
                if own is not None:
                    held.setdefault(len(own), []).append((k, own))
            for n, all_ in held.items():
                for a in range(0, len(all_), size):
                    part = sorted(all_[a : a + size], key=lambda r: (r[0] is not None, r[0]), reverse=True)
                    ids = pa.array([[k for k, _ in part]], pa.list_(batch.schema.field("k").type))
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), ids, pa.array([np.array([v for _, v in part], np.float64).tobytes()], pa.binary())], ["size", "ids", "rows"])

    return rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"size int, ids array<{kind}>, rows binary")


def _half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Values as Spark's round() gives them: by their decimal form, halves away from zero."""
    distinct, at = np.unique(values, return_inverse=True)
    step = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(x)).quantize(step, ROUND_HALF_UP)) if math.isfinite(x) else x for x in distinct.tolist()])[at]


def _best_products(k: int, digits: int, query_kind: pa.DataType, kind: pa.DataType):
    """For mapInArrow over (size, ids, rows, query_ids, query_rows): each query's k best of a block, as (query_id, vec_id, score).

    A matrix product finds what may be among them, within the rounding; those scores are added up component by component.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n, ids, query_ids = batch.column("size")[i].as_py(), batch.column("ids")[i].values, batch.column("query_ids")[i].values
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(len(own), n) for c, own in (("rows", ids), ("query_rows", query_ids)))
                with np.errstate(all="ignore"):
                    about = np.nan_to_num(x @ y.T, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                    slack = 2 * 10.0**-digits + 1e-12 * np.nan_to_num(np.abs(x).max(initial=0) * np.abs(y).max(axis=1, initial=0) * n, nan=np.inf, posinf=np.inf)
                    least = (np.partition(about, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(len(query_ids), -np.inf)) - slack
                    least[np.isnan(least)] = -np.inf
                    queries, own, scores = [], [], []
                    for j in range(len(query_ids)):
                        at = np.flatnonzero(about[:, j] >= least[j])
                        total = np.zeros(len(at))
                        for c in range(n):
                            total = total + x[at, c] * y[j, c]
                        total = _half_up(total, digits)
                        order = np.lexsort((at, np.where(np.isnan(total), 0, -total), ~np.isnan(total)))[:k]  # not-a-number is the largest
                        queries.append(np.full(len(order), j))
                        own.append(at[order])
                        scores.append(total[order])
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(np.concatenate(queries))).cast(query_kind), ids.take(pa.array(np.concatenate(own))).cast(kind), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return run


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = 3, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the k largest dot products with each query vector (query_id, q), ties by larger id.

    Blocks of vectors are dealt over PARTS parts, which blocks of queries are sent to; only a block's k best leave a task. Pairs of different lengths, or with
    nulls, have a null product and come last: only queries that find fewer than k others are paired with all vectors again.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = queries.schema["query_id"].dataType, vectors.schema["vec_id"].dataType
    asked = _blocks(queries, "query_id", "q", QUERY_BLOCK).select("size", F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"))
    parts = max(PARTS, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(parts, "size", "part")
    held = _blocks(vectors, "vec_id", "embedding", VECTOR_BLOCK).withColumn("part", F.pmod(F.xxhash64("rows"), F.lit(PARTS)).cast("int")).repartition(parts, "size", "part")
    tiles = held.join(asked, ["size", "part"]).select("size", "ids", "rows", "query_ids", "query_rows")
    shape = f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, score double"
    order = [F.desc("score"), F.desc("vec_id")]
    found = _written(top(tiles.mapInArrow(_best_products(k, digits, *map(to_arrow_type, kinds)), shape), ["query_id"], order, k), "products")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("_full"))
    short = queries.select("query_id", "q").join(full, F.col("query_id").eqNullSafe(F.col("_full")), "left_anti")
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rest = top(short.crossJoin(vectors.select("vec_id", "embedding")).select("query_id", "vec_id", F.round(dot, digits).alias("score")), ["query_id"], order, k)
    return found.join(full, F.col("query_id").eqNullSafe(F.col("_full")), "left_semi").union(rest)


def unread_counts(pages: Index | DataFrame) -> DataFrame:
    """Documents with their pages and those not read yet."""
    pages = Index.of(pages).units
    unread = F.col("kind").isin("pdf", "image") & F.col("source").isin("none", "scan-text")
    return pages.groupBy("doc_id", "kind").agg(F.count("*").alias("pages"), F.count_if(unread).alias("unread_pages"))


def unseen_terms(queries: DataFrame, units: Index | DataFrame) -> DataFrame:
    """(query_id, term): terms of queries (query_id, q) with no counterpart among the units' tokens.

    A counterpart is the term, or a token that begins with the term's stem, or with five letters of it, or four where it
    has no more than five: tokens count with their first three, four and five letters. Terms of five letters or more in
    -ed or -ing prove nothing. Only tokens and beginnings that some term asks for are exchanged.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(T.nfc("q")))).alias("term"))
    terms = terms.filter(~((F.length("term") > 4) & (F.col("term").endswith("ed") | F.col("term").endswith("ing"))))
    stem = T.stem("term")
    heads = F.array(stem, F.substring(stem, 1, 5), F.when(F.length(stem) <= 5, F.substring(stem, 1, 4)))
    asked = terms.select("term", F.explode(F.array_append(F.transform(heads, lambda h: F.struct(h.alias("part"), F.lit(True).alias("head"))), F.struct(F.col("term").alias("part"), F.lit(False).alias("head")))).alias("a"))
    asked = asked.select("term", "a.part", "a.head").filter("part is not null").distinct()
    parts = lambda t: F.array(F.struct(t.alias("part"), F.lit(False).alias("head")), *(F.struct(x.alias("part"), F.lit(True).alias("head")) for x in (t, *(F.substring(t, 1, k) for k in (3, 4, 5)))))
    there = document_frequencies(units).select(F.col("term").alias("t")).select(F.explode(F.array_distinct(parts(F.col("t")))).alias("p")).select("p.*")
    small = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    wanted = asked.select("part", "head").distinct()
    seen = there.join(F.broadcast(wanted) if small else wanted, ["part", "head"], "left_semi").distinct()
    return terms.join(asked.join(seen, ["part", "head"], "left_semi").select("term").distinct(), "term", "left_anti").select("query_id", "term")


#: The runs of characters that tokens are cut from, as they stand in a text.
RUN = W.TOKEN


def _words(units: Index | DataFrame) -> DataFrame:
    """(run): the distinct runs of token characters of all texts in lower case; a token stands in a text only inside a run."""
    if isinstance(units, Index) and units.runs is not None:
        return units.runs
    runs = F.regexp_extract_all(F.lower(F.col("text")), F.lit(RUN), F.lit(0))
    return Index.of(units).units.select(F.explode(F.array_distinct(runs)).alias("run")).distinct()


def _inside(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term): terms of four letters or more that stand inside some run: found by their first four characters, then compared."""
    asked = terms.filter(F.length("term") >= 4).select("term", F.substring("term", 1, 4).alias("head"))
    fours = F.transform(F.sequence(F.lit(1), F.length("run") - 3), lambda i: F.substr("run", i, F.lit(4)))
    held = words.filter(F.length("run") >= 4).select("run", F.explode(F.array_distinct(fours)).alias("head"))
    return held.join(asked, "head").filter(F.contains("run", F.col("term"))).select("term").distinct()


def _begun(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(term): terms that a token equals or begins with, in one of the forms that count: the term, its synonyms, its stem.

    Tokens count whole and with their first three, four and five letters. Only forms that some term asks for are exchanged.
    """
    synonyms = F.create_map(*(x for w, others in sorted(W.FORM_SYNONYMS.items()) for x in (F.lit(w), F.array(*map(F.lit, others)))))
    stem = T.stem("term")
    forms = F.concat(F.array(F.col("term"), stem, F.substring(stem, 1, 5), F.when(F.length(stem) <= 5, F.substring(stem, 1, 4))), F.coalesce(F.try_element_at(synonyms, F.col("term")), F.array().cast("array<string>")))
    asked = terms.select("term", F.explode(F.array_distinct(forms)).alias("part")).filter("part is not null")
    heads = F.array(F.col("token"), *(F.substring("token", 1, k) for k in (3, 4, 5)))
    held = tokens.select(F.explode(F.array_distinct(heads)).alias("part")).join(asked.select("part").distinct(), "part", "left_semi").distinct()
    return asked.join(held, "part", "left_semi").select("term").distinct()


#: Terms that tokens are compared with at once, and parts that the tokens of a length are dealt into where blocks aren't broadcast.
TERM_BLOCK, PARTS = 256, 64


def _spelt(terms: DataFrame, tokens: DataFrame, least: float, small: bool = True) -> DataFrame:
    """(term): terms of five letters or more that some token is spelt like: about as long, and of at least that ratio.

    Tokens are packed into lists of one length, terms into blocks for each length that they may be compared with. Lists meet
    the blocks of their length, which are broadcast if they are few; bounds by shared letters and pairs of letters lose
    no pair (functions.spelling).
    """
    asked = terms.filter(F.length("term") >= 5).select("term", F.explode(F.sequence(F.length("term") - 2, F.length("term") + 2)).alias("m"))
    places = asked.groupBy("m").agg(F.ceil(F.count("*") / TERM_BLOCK).alias("blocks"))
    blocks = asked.join(F.broadcast(places), "m").groupBy("m", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")).agg(F.collect_list("term").alias("terms"))
    near = tokens.withColumn("m", F.length("token")).join(F.broadcast(places.select("m")), "m", "left_semi")
    lists = near.select("token").mapInArrow(by_length, "m int, tokens array<string>")
    if small:
        pairs = lists.join(F.broadcast(blocks), "m")
    else:
        dealt = F.pmod(F.xxhash64("tokens"), F.lit(PARTS)).alias("part")
        pairs = lists.select("*", dealt).join(blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part")), ["m", "part"])
    return pairs.select("terms", "tokens").mapInArrow(spelt(least), "term string").distinct()


def _written(rows: DataFrame, name: str) -> DataFrame:
    """rows written in the application's folder and read again: a table that several steps read is made once."""
    folder = sinks.new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def absent_many(units: Index | DataFrame, queries: DataFrame, fuzzy_least: float | None = 0.82) -> DataFrame:
    """(query_id, term, idf, role): terms of queries (query_id, q) with no counterpart in the units.

    A counterpart is the term inside any text (four letters or more), a token or its first three to five letters, a
    synonym that forms use, the stem, or a token of about the same length and spelling. Verb forms prove nothing. Each
    distinct term is asked once; joins go over the distinct tokens and runs of the texts, never over the texts again. What
    is left after each step is written: the next one names it twice, and plans would double with each.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.tokens(T.nfc("q")))).alias("term"))
    tokens = document_frequencies(units)
    verbs = (F.length("term") > 4) & (F.col("term").endswith("ed") | F.col("term").endswith("ing"))
    terms = _written(wanted.select("term").distinct().filter(~verbs), "terms")
    names = tokens.select(F.col("term").alias("token"))
    left = _written(terms.join(_begun(terms, names), "term", "left_anti"), "terms")
    left = _written(left.join(_inside(left, _words(units)), "term", "left_anti"), "terms")
    if fuzzy_least is not None:
        small = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
        left = _written(left.join(_spelt(left, names, fuzzy_least, small), "term", "left_anti"), "terms")
    n = Index.of(units).total().select(F.greatest("n", F.lit(1)).alias("n"))
    weighed = left.join(tokens, "term", "left").crossJoin(F.broadcast(n)).select("term", idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf"))
    return wanted.join(weighed, "term").select("query_id", "term", "idf", F.col("term").isin(*sorted(W.ROLE_WORDS)).alias("role"))


def absent_shares(units: Index | DataFrame, queries: DataFrame, fuzzy_least: float | None = 0.82) -> DataFrame:
    """(query_id, share): how much of each query's weight, role words aside, is on terms without counterpart; 0 without units."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.tokens(T.nfc("q")))).alias("term")).filter(~F.col("term").isin(*sorted(W.ROLE_WORDS)))
    total = Index.of(units).total()
    df = document_frequencies(units).join(wanted.select("term").distinct(), "term", "left_semi")
    weights = wanted.join(df, "term", "left").crossJoin(F.broadcast(total.select("n"))).groupBy("query_id").agg(F.sum(F.when(F.col("n") > 0, idf(F.col("n"), F.coalesce("df", F.lit(0))))).alias("weight"))
    absent = absent_many(units, queries, fuzzy_least).filter("not role").groupBy("query_id").agg(F.sum("idf").alias("absent"))
    each = queries.select("query_id").distinct().join(weights, "query_id", "left").join(absent, "query_id", "left")
    share = F.when(F.coalesce("weight", F.lit(0.0)) > 0, F.coalesce("absent", F.lit(0.0)) / F.col("weight")).otherwise(0.0)
    return each.select("query_id", share.alias("share"))


def best_coverages(units: Index | DataFrame, queries: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(query_id, coverage): the largest share of each query's weight that one unit covers. scores as in best_of_many."""
    best = (scores_many(units, queries, list(Index.of(units).keys)) if scores is None else scores).groupBy("query_id").agg(F.max("coverage").alias("coverage"))
    return queries.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def abstain_many(units: Index | DataFrame, queries: DataFrame, pages: int | None = None, fuzzy_least: float | None = 0.82, scores: DataFrame | None = None) -> DataFrame:
    """(query_id, share, coverage, abstain): whether terms that are nowhere carry much of a query and no unit covers it.

    Not judged across scripts, for quoted labels on few pages, or for item numbers that the texts hold: the script is that
    of most letters of all texts, and all their tokens count. pages: of the documents that are asked; by default the units.
    scores as in best_of_many.
    """
    ix = Index.of(units)
    total = ix.total().select((F.col("n") if pages is None else F.lit(pages)).alias("_pages"))
    letters, own = T.letter_counts("text")
    share = F.coalesce(F.sum(own.cast("long")), F.lit(0)) / F.greatest(F.sum(letters.cast("long")), F.lit(1))
    script = ix.units.agg((share >= 0.5).alias("_bengali"))
    # As many as item_refs can name: at most 12,100 of one or two digits on each side.
    items = document_frequencies(ix).filter(F.col("term").rlike(r"^[0-9]{1,2}\.[0-9]{1,2}$")).agg(F.collect_set("term").alias("_items"))
    refs = T.item_refs(F.col("q"))
    exempt = (
        ((T.bengali_share("q") >= 0.5) != F.col("_bengali")) | (F.col("q").rlike(r"['\"][^'\"]{2,40}['\"]") & (F.col("_pages") < W.BIG_CORPUS_PAGES))
        | ((F.size(refs) > 0) & F.forall(refs, lambda r: F.array_contains("_items", r)))
    )
    judged = queries.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(script)).crossJoin(F.broadcast(items)).select("query_id", F.coalesce(exempt, F.lit(False)).alias("exempt"))
    shares = absent_shares(ix, queries, fuzzy_least)
    each = judged.join(shares, "query_id").join(best_coverages(ix, queries, scores), "query_id")
    abstain = ~F.col("exempt") & (F.col("share") >= W.ABSENT_SHARE) & (F.col("coverage") < W.ABSTAIN_COVERAGE)
    return each.select("query_id", "share", "coverage", abstain.alias("abstain"))


def _one(units: Index | DataFrame, question: str) -> DataFrame:
    return Index.of(units).units.sparkSession.createDataFrame([(0, question)], "query_id int, q string")


def absent_terms(units: Index | DataFrame, question: str, fuzzy_least: float = 0.82) -> DataFrame:
    """(term, idf, role): a question's terms with no counterpart in the units (see absent_many)."""
    return absent_many(units, _one(units, question), fuzzy_least).drop("query_id")


def absent_share(units: Index | DataFrame, question: str) -> float:
    """Share of the question's weight, role words aside, on terms without counterpart."""
    return absent_shares(units, _one(units, question)).first().share


def should_abstain(units: Index | DataFrame, question: str, pages: int | None = None) -> bool:
    """abstain_many for one question."""
    return abstain_many(units, _one(units, question), pages).first().abstain


def page_evidence(pages: DataFrame, question: str, room: int = W.SHORT_PAGE, k: int = 2, span: int = 420) -> DataFrame:
    """(doc_id, page, score, evidence): a short page whole, else its k best sentences with their neighbours."""
    short = F.length("text") <= min(W.SHORT_PAGE, room)
    whole = pages.filter(short).select("doc_id", "page", F.lit(1.0).alias("score"), F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n")).alias("evidence"))
    terms = list(dict.fromkeys(T.tokens_of(question)))
    stats = pages.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"), *(F.coalesce(F.sum(F.array_contains("toks", t).cast("int")), F.lit(0)).alias(f"_d{i}") for i, t in enumerate(terms)))
    weights = [idf(F.col("_n"), F.col(f"_d{i}")) for i in range(len(terms))]
    total = sum(weights, F.lit(0.0))
    units = pages.filter(~short).crossJoin(F.broadcast(stats)).withColumn("units", T.sentences("text"))
    # What a term is found by: a sentence without any of these has no token of it, and is not cut into tokens.
    signs = sorted({t if len(t) < 5 else t[:4] for t in terms})
    plain = not any(c.isdigit() for t in signs for c in t)

    def cut(u: Column) -> Column:
        toks = T.tokens(u)
        if plain and signs:
            low = F.lower(u)
            toks = F.when(reduce(lambda x, y: x | y, (F.contains(low, F.lit(g)) for g in signs)), toks).otherwise(F.array().cast("array<string>"))
        return F.struct(toks.alias("toks"), F.least(F.length(u), F.lit(300)).alias("long"))

    def headed(v: Column) -> Column:
        heads = F.transform(F.filter(v["toks"], lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 4))
        return F.struct(v["toks"].alias("toks"), heads.alias("heads"), v["long"].alias("long"))

    def scored(v: Column, i: Column) -> Column:
        holds = lambda t: F.array_contains(v["toks"], t) if len(t) < 5 else F.array_contains(v["toks"], t) | F.array_contains(v["heads"], t[:4])
        cover = sum((F.when(holds(t), w).otherwise(F.lit(0.0)) for t, w in zip(terms, weights, strict=True)), F.lit(0.0)) / F.when(total == 0, F.lit(1.0)).otherwise(total)
        score = (cover if terms else F.lit(0.0)) + F.lit(0.001) * v["long"]
        return F.struct((-score).alias("down"), (-i).alias("back"), i.alias("i"), score.alias("score"))

    # A page's sentences are judged in its row, so only pages pass from step to step.
    picks = F.slice(F.array_sort(F.transform(F.transform(F.transform("units", cut), headed), scored)), 1, k)
    gathered = units.withColumn("picks", picks).select("doc_id", "page", "units", "picks")
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<i:int,score:double>>").alias("kept"))
    fold = F.aggregate(
        "picks", start,
        lambda s, p: F.when((p["score"] < 0.05) | F.array_contains(s["used"], p["i"]), s).otherwise(
            F.struct(
                F.concat(s["used"], F.array(p["i"] - 1, p["i"], p["i"] + 1)).alias("used"),
                F.concat(s["kept"], F.array(F.struct(p["i"].alias("i"), p["score"].alias("score")))).alias("kept"),
            )
        ),
        lambda s: s["kept"],
    )
    parts = gathered.select("doc_id", "page", "units", F.explode(fold).alias("p"))
    first = F.greatest(F.col("p.i"), F.lit(1))
    text = F.array_join(F.slice("units", first, F.col("p.i") + 2 - first + 1), " | ")
    return whole.union(parts.select("doc_id", "page", F.col("p.score").alias("score"), F.substring(text, 1, span).alias("evidence")))
