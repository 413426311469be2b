"""Judging URLs by pattern rules that are found through their rarest literal token; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._joins import common_keys, salted_join

#: Rules that are kept in the plan as a literal map; more of them are joined by token.
INLINE_RULES = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs whose host and path match pattern, a Java regular expression searched in them.

    tokens: runs of ASCII letters and digits, each of which stands whole, between other characters or the ends, in
    every match. A rule without one is tried on every URL.
    """

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains, and for paths that start with path; the longer host and path win."""
    tokens = re.findall(_TOKEN, host) + re.findall(_TOKEN + r"(?=[^A-Za-z0-9])", path)
    pattern = f"^(?:[^/]*\\.)?{_quoted(host)}{_quoted(path)}" if path.startswith("/") else f"^(?:[^/]*\\.)?{_quoted(host)}(?=/|$){_quoted(path)}"
    return Rule(host + path, pattern, verdict, tuple(dict.fromkeys(tokens)), len(host + path))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for URLs that hold a word between other characters; under every host rule."""
    return Rule(f"word:{word}", f"(?<![A-Za-z0-9]){_quoted(word)}(?![A-Za-z0-9])", verdict, tuple(re.findall(_TOKEN, word)), 0)


def _quoted(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9/]", lambda m: "\\" + m[0], text)


HOST_RULES = (
    host_rule("com", "/", "allow"),
    host_rule("example.com", "/en/", "block"),
    host_rule("www.example.com", "/en/", "allow"),
    host_rule("net", "/es/", "block"),
    host_rule("net", "/fr/", "block"),
)
#: What the method itself blocks where no host rule fits.
WORD_RULES = tuple(word_rule(w) for w in ("spam", "casino", "porn", "xxx", "warez", "viagra"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[Rule, ...] = HOST_RULES,
    word_rules: tuple[Rule, ...] = WORD_RULES,
    default: str = "allow",
    inline: int = INLINE_RULES,
) -> DataFrame:
    """Rows (id, host, path, rule, verdict, word_rule); rule is null where no host rule fits.

    Of the rules that fit, the one of highest rank decides (equal ranks: the later name by code point). Where none
    fits, the word rules do, else default. Each rule is filed under the one of its tokens that fewest URLs hold; a
    URL's tokens fetch the rules filed under them, and only their expressions are run. Up to `inline` rules lie in the
    plan itself, so that there is no shuffle; more are joined by token to the distinct URLs.

    Null url or one without ://: host and path empty. Repeated rows: a row each. Empty table: no rows. Other columns
    of pages are left out.
    """
    every = [(r, False) for r in rules] + [(r, True) for r in word_rules]
    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    place = F.concat("host", "path")
    tokens = F.array_distinct(F.regexp_extract_all(place, F.lit(_TOKEN), F.lit(0)))
    if len(every) <= inline:
        filed = _filed(own.select(tokens.alias("t")), every)
        judged = own.withColumn("found", _inline(tokens, place, filed))
        return _verdicts(judged, id_col, default)
    spark = pages.sparkSession
    listed = spark.createDataFrame(
        [(r.name, r.pattern, r.verdict, list(r.tokens), r.rank, w) for r, w in every],
        "name string, pattern string, verdict string, tokens array<string>, rank int, word boolean",
    )
    urls = own.select(place.alias("place")).distinct()
    at = urls.select("place", F.explode(F.array_distinct(F.regexp_extract_all("place", F.lit(_TOKEN), F.lit(0)))).alias("token"))
    wanted = listed.select("name", "pattern", "verdict", "rank", "word", F.explode("tokens").alias("token"))
    counts = at.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("name", "pattern", "verdict", "rank", "word").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("t"))).alias("token")
    )
    loose = [(r, w) for r, w in every if not r.tokens]
    # A rule whose rarest literal is common all the same meets its URLs in several tasks.
    common = common_keys(counts, "token", "n", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hits = salted_join(at, rarest, "token", common).filter(F.expr("place rlike pattern")).groupBy("place").agg(
        F.max(F.when(~F.col("word"), F.struct("rank", "name", "verdict"))).alias("host"),
        F.max(F.when(F.col("word"), F.struct("rank", "name", "verdict"))).alias("word"),
    )
    kind = "struct<host: struct<rank: int, name: string, verdict: string>, word: struct<rank: int, name: string, verdict: string>>"
    found = hits.select(F.col("place").alias("at"), F.struct("host", "word").cast(kind).alias("hit"))
    tried = _inline(F.array().cast("array<string>"), place, {"": loose})
    judged = own.join(found, place == F.col("at"), "left").withColumn("tried", tried)
    judged = judged.withColumn(
        "found",
        F.struct(
            F.greatest(F.col("hit.host"), F.col("tried.host")).alias("host"), F.greatest(F.col("hit.word"), F.col("tried.word")).alias("word")
        ),
    )
    return _verdicts(judged, id_col, default)


def _filed(held: DataFrame, every: list[tuple[Rule, bool]]) -> dict[str, list[tuple[Rule, bool]]]:
    """The rules by the token that fewest URLs hold; under "" those without one. One count over the URLs."""
    known = sorted({t for r, _ in every for t in r.tokens})
    counts = held.agg(*(F.count_if(F.array_contains("t", t)).alias(f"c{i}") for i, t in enumerate(known))).first() if known else ()
    rarity = dict(zip(known, counts, strict=True))
    filed: dict[str, list[tuple[Rule, bool]]] = {}
    for rule, word in every:
        filed.setdefault(min(rule.tokens, key=lambda t: (rarity[t], t), default=""), []).append((rule, word))
    return filed


def _inline(tokens: Column, place: Column, filed: dict[str, list[tuple[Rule, bool]]]) -> Column:
    """struct(host, word): the best rules of each sort; an expression runs only if its rule's token is there."""
    best = {}
    for sort in (False, True):
        fits = []
        for token, rules in sorted(filed.items()):
            for rule, word in rules:
                if word == sort:
                    hit = place.rlike(rule.pattern)
                    hit = F.array_contains(tokens, token) & hit if token else hit
                    fits.append(F.when(hit, F.struct(F.lit(rule.rank).alias("rank"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))))
        none = F.lit(None).cast("struct<rank: int, name: string, verdict: string>")
        best[sort] = F.greatest(none, none, *fits)
    return F.struct(best[False].alias("host"), best[True].alias("word"))


def _verdicts(judged: DataFrame, id_col: str, default: str) -> DataFrame:
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("found.host.name").alias("rule"),
        F.coalesce("found.host.verdict", "found.word.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("found.host").isNull(), F.col("found.word.name")).alias("word_rule"),
    )
