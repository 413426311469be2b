"""Text functions as Column expressions; none of them leaves the JVM, but nfc for texts that need it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import words as W


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ci(pattern: str) -> str:
    return "(?i)" + pattern


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """Canonical composition. Only texts with characters from U+0300 on are sent to Python; below all are composed."""
    text = _col(text)
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\u02ff]"), text)), text)


def tokens(text: Column | str) -> Column:
    """Lower-case tokens without stop words and single characters; accented Latin letters separate. Null has none.

    The text should be composed (see nfc).
    """
    found = F.regexp_extract_all(F.translate(F.lower(_col(text)), W.BN_DIGITS, W.ASCII_DIGITS), F.lit(W.TOKEN), F.lit(0))
    cut = F.transform(found, lambda w: F.btrim(w, F.lit(W.TOKEN_EDGE)))
    return F.coalesce(F.filter(cut, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(W.STOP))), F.array().cast("array<string>"))


def tokens_of(text: str) -> list[str]:
    """The same for a text of the driver, such as a question."""
    low = unicodedata.normalize("NFC", text).lower().translate(str.maketrans(W.BN_DIGITS, W.ASCII_DIGITS))
    cut = (w.strip(W.TOKEN_EDGE) for w in re.findall(W.TOKEN, low))
    return [w for w in cut if len(w) > 1 and w not in W.STOP]


def stem(word: Column | str) -> Column:
    word = _col(word)
    out = word
    for suffix, least in reversed(W.SUFFIXES):
        cut = F.length(word) - len(suffix)
        out = F.when(word.endswith(suffix) & (cut >= least), F.substring(word, F.lit(1), cut)).otherwise(out)
    return out


def stem_of(word: str) -> str:
    return next((word[: -len(s)] for s, least in W.SUFFIXES if word.endswith(s) and len(word) - len(s) >= least), word)


def windows(text: Column | str, size: int = W.GATEWAY_SIZE, overlap: int = W.GATEWAY_OVERLAP) -> Column:
    """Overlapping pieces of a text whose white space is collapsed; an empty text has none."""
    flat = F.btrim(F.regexp_replace(_col(text), r"\s+", " "))
    starts = F.sequence(F.lit(0), F.greatest(F.length(flat) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(flat) > 0, F.transform(starts, lambda i: F.substring(flat, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column | str) -> Column:
    """Pieces between blank lines, and inside those after . ! or ? and white space."""
    parts = F.flatten(F.transform(F.split(_col(text), "\n\n"), lambda b: F.split(b, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)


def entities(question: Column | str) -> Column:
    """Runs of two or more capitalised words that don't begin with a question word."""
    found = F.regexp_extract_all(_col(question), F.lit(r"(?<![A-Za-z])[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+)+"), F.lit(0))
    return F.filter(found, lambda e: ~F.regexp_extract(e, r"^(\S+)", 1).isin(*W.QUESTION_WORDS))


def has_entities(found: Column, text: Column | str) -> Column:
    """Whether a text holds all phrases, in any case; with no phrase it does."""
    low = F.lower(_col(text))
    return F.forall(found, lambda e: F.contains(low, F.lower(e)))


def bengali_share(text: Column | str) -> Column:
    """Share of Bengali characters among the letters; 0 without letters."""
    text = _col(text)
    return F.regexp_count(text, F.lit(rf"(?=\p{{L}})[{W.BENGALI}]")) / F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))


def letter_counts(text: Column | str) -> tuple[Column, Column]:
    """How many letters a text has, and how many of them are Bengali; both 0 for null. What bengali_share is made of, for sums."""
    own = F.regexp_replace(_col(text), r"\P{L}+", "")
    return tuple(F.coalesce(F.length(x), F.lit(0)) for x in (own, F.regexp_replace(own, rf"[^{W.BENGALI}]+", "")))


def script_mismatch(question: Column | str, text: Column | str) -> Column:
    return (bengali_share(question) >= 0.5) != (bengali_share(text) >= 0.5)


def item_refs(question: Column | str) -> Column:
    """Numbers such as 1.7 in a question that has an item word."""
    q = F.translate(_col(question), W.BN_DIGITS, W.ASCII_DIGITS)
    found = F.regexp_extract_all(q, F.lit(r"(?<![\d.])\d{1,2}\.\d{1,2}(?![\d.])"), F.lit(0))
    return F.when(_col(question).rlike(_ci(W.ITEM_WORD)), found).otherwise(F.array().cast("array<string>"))


def fix_dates(text: Column | str) -> Column:
    """A second slash that was read as a digit, letter or bar is put back."""
    return F.regexp_replace(_col(text), r"\b(\d{1,2})/(\d{2})[12lI|](20\d\d)\b", "$1/$2/$3")


def find_date(text: Column | str) -> Column:
    """The first day, month and year with a real day and month, with slashes."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(?<!\d)\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*(?:\d{4}|\d{2})(?!\d)"), F.lit(0))
    dates = F.transform(found, lambda d: F.regexp_replace(F.regexp_replace(d, r"\s+", ""), r"[.\-]", "/"))
    day, month = (lambda d, k=k: F.element_at(F.split(d, "/"), k).cast("int") for k in (1, 2))
    return F.get(F.filter(dates, lambda d: day(d).between(1, 31) & month(d).between(1, 12)), F.lit(0))


def find_number(text: Column | str, least: int = 3) -> Column:
    """The number with most digits, the first in a tie, with `least` digits or more."""
    found = F.regexp_extract_all(_col(text), F.lit(r"\d[\d,.]*"), F.lit(0))
    count = lambda w: F.length(F.regexp_replace(w, r"\D", ""))
    longest = F.aggregate(
        F.filter(found, lambda w: count(w) >= least), F.lit(None).cast("string"),
        lambda best, w: F.when(best.isNull() | (count(w) > count(best)), w).otherwise(best),
    )
    return F.rtrim(longest, F.lit(",."))


def extract_value(kind: Column | str, text: Column | str) -> Column:
    kind = _col(kind)
    return F.when(kind == "date", find_date(text)).when(kind == "amount", find_number(text, 3)).when(kind == "number", find_number(text, 1))


def same_value(a: Column | str, b: Column | str) -> Column:
    """Equal but for case, white space, commas and points; nothing equals an empty value."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"[\s,.]", "")
    a, b = _col(a), _col(b)
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (bare(a) == bare(b)), F.lit(False))


def kind_of(question: Column | str) -> Column:
    q = _col(question)
    return F.when(q.rlike(_ci(W.DATE_Q)), "date").when(q.rlike(_ci(W.MONEY_Q)), "amount").when(q.rlike(_ci(W.NUMBER_Q)), "number").otherwise("word")


def question_class(question: Column | str) -> Column:
    q = _col(question)
    open_ = q.rlike(_ci(W.META_Q)) | q.rlike(_ci(W.EXTRACT_Q))
    return F.when(q.rlike(_ci(W.VISUAL_Q)), "visual").when(open_, "open").when(q.rlike(_ci(W.LIST_Q)), "list").otherwise("lookup")


def tidy_amount(value: Column | str) -> Column:
    """Spaces inside a number go, as does the one after a currency sign."""
    v = F.regexp_replace(F.btrim(_col(value)), r"(?<=[.,]) (?=\d)", "")
    v = F.regexp_replace(v, r"(?<=\d) (?=\d{3}(?!\d))", "")
    return F.regexp_replace(v, r"^([$€£]) (?=\d)", "$1")


def only_digits(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), r"[^0-9]", "")


def label_key(value: Column | str) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(_col(value)), "[^a-z0-9]", "")


def amounts(text: Column | str) -> Column:
    """Money-looking numbers of a row as written; bare numbers of one or two digits are quantities."""
    found = F.transform(F.regexp_extract_all(_col(text), F.lit(_ci(W.MONEY)), F.lit(0)), lambda m: F.btrim(m))
    return F.filter(found, lambda m: ~m.rlike(r"^\d{1,2}$"))


def is_legacy(text: Column | str) -> Column:
    """Text of a legacy Bengali font: no Bengali character, and many of the glyphs that only such fonts use."""
    text = _col(text)
    glyphs, letters = F.regexp_count(text, F.lit(f"[{W.LEGACY_SIGNATURE}]")), F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))
    return F.coalesce(~text.rlike(f"[{W.BENGALI}]") & (glyphs >= W.LEGACY_LEAST) & (glyphs / letters >= W.LEGACY_SHARE), F.lit(False))


def estimate_tokens(texts: Column, images: Column | int = 0) -> Column:
    """Rough prompt size: characters by 3.2 and 4 for each text, 350 for each image."""
    images = F.lit(images) if isinstance(images, int) else images
    total = F.aggregate(texts, F.lit(0.0), lambda s, t: s + F.length(t) / F.lit(3.2) + F.lit(4.0))
    return F.floor(total + images * 350).cast("long")


def support(answer: Column | str, evidence: Column | str, question: Column | str) -> Column:
    """Share of the answer's tokens, those of the question aside, that the evidence holds; repeats count, 0 without any."""
    # Variables of lambdas are evaluated once; inside a lambda, an expression is evaluated for each element.
    texts = F.array(F.struct(tokens(answer).alias("a"), tokens(question).alias("q"), tokens(evidence).alias("known")))
    parts = F.transform(texts, lambda s: F.struct(F.filter(s["a"], lambda w: ~F.array_contains(s["q"], w)).alias("own"), s["known"].alias("known")))
    share = lambda s: F.size(F.filter(s["own"], lambda w: F.array_contains(s["known"], w))) / F.size(s["own"])
    return F.get(F.transform(parts, lambda s: F.when(F.size(s["own"]) > 0, share(s)).otherwise(F.lit(0.0))), F.lit(0))


def normal(value: Column | str) -> Column:
    """Lower case without white space and commas."""
    return F.regexp_replace(F.lower(_col(value)), r"[\s,]", "")


def csv_cell(value: Column | str) -> Column:
    """A cell that a spreadsheet won't run as a formula; null becomes empty."""
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    return F.when(text.rlike(r"^\s*[=+@-]") | text.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)
