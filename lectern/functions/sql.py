"""The engine's functions for SQL: scalar ones and tables that Catalyst sees through, and Python tables where rules fold over rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import readers
from . import words as W

# What SQL itself expresses, as temporary functions: their bodies are inlined, so filters and unused columns are pushed through.
_LINES = r"filter(transform(split(coalesce(body, ''), '\r\n|[\n\r\u000b\u000c]'), x -> regexp_replace(x, '^\\s+|\\s+$', '')), x -> length(x) > 0)"
FUNCTIONS = {
    "lectern_content_id": "(content STRING) RETURNS STRING RETURN substr(sha1(content), 1, 16)",
    "lectern_same_value": r"(a STRING, b STRING) RETURNS BOOLEAN RETURN regexp_replace(lower(a), '[\\s,.]', '') = regexp_replace(lower(b), '[\\s,.]', '')",
    "lectern_support": "(answer ARRAY<STRING>, evidence ARRAY<STRING>) RETURNS DOUBLE RETURN CASE WHEN size(answer) > 0 THEN size(filter(answer, w -> array_contains(evidence, w))) / CAST(size(answer) AS DOUBLE) ELSE 0D END",
    "lectern_lines": f"(body STRING) RETURNS TABLE(page INT, n INT, line STRING) RETURN SELECT CAST(pos DIV {W.LINES_PER_PAGE} + 1 AS INT), CAST(pos % {W.LINES_PER_PAGE} AS INT), col FROM (SELECT posexplode({_LINES}))",
}


class Chunks:
    """(page, chunk, chunk_text): a text's lines by pages, gathered until they hold a chunk's characters."""

    def eval(self, body: str) -> Iterator[tuple[int, int, str]]:
        import re

        lines = [x for x in (re.sub(r"^\s+|\s+$", "", x) for x in re.split("\r\n|[\n\r\x0b\x0c]", body or "")) if x]
        for begin in range(0, len(lines), W.LINES_PER_PAGE):
            part, size, number = [], 0, 0
            for line in lines[begin : begin + W.LINES_PER_PAGE]:
                part.append(line)
                size += len(line)
                if size >= W.CHUNK_TARGET:
                    yield begin // W.LINES_PER_PAGE + 1, number, " ".join(part)
                    part, size, number = [], 0, number + 1
            if part:
                yield begin // W.LINES_PER_PAGE + 1, number, " ".join(part)


class Receipt:
    """(n, label, means, own, first, last): the rows of a receipt, what each stands for and its amounts."""

    def eval(self, body: str) -> Iterator[tuple]:
        for n, row in enumerate(readers.parse_receipt(body or "")):
            yield n, row["label"], ",".join(row["means"]), row["own"], row["first"], row["last"]


TABLES = {
    "lectern_chunks": (Chunks, "page int, chunk int, chunk_text string"),
    "lectern_receipt": (Receipt, "n int, label string, means string, own boolean, first string, last string"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; their names. Null texts are taken as empty."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, (table, shape) in TABLES.items():
        spark.udtf.register(name, udtf(table, returnType=shape))
    return [*FUNCTIONS, *TABLES]
