"""Documents, pages and chunks from tables and files."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W

IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
PAGES = "doc_id string, name string, kind string, page int, source string, lines array<string>"


def content_id(content: Column) -> Column:
    return F.substring(F.sha1(content), 1, 16)


def kind_of_name(name: Column) -> Column:
    """pdf, image, docx or text, by the extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin(*IMAGES), "image").when(ext == "docx", "docx").otherwise("text")


def lines_of(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c]")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 0)


def paginate(docs: DataFrame, lines: Column, per: int = W.LINES_PER_PAGE) -> DataFrame:
    """docs with page and lines, `per` lines a page; a document without lines has one empty page. No shuffle."""
    count = F.greatest(F.ceil(F.size("_lines") / per), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("_lines", i * per + 1, per))
    return docs.withColumn("_lines", lines).select("*", F.posexplode(parts).alias("_pos", "lines")).withColumn("page", F.col("_pos") + 1).drop("_lines", "_pos")


def page_text(lines: Column | str = "lines") -> Column:
    """Lines joined with a blank line, which marks the end of a block."""
    return F.array_join(lines, "\n\n")


def page_source(text_chars: Column, scan_ratio: Column, least_chars: int = 40, scanned: float = 0.6) -> Column:
    """text, scan-text (a page that is mostly one image, so its text layer is another reader's) or none."""
    return F.when(text_chars < least_chars, "none").when(scan_ratio >= scanned, "scan-text").otherwise("text")


def pages_of_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, page, source, lines) of a table of texts."""
    return paginate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), lines_of(F.col("_text"))).select(
        "doc_id", "page", F.lit("text").alias("source"), "lines"
    )


def chunks_of(pages: DataFrame, target: int = W.CHUNK_TARGET) -> DataFrame:
    """pages with chunk and chunk_text: lines are gathered until they hold `target` characters. A fold over each page."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def add(s, line):
        n, lines = s["n"] + F.length(line), F.concat(s["open"], F.array(line))
        full = n >= target
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(lines))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(lines).alias("open"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"),
        )

    chunks = F.aggregate("lines", start, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return pages.select("*", F.posexplode(chunks).alias("chunk", "_part")).withColumn("chunk_text", F.array_join("_part", " ")).drop("_part")


def first_copies(docs: DataFrame, content: Column, order: str) -> DataFrame:
    """One row for each content, the first by `order`; found by an aggregate with partial results, not a window."""
    keyed = docs.withColumn("content_id", content_id(content))
    first = keyed.groupBy("content_id").agg(F.min(order).alias(order))
    return keyed.join(first, ["content_id", order], "left_semi")


def overlay_cache(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages with lines from a cache of earlier readings (doc_id, page, lines), whose source is then ocr."""
    held = cache.select("doc_id", "page", F.col("lines").alias("_cached"))
    joined = pages.join(held, ["doc_id", "page"], "left")
    return joined.withColumn("source", F.when(F.col("_cached").isNotNull(), "ocr").otherwise(F.col("source"))).withColumn("lines", F.coalesce("_cached", "lines")).drop("_cached")


#: A page of fewer characters than this has no text layer of use.
LEAST_CHARS = 40


def pages_of_contents(files: DataFrame, decode_pdf: Callable[[bytes], list[list[str]]] | None = None) -> DataFrame:
    """Pages of files (path, content): text of any kind, DOCX, images (one unread page) and, with a decoder, PDF.

    Contents are read by the executors. decode_pdf gives the lines of each page; their white space is collapsed, and a
    page with less than LEAST_CHARS characters is unread. Without a decoder a PDF is one unread page.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for where, content in zip(pdf["path"], pdf["content"]):
                name = where.rsplit("/", 1)[-1]
                ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                kind = "image" if ext in IMAGES else ext if ext in ("pdf", "docx") else "text"
                if kind == "image" or kind == "pdf" and decode_pdf is None:
                    pages = [("none", [])]
                elif kind == "pdf":
                    read = [[x for x in (" ".join(line.split()) for line in page) if x] for page in decode_pdf(content)]
                    pages = [("text" if sum(map(len, page)) >= LEAST_CHARS else "none", page) for page in read]
                else:
                    lines = docx_lines(content) if kind == "docx" else content.decode("utf-8", "ignore").splitlines()
                    lines = [x.strip() for x in lines if x.strip()]
                    pages = [("text", lines[i : i + W.LINES_PER_PAGE]) for i in range(0, len(lines), W.LINES_PER_PAGE)] or [("text", [])]
                key = hashlib.sha1(content).hexdigest()[:16]
                out += [(key, name, kind, i + 1, source, lines) for i, (source, lines) in enumerate(pages)]
            yield pd.DataFrame(out, columns=["doc_id", "name", "kind", "page", "source", "lines"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def read_files(spark: SparkSession, path: str, decode_pdf: Callable[[bytes], list[list[str]]] | None = None) -> DataFrame:
    """Pages of the files of a folder (see pages_of_contents)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # The reader passes over files without bytes; each is a document of one empty page.
    short = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    read = files.select(short(F.col("path")).alias("_read"))
    empty = listed.join(read, short(F.col("path")) == F.col("_read"), "left_anti").select("path", F.lit(bytearray()).alias("content"))
    return pages_of_contents(files.unionByName(empty), decode_pdf)


def gateway_texts(files: DataFrame, decode_pdf: Callable[[bytes], list[list[str]]]) -> DataFrame:
    """(path, text) of files (path, content) for retrieval: the decoded pages of a PDF, else UTF-8; nothing is recognised."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else "\n".join("\n".join(page) for page in decode_pdf(c)))

    plain = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.when(F.lower("path").endswith(".pdf"), decoded(F.when(F.lower("path").endswith(".pdf"), F.col("content")))).otherwise(F.coalesce(plain, F.make_valid_utf8(F.col("content").cast("string"))))
    return files.select("path", text.alias("text"))


# What an upload does with pages that must be recognised, and how many at most.
MODES, MOST_PAGES = ("background", "lazy", "all"), 60


def upload_plan(counts: DataFrame, mode: Column, page_limit: Column, most: int = MOST_PAGES) -> DataFrame:
    """counts (unread_pages) with read_now, in_background and still_unread by upload mode.

    all reads up to `most` pages at once, background as many after the upload, within the session's limit of pages; lazy
    leaves them until a question needs them. Other modes: null.
    """
    known = mode.isin(*MODES)
    now = F.when(mode == "all", F.least("unread_pages", F.lit(most))).when(known, F.lit(0)).cast("long")
    left = F.col("unread_pages") - now
    later = F.when(mode == "background", F.least(F.lit(most), left, page_limit)).when(known, F.lit(0)).cast("long")
    return counts.withColumn("read_now", now).withColumn("in_background", later).withColumn("still_unread", left)


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs of a DOCX file without their markup."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "ignore")
    return [re.sub(r"<[^>]+>", "", p) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)]


def latest(rows: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The last `keep` rows of each group."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")
