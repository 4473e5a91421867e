"""Text sources: files, transcripts, discovery and choice between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import regexes as rx
from lectern.functions import text as tx

# Notes of results.
TEXT_NOTE = "Used text-only fallback. Swap in OCR backends for real scans."
PAGE_NOTE = "Page %d: no OCR lines found; check scan quality or OCR backend availability."
TEXT_BACKEND = "text-fallback"


@F.pandas_udf(T.StringType())
def utf8_ignoring_errors(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore").strip())


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"source_name": name, "stem": F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "suffix": F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, source_name, stem, suffix, content of every file."""
    return _named(spark.read.format("binaryFile").load(path).select("path", "content"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_files`` without the contents, which are not read."""
    return _named(spark.read.format("binaryFile").load(path).select("path"))


def transcripts(files: DataFrame) -> DataFrame:
    """source_name, text: UTF-8 with undecodable bytes dropped, stripped."""
    return files.select("source_name", utf8_ignoring_errors("content").alias("text"))


def text_lines(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Lines of plain text as OCR would give them: page 1, no bbox, no confidence; blanks dropped."""
    lines = docs.select(*keep, F.posexplode(F.split(text, rx.LINE)).alias("line_no", "text")).withColumn("text", tx.strip(F.col("text"))).filter("text <> ''")
    return lines.select(*keep, F.lit(1).alias("page_number"), "line_no", "text", F.lit(None).cast("array<int>").alias("bbox"), F.lit(None).cast("double").alias("confidence"))


#: Bytes of a part of documents that are dealt out before they are split into words.
PART_BYTES = 4 << 20


def dealt(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` by ``key`` in small parts: what is split off later lies with its document, in parts that are sorted in memory."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Tables of unknown size report an absurd one.
    return docs.repartition(max(least, -(-size // PART_BYTES)) if size < 1 << 58 else least, key)


def clean_lines(lines: DataFrame, compatibility: bool = True) -> DataFrame:
    return lines.withColumn("text", tx.normalize_text(F.col("text"), compatibility)).filter("text <> ''")


def clean_text_lines(docs: DataFrame, *keep: str, compatibility: bool = True) -> DataFrame:
    """As ``clean_lines`` of the ``text_lines`` of texts.

    Compatibility forms neither make nor take a line's end and join nothing across it, so a text
    takes them as a whole: a row for each text goes to Python, not one for each line.
    """
    whole = docs.select(*keep, (tx.nfkc(F.col("text")) if compatibility else F.col("text")).alias("text"))
    return clean_lines(text_lines(whole, *keep), compatibility=False)


def first_pdf(files: DataFrame) -> DataFrame:
    """The first PDF of each folder by path; a folder without one has no row."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.filter("suffix = '.pdf'").groupBy(folder.alias("folder")).agg(F.min("path").alias("path"))


def choose_transcripts(files: DataFrame, pdfs: DataFrame) -> DataFrame:
    """folder, path of the transcript of each folder: one that shares the PDF's stem, else one that says so, else the first."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    named = files.filter(F.col("suffix").isin(".txt", ".md")).withColumn("folder", folder)
    pdf_stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    rows = named.join(pdfs.select("folder", pdf_stem.alias("pdf")), "folder", "left")
    related = F.coalesce(F.col("stem").contains(F.col("pdf")) | F.col("pdf").contains(F.col("stem")), F.lit(False))
    priority = F.when(related, 0).when(F.col("stem").rlike("transcript|clean"), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(priority, F.when(F.col("suffix") == ".txt", 0).otherwise(1), "path"))
    return rows.withColumn("_r", rank).filter("_r = 1").select("folder", "path")


def choose_text(sources: DataFrame) -> DataFrame:
    """``sources`` (doc_id, transcript, text_layer, ocr_markdown) as doc_id, text, origin: the first usable one.

    A transcript wins; a clean text layer comes before OCR.  Without any, text is
    empty and origin is extraction-failed.
    """
    some = lambda c: F.when(~tx.is_blank(F.col(c)), tx.strip(F.col(c)))
    layer = F.when(~tx.garbled(F.col("text_layer")), F.col("text_layer"))
    origin = F.when(some("transcript").isNotNull(), "transcript").when(layer.isNotNull(), "text-layer").when(some("ocr_markdown").isNotNull(), "ocr").otherwise("extraction-failed")
    return sources.select("doc_id", F.coalesce(some("transcript"), layer, some("ocr_markdown"), F.lit("")).alias("text"), origin.alias("origin"))


def pages_without_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page_number, note of pages on which nothing was read."""
    missing = pages.join(lines.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    return missing.select("doc_id", "page_number", F.format_string(PAGE_NOTE, "page_number").alias("note"))
