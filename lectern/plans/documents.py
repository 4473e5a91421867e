"""Whole plans: text or scanned files to Markdown, chunks and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import chunking, generation, search, structure, vectors
from lectern.sources import files as src
from lectern.sources import ocr


def process_text(docs: DataFrame, compatibility: bool = True) -> DataFrame:
    """doc_id, markdown of plain texts (doc_id, text)."""
    return structure.render_markdown(text_blocks(docs, compatibility))


def text_results(docs: DataFrame) -> DataFrame:
    """One row for each text (doc_id, source_name, text): source_name, page_count, markdown, ocr_backend, notes."""
    done = docs.select("doc_id", "source_name").join(process_text(docs), "doc_id", "left")
    return done.select("doc_id", "source_name", F.lit(1).alias("page_count"), F.coalesce("markdown", F.lit("")).alias("markdown"), F.lit(src.TEXT_BACKEND).alias("ocr_backend"), F.array(F.lit(src.TEXT_NOTE)).alias("notes"))


def scan_markdown(lines: DataFrame) -> DataFrame:
    """doc_id, markdown of scanned lines; a page is structured on its own, so there are no page-break blocks."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "block_no")
    one = lines.withColumn("doc_id", F.struct("doc_id", "page_number"))
    blocks = structure.assemble(structure.classify(one)).withColumn("doc_id", F.col("doc_id.doc_id"))
    return structure.render_markdown(blocks.withColumn("block_no", F.row_number().over(order)))


def scan_results(pages: DataFrame, lines: DataFrame, backend: str) -> DataFrame:
    """As ``text_results`` for scanned ``pages`` (doc_id, source_name, page_number) and the lines read on them.

    A page without lines gives a note.
    """
    markdown = scan_markdown(lines)
    notes = src.pages_without_lines(pages, lines).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "note"))).alias("n"))
    files = pages.groupBy("doc_id").agg(F.first("source_name").alias("source_name"), F.count("*").cast("int").alias("page_count"))
    done = files.join(markdown, "doc_id", "left").join(notes, "doc_id", "left")
    return done.select("doc_id", "source_name", "page_count", F.coalesce("markdown", F.lit("")).alias("markdown"), F.lit(backend).alias("ocr_backend"), F.coalesce(F.transform("n", lambda x: x["note"]), F.array().cast("array<string>")).alias("notes"))


def text_blocks(docs: DataFrame, compatibility: bool = True) -> DataFrame:
    return structure.assemble(structure.classify(src.clean_text_lines(docs, "doc_id", compatibility=compatibility)))


def process_files(files: DataFrame, config: ocr.OcrConfig = ocr.OcrConfig()) -> DataFrame:
    """doc_id, markdown of scanned files (doc_id, source_name, content): OCR, cleanup, structure."""
    return scan_markdown(src.clean_lines(ocr.recognised_lines(files, config)))


def process_pages(pages: DataFrame, config: ocr.OcrConfig = ocr.OcrConfig(), read: Callable | None = None, decode: Callable | None = None) -> DataFrame:
    """As ``scan_results`` for pages as ``sources.pages`` reads them; a file's id is a hash of its path."""
    own = pages.withColumn("doc_id", F.xxhash64("path"))
    lines = src.clean_lines(ocr.lines_of_words(ocr.page_words(own, config, read, decode)))
    listed = own.groupBy("doc_id", "source_name").agg(F.max("page_count").alias("n")).select("doc_id", "source_name", F.explode(F.sequence(F.lit(1), "n")).alias("page_number"))
    return scan_results(listed, lines, config.backend)


def keyword_answers(docs: DataFrame, queries: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig(), k: int = 5) -> DataFrame:
    """query_id, rank, doc_id, chunk_no, score of keyword search over structural chunks."""
    chunks = chunking.structural_chunks(chunking.markdown_blocks(docs), config)
    return search.keyword_search(chunks, queries, "doc_id", "chunk_no", k=k)


def answer(docs: DataFrame, queries: DataFrame, client: generation.Client | None = None, config: chunking.ChunkConfig = chunking.ChunkConfig(), k: int = 4) -> DataFrame:
    """query_id, answer, method for queries (query_id, doc_id, text) on their own documents."""
    chunks = chunking.structural_chunks(chunking.markdown_blocks(docs), config)
    hits = vectors.semantic_search(chunks, queries, k=k).join(chunks.select("doc_id", "chunk_no", "text"), ["doc_id", "chunk_no"])
    return generation.answer(hits.select("query_id", "rank", "text"), queries, client)
