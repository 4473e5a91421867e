"""Command line: questions about the documents of a folder."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import generation, routing
from lectern.sources import files as src
from lectern.sources import ocr

FAILED = "extraction-failed"
# The answer where no text can be read.
NO_TEXT = ("માફ કરશો, આ ફાઇલમાંથી વાંચી શકાય એવો સાફ લખાણ મળ્યો નથી.", "કૃપા કરીને /data માં UTF-8 transcript.txt અથવા .md ઉમેરો, અથવા વધુ સ્પષ્ટ PDF/ઈમેજ આપો.")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data-dir", default="data")
    p.add_argument("--query", default="")
    p.add_argument("--ocr-backend", choices=("tesseract", "easyocr", "paddleocr"), default="tesseract")
    p.add_argument("--use-llm", action="store_true")
    p.add_argument("--llm-model", default="gemini-1.5-flash")
    p.add_argument("--gemini-api-key", default=os.environ.get("GEMINI_API_KEY", ""))
    p.add_argument("--interactive", action="store_true")
    return p


def gemini(model: str, key: str) -> generation.Client | None:
    """A client for the optional library; imported in the worker that asks."""

    def ask(prompt: str) -> str:
        library = ocr.optional("google.generativeai")
        if library is None:
            # Fixed value: what is said without the library.
            raise RuntimeError("Gemini dependency missing. Install with: pip install google-generativeai")
        library.configure(api_key=key)
        return getattr(library.GenerativeModel(model).generate_content(prompt), "text", "") or ""

    return ask if key else None


def load(spark: SparkSession, data_dir: str, backend: str) -> DataFrame:
    """doc_id, text, origin of the folder's transcript, else of its first PDF; a PDF is not required."""
    listed = src.list_files(spark, data_dir)
    pdfs = src.first_pdf(listed)
    chosen = src.choose_transcripts(listed, pdfs)
    everything = src.read_files(spark, data_dir)
    transcript = src.transcripts(everything.join(chosen.select("path"), "path")).select(F.lit(0).cast("long").alias("doc_id"), F.col("text").alias("transcript"))
    if not transcript.limit(1).count() and pdfs.limit(1).count():
        from lectern.plans.documents import process_files

        pdf = everything.join(pdfs.select("path"), "path").select(F.lit(0).cast("long").alias("doc_id"), "source_name", "content")
        sources = ocr.with_ocr(ocr.text_layers(pdf), backend).withColumn("transcript", F.lit(None).cast("string"))
        markdown = process_files(pdf, ocr.OcrConfig(backend=backend))
        return src.choose_text(sources.join(markdown.withColumnRenamed("markdown", "ocr_markdown"), "doc_id", "left"))
    none = F.lit(None).cast("string")
    return src.choose_text(transcript.withColumns({"text_layer": none, "ocr_markdown": none}))


def render(answer) -> str:
    lines = [f"Note: {answer.llm_error}", ""] if answer.llm_error else []
    if answer.llm_answer and answer.llm_answer.strip():
        lines += ["LLM Answer:", "-" * 40, answer.llm_answer.strip(), ""]
    lines += [f"Mode: {answer.mode}", "Output from file:"]
    for item in answer.responses:
        lines += ["-" * 40, item]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not (args.query or args.interactive):
        parser().error("Provide --query or use --interactive")
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    docs = load(spark, args.data_dir, args.ocr_backend).cache()
    if not docs.filter("text <> ''").limit(1).count():
        print("\n".join([f"Mode: {FAILED}", "Output from file:", "-" * 40, *NO_TEXT]))
        return 1

    def ask(question: str) -> None:
        queries = spark.createDataFrame([(0, 0, question)], "query_id long, doc_id long, query string")
        found = routing.answers(docs, queries).join(queries.select("query_id", "query"), "query_id")
        done = generation.with_generation(found, gemini(args.llm_model, args.gemini_api_key), use_llm=args.use_llm, has_key=bool(args.gemini_api_key))
        print(render(done.first()))

    if args.query:
        ask(args.query)
    while args.interactive and (line := sys.stdin.readline()):
        if line.strip().lower() in ("exit", "quit"):
            break
        if line.strip():
            ask(line.strip())
    return 0


if __name__ == "__main__":
    sys.exit(main())
