"""The whole way from a text to an answer, on a small sample: ``python -m lectern.demo``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, search
from lectern.plans import documents as plans

# The sample, its name and question, its budget of tokens, and the headings of the output.
TEXT = """Chapter 1: परिचय
Definitions
The textbook explains multilingual knowledge extraction.
- Point 1: Clean the OCR text.
- Point 2: Preserve headings and bullet points.

વિષયવસ્તુ
આ પુસ્તકમાં Gujarati, English, અને Sanskrit mixed content છે.
- મહત્વપૂર્ણ વિચાર 1
- મહત્વપૂર્ણ વિચાર 2"""
NAME, QUESTION = "sample_textbook", "What should we do to clean OCR text?"
CONFIG = chunking.ChunkConfig(max_tokens=80, overlap_tokens=20)
HEADINGS = ("MODULE 1: STRUCTURED MARKDOWN", "MODULE 2: CHUNKS", "MODULE 3: KEYWORD SEARCH", "MODULE 3: ANSWER")
SHOWN = 120


def sections(spark: SparkSession, text: str = TEXT, question: str = QUESTION, config: chunking.ChunkConfig = CONFIG) -> list[str]:
    """What each part of the way gives, as text."""
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, 0, question)], "query_id long, doc_id long, text string")
    markdown = plans.process_text(docs).withColumnRenamed("markdown", "text")
    chunks = chunking.structural_chunks(chunking.markdown_blocks(markdown), config, F.lit(NAME))
    hits = search.keyword_search(chunks, queries, "doc_id", "chunk_no").join(chunks, ["doc_id", "chunk_no"]).orderBy("rank")
    answer = plans.answer(markdown, queries, config=config)
    return [
        markdown.first().text,
        "\n".join(f"[{c.chunk_id}] {c.section_path} -> {c.text[:SHOWN]}" for c in chunks.orderBy("chunk_no").collect()),
        "\n".join(f"{h.score:.3f} | {h.chunk_id} | {h.text[:SHOWN]}" for h in hits.collect()),
        answer.first().answer,
    ]


def main() -> None:
    spark = SparkSession.builder.appName("lectern-demo").getOrCreate()
    print("\n\n".join(f"=== {heading} ===\n{body}" for heading, body in zip(HEADINGS, sections(spark), strict=True)))


if __name__ == "__main__":
    main()
