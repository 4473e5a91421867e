"""A stream of questions against a static corpus: the interactive loop as micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import routing

LEAVE = ("exit", "quit")


def asked(questions: DataFrame) -> DataFrame:
    """Questions that want an answer: not blank, and not a word that ends a session."""
    word = F.lower(F.trim("query"))
    return questions.filter((word != "") & ~word.isin(*LEAVE))


def answer_stream(questions: DataFrame, docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of (query_id, doc_id, query) into Parquet; a repeated batch overwrites its own folder."""

    def answer(batch: DataFrame, epoch: int) -> None:
        routing.answers(docs, asked(batch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
