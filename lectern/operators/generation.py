"""Answers by an injected language-model client; none is needed to use the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import once, search

# What is said without a key.
NO_KEY = "GEMINI_API_KEY missing. Showing file-grounded output only."
# The evidence-only prompt.
PROMPT = "તમે બહુ કાળજીપૂર્વક જવાબ આપતા પુસ્તક સહાયક છો.\nફક્ત આપેલ Evidence પરથી જ જવાબ આપો.\nજો જવાબ ન મળે તો સ્પષ્ટ કહો: 'આ માહિતી આપવામાં આવેલી ફાઇલમાં ઉપલબ્ધ નથી.'\nજવાબ ગુજરાતી માં આપો.\n\nપ્રશ્ન: {query}\n\nEvidence:\n{evidence}\n"
Client = Callable[[str], str]


def with_generation(answers: DataFrame, client: Client | None = None, *, use_llm: bool = True, has_key: bool = True, cache: str | None = None) -> DataFrame:
    """``answers`` (query_id, query, mode, responses) with llm_answer and llm_error.

    Answers without evidence pass unchanged; a client's exception becomes
    llm_error; an answer by it extends the mode.  With a ``cache`` (a folder), equal
    prompts are asked once, now or ever; see ``once.computed_once``.
    """
    none = F.lit(None).cast("string")
    if not use_llm:
        return answers.withColumns({"llm_answer": none, "llm_error": none})
    if not has_key or client is None:
        return answers.withColumns({"llm_answer": none, "llm_error": F.when(F.size("responses") > 0, F.lit(NO_KEY))})
    if cache is not None:
        head, _, rest = PROMPT.partition("{query}")
        middle, _, tail = rest.partition("{evidence}")
        prompt = F.concat(F.lit(head), F.coalesce("query", F.lit("")), F.lit(middle), F.array_join("responses", "\n\n"), F.lit(tail))
        rows = answers.withColumn("_prompt", F.when(F.size("responses") > 0, prompt)).withColumn("_key", F.when(F.col("_prompt").isNotNull(), once.key_of(F.col("_prompt"))))
        asked = once.computed_once(rows.filter("_prompt IS NOT NULL"), lambda: client, "string", cache, text="_prompt")
        text = tx.strip(F.col("value"))
        given = rows.join(asked.withColumnRenamed("key", "_key"), "_key", "left").withColumn("llm_answer", F.when(text != "", text))
        failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("Gemini failed: "), "error"))
        mode = F.when(F.col("llm_answer").isNotNull(), F.concat("mode", F.lit("+gemini"))).otherwise(F.col("mode"))
        return given.withColumns({"mode": mode, "llm_error": failed}).select(*answers.columns, "llm_answer", "llm_error")
    schema = answers.select("*").schema.add("llm_answer", "string").add("llm_error", "string")

    def ask(query: str, responses: list[str] | None) -> tuple[str | None, str | None]:
        if not responses:
            return None, None
        try:
            return (client(PROMPT.format(query=query, evidence="\n\n".join(responses))) or "").strip() or None, None
        except Exception as error:  # whatever the client raises is reported with the answer
            return None, f"Gemini failed: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ask(q, r) for q, r in zip(batch.column("query").to_pylist(), batch.column("responses").to_pylist(), strict=True)]
            mode = [f"{m}+gemini" if a else m for m, (a, _) in zip(batch.column("mode").to_pylist(), got, strict=True)]
            columns = {k: batch.column(k) for k in batch.schema.names} | {"mode": pa.array(mode, pa.string()), "llm_answer": pa.array([a for a, _ in got], pa.string()), "llm_error": pa.array([e for _, e in got], pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return answers.mapInArrow(run, schema)


def answer(hits: DataFrame, queries: DataFrame, client: Client | None = None, *, cache: str | None = None) -> DataFrame:
    """query_id, answer, method: by the client from a grounding prompt, or extractive without one; ``cache`` as above."""
    if client is None:
        return search.extractive_answers(hits, queries).withColumn("method", F.lit("semantic+extractive"))
    prompts = queries.join(search.contexts(hits), "query_id", "left").select("query_id", search.grounding_prompt(F.col("text"), F.coalesce("context", F.lit(""))).alias("prompt"))
    if cache is not None:
        asked = once.computed_once(prompts, lambda: client, "string", cache, text="prompt")
        keyed = prompts.withColumn("key", once.key_of(F.col("prompt")))
        return keyed.join(asked, "key").select("query_id", F.col("value").alias("answer"), F.lit("semantic+llm").alias("method"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([client(p) for p in batch.column("prompt").to_pylist()], pa.string())], names=["query_id", "answer"])

    schema = queries.select("query_id").schema.add("answer", "string")
    return prompts.mapInArrow(run, schema).withColumn("method", F.lit("semantic+llm"))
