"""Embeddings, normalisation and exact vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

DIM = 128
#: Query vectors that a task holds at a time, and products with them that it ranks at a time.
QUERY_BLOCK, PRODUCTS = 1024, 1 << 19


def bucket(term: Column, dim: int = DIM) -> Column:
    """A stable hash bucket, the same in every process and engine."""
    return F.pmod(F.conv(F.substr(F.md5(term), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / norm))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in the body read it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_entries(text: Column, dim: int = DIM) -> Column:
    """The non-zero entries (bucket, weight) of a text's normalised hash embedding, as runs of its sorted buckets."""

    def runs(at: Column) -> Column:
        starts = F.array_compact(F.transform(at, lambda b, i: F.when((i == 0) | (b != F.get(at, i - 1)), i)))
        counts = let(starts, lambda s: F.transform(s, lambda p, i: F.struct(F.get(at, p).alias("bucket"), (F.coalesce(F.get(s, i + 1), F.size(at)) - p).cast("double").alias("n"))))
        return let(counts, normal)

    def normal(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x["n"] * x["n"]))
        return let(norm, lambda size: F.transform(counts, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] / size).alias("weight"))))

    return let(F.array_sort(F.transform(tx.terms(text), lambda t: bucket(t, dim))), runs)


def entries_product(a: Column, b: Column) -> Column:
    """Inner product of two arrays of entries."""
    return F.aggregate(a, F.lit(0.0), lambda total, x: total + F.aggregate(b, F.lit(0.0), lambda t, y: F.when(y["bucket"] == x["bucket"], y["weight"] * x["weight"]).otherwise(t)))


def hash_vectors(texts: DataFrame, *keys: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """``keys`` (unique together), bucket, weight: the non-zero entries of each text's normalised hash embedding."""
    counts = texts.select(*keys, F.explode(tx.terms(F.col(text))).alias("term")).groupBy(*keys, bucket(F.col("term"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))
    return counts.select(*keys, "bucket", (F.col("n") / norm).alias("weight"))


def model_embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text") -> DataFrame:
    """``texts`` with an embedding by an injected model, loaded once a worker and normalised."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in series:
            v = np.asarray(encode(part.fillna("").tolist()), dtype=np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(norm == 0, 1, norm)))

    return texts.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def top_k(hits: DataFrame, k: int, query: str, *order: Column | str) -> DataFrame:
    """The best k hits of each query by ``order``, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def vector_search(items: DataFrame, queries: DataFrame, k: int = 5, decimals: int = 9) -> DataFrame:
    """query_id, rank, item_id, score: exact inner products of normalised vectors.

    ``items`` (item_id long, v) meets ``queries`` (query_id long, v) in blocks of
    ``QUERY_BLOCK`` queries: a block is sent to all tasks, each keeps its own best
    k, and the bests are ranked together.  Scores are rounded before ties fall to
    the smaller item id.
    """
    count = queries.count()
    blocks, found = max(1, -(-count // QUERY_BLOCK)), None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "v").collect()
        if not rows:
            continue
        ids, matrix = np.array([r.query_id for r in rows]), unit(np.array([r.v for r in rows], dtype=float))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            best = [np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)]
            step = max(1, PRODUCTS // len(ids))
            # A batch's rows are as many as Spark sends; memory follows the step.
            for piece in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
                v = unit(np.stack(piece.column("v").to_numpy(zero_copy_only=False)).astype(float))
                score = np.concatenate([best[0], np.round(matrix @ v.T, decimals) + 0.0], axis=1)
                item = np.concatenate([best[1], np.tile(piece.column("item_id").to_numpy(), (len(ids), 1))], axis=1)
                order = np.lexsort((item, -score), axis=1)[:, :k]
                best = [np.take_along_axis(x, order, axis=1) for x in (score, item)]
            n = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["query_id", "item_id", "score"])

        part = items.select("item_id", "v").mapInArrow(run, "query_id long, item_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], "query_id long, item_id long, score double")
    return top_k(found, k, "query_id", F.desc("score"), "item_id").select("query_id", "rank", "item_id", "score")


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def semantic_search(chunks: DataFrame, queries: DataFrame, k: int = 5, dim: int = DIM, min_score: float | None = None) -> DataFrame:
    """query_id, rank, doc_id, chunk_no, score over hash embeddings, chunks of the query's own doc_id.

    The sparse entries of both sides are joined on document and bucket, so only
    chunks that share a bucket are scored.  Others have a score of zero, and count
    only where fewer than k share one: then they are among the first 2 k - 1.
    ``chunks`` are numbered from 1.
    """
    entries = hash_vectors(chunks.select("doc_id", "chunk_no", "text"), "doc_id", "chunk_no", dim=dim)
    asked = hash_vectors(queries.select("query_id", "doc_id", "text"), "query_id", "doc_id", dim=dim).withColumnRenamed("weight", "w")
    dots = entries.join(asked, ["doc_id", "bucket"]).select("query_id", "doc_id", "chunk_no", (F.col("weight") * F.col("w")).alias("dot"))
    first = queries.select("query_id", "doc_id").join(chunks.filter(F.col("chunk_no") < 2 * k).select("doc_id", "chunk_no"), "doc_id")
    scored = dots.unionByName(first.withColumn("dot", F.lit(0.0))).groupBy("query_id", "doc_id", "chunk_no").agg(F.round(F.sum("dot"), 9).alias("score"))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return top_k(scored, k, "query_id", F.desc("score"), "chunk_no").select("query_id", "rank", "doc_id", "chunk_no", "score")
