"""A stored retrieval index that changes with its documents.

``path`` holds what belongs to each version, and segments::

    changes/version=N    what the merge to N found: doc_id, digest, segment, state
    segments/version=N   the segments that N reads
    dead/version=N       doc_id, segment of what is out of date in them
    manifest/version=N   doc_id, digest, segment of the live documents
    units/segment=N      lines and chunks of the documents that version N brought
    postings/segment=N   blocks of postings of the chunks' terms

A merge compares digests of the texts, so only documents that are new or changed are
cut, embedded and written, into a segment of their own; the files of other segments
stay as they are, and what is out of date in them is listed as dead.  The manifest is
written last, and a version counts once that is whole; what a broken merge left is
written over by the next.  There is one writer at a time, and readers keep the
version that they began with.  ``compact`` writes the live rows of all segments into one.

Units lie in ranges of documents, and postings in ranges of terms, so a reader that
asks for some skips files and row groups by their statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import shuffles
from lectern.functions import text as tx
from lectern.operators import routing, search, vectors

#: Postings of a block.
BLOCK = 256
#: Ids or terms that are pushed down to the files as a list; more are joined.
PUSHED = 1000
#: Queries that share a posting on average, from which on postings are dealt out once for all of them.
SHARED = 2
#: The most that is broadcast, counted as 16 bytes a value.
BROADCAST_BYTES = 32 << 20

UNITS = """doc_id long, kind string, no long, first boolean, text string, verses array<int>, verse_block string, chapters array<int>,
chapter_block string, terms array<string>, entries array<struct<bucket:int,weight:double>>"""
POSTINGS = "term string, most long, n int, postings array<struct<doc_id:bigint,no:bigint,tf:bigint>>"
TABLES = {"changes": "doc_id long, digest string, segment int, state string", "segments": "segment int", "dead": "doc_id long, segment int", "manifest": "doc_id long, digest string, segment int"}


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its counted rows allow."""
    return F.broadcast(df) if 16 * len(df.columns) * rows <= BROADCAST_BYTES else df


class Index:
    """The index at ``path``, made by its first merge.  Documents have doc_id (long) and text; a null text is empty."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self._pinned = spark, path.rstrip("/"), version

    # --- Versions ---

    def version(self) -> int:
        """The version that is read: the last whole one unless another was asked for; 0 before the first merge."""
        return self.last() if self._pinned is None else self._pinned

    def last(self) -> int:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/manifest")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [x.getPath() for x in files.listStatus(root)] if files.exists(root) else []
        return max((int(p.getName().split("=")[1]) for p in folders if files.exists(hadoop.Path(p, "_SUCCESS"))), default=0)

    def at(self, version: int) -> Index:
        """The index as it was at a version."""
        return Index(self.spark, self.path, version)

    def _table(self, name: str, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/version={version}")

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        with shuffles.dropped(self.spark):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def manifest(self) -> DataFrame:
        """doc_id, digest, segment of the live documents."""
        return self._table("manifest", self.version())

    def _segments(self, version: int) -> list[int]:
        return sorted(r.segment for r in self._table("segments", version).collect())

    def _live(self, name: str, schema: str) -> DataFrame:
        """Rows of the version's segments, with the segment; dead ones among them."""
        segments = self._segments(self.version())
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        reader = self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.path}/{name}")
        return reader.parquet(*(f"{self.path}/{name}/segment={n}" for n in segments))

    def _without_dead(self, rows: DataFrame) -> DataFrame:
        dead = self._table("dead", self.version())
        n = dead.count()
        return rows.join(small(dead, n), ["doc_id", "segment"], "left_anti") if n else rows

    def units(self) -> DataFrame:
        """The units of all live documents, as ``routing.units`` gives them."""
        return self._without_dead(self._live("units", UNITS)).drop("segment")

    # --- Changes ---

    def merge(self, docs: DataFrame, *, whole: bool = True) -> int:
        """Bring ``docs`` in, and with ``whole`` drop all documents that are not among them; the version after it.

        Of rows that share an id the one with the smallest digest counts; rows without an
        id are left out.  Where nothing has changed, the version stays.
        """
        old, new = self.last(), self.last() + 1
        text = F.coalesce("text", F.lit(""))
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter("doc_id IS NOT NULL")
        ids = given.groupBy("doc_id").agg(F.min(F.md5("text")).alias("digest"))
        was = self._table("manifest", old).withColumnRenamed("digest", "_digest")
        state = F.when(F.col("digest").eqNullSafe(F.col("_digest")), "kept").when(F.col("_digest").isNull(), "added").when(F.col("digest").isNotNull(), "changed")
        both = ids.join(was, "doc_id", "full").withColumn("state", state.otherwise("removed" if whole else "kept"))
        self._write(both.select("doc_id", F.coalesce("digest", "_digest").alias("digest"), "segment", "state"), "changes", new)
        changes = self._table("changes", new)
        fresh = changes.filter("state IN ('added', 'changed')")
        if changes.filter("state <> 'kept'").isEmpty():
            return old
        segments = self._segments(old)
        if not fresh.isEmpty():
            # The filter by bits comes before the texts are dealt out.
            texts = routing.members(given.withColumn("digest", F.md5("text")), fresh.select("doc_id"))
            texts = texts.join(fresh.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
            self._segment(routing.units(texts.repartitionByRange("doc_id"), dealt=True).sortWithinPartitions("doc_id", "kind", "no"), new)
            segments.append(new)
        return self._commit(old, changes, segments)

    def remove(self, doc_ids: DataFrame) -> int:
        """Drop documents by id; the version after it."""
        old = self.last()
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("_gone", F.lit(True))
        state = F.when(F.col("_gone"), "removed").otherwise("kept")
        self._write(self._table("manifest", old).join(gone, "doc_id", "left").select("doc_id", "digest", "segment", state.alias("state")), "changes", old + 1)
        changes = self._table("changes", old + 1)
        return old if changes.filter("state <> 'kept'").isEmpty() else self._commit(old, changes, self._segments(old))

    def _commit(self, old: int, changes: DataFrame, segments: list[int]) -> int:
        new = old + 1
        self._write(self.spark.createDataFrame([(n,) for n in segments], TABLES["segments"]).coalesce(1), "segments", new)
        gone = changes.filter("state IN ('changed', 'removed')").select("doc_id", "segment")
        self._write(self._table("dead", old).unionByName(gone), "dead", new)
        live = changes.filter("state <> 'removed'").select("doc_id", "digest", F.when(F.col("state") == "kept", F.col("segment")).otherwise(F.lit(new)).alias("segment"))
        self._write(live, "manifest", new)
        return new

    def compact(self) -> int:
        """All live rows in one segment, none dead; the version after it.  Files of earlier versions stay for their readers."""
        old = self.last()
        new = old + 1
        self._segment(self.at(old).units().repartitionByRange("doc_id").sortWithinPartitions("doc_id", "kind", "no"), new)
        self._write(self.spark.createDataFrame([(new,)], TABLES["segments"]).coalesce(1), "segments", new)
        self._write(self._table("dead", 0), "dead", new)
        self._write(self._table("manifest", old).withColumn("segment", F.lit(new)), "manifest", new)
        return new

    def _segment(self, units: DataFrame, n: int) -> None:
        empty = self.spark.createDataFrame([], UNITS)
        with shuffles.dropped(self.spark):
            units.select(empty.columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/units/segment={n}")
            own = self.spark.read.schema(UNITS).parquet(f"{self.path}/units/segment={n}")
            posting_blocks(own.filter("kind = 'chunk'")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/postings/segment={n}")

    # --- Reading ---

    def asked_units(self, doc_ids: DataFrame) -> DataFrame:
        """Units of the documents of ``doc_ids``, and of few others: by a pushed list if these are few, else by bits."""
        ids = [r.doc_id for r in doc_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct().limit(PUSHED + 1).collect()]
        rows = self._live("units", UNITS)
        rows = rows.filter(F.col("doc_id").isin(ids)) if len(ids) <= PUSHED else routing.members(rows, doc_ids)
        return self._without_dead(rows).drop("segment")

    def answers(self, queries: DataFrame, *, min_score: float | None = None) -> DataFrame:
        """query_id, mode, responses: the routes of ``routing.answers`` over the stored units."""
        return routing.answers_from(self.asked_units(queries), queries, min_score=min_score)

    def semantic_search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, doc_id, chunk_no, score, text: the best chunks of each query's own document (query_id, doc_id, text)."""
        chunks = self.asked_units(queries).filter("kind = 'chunk'").select("doc_id", F.col("no").alias("chunk_no"), "text", "entries")
        asked = queries.select("query_id", "doc_id", vectors.hash_entries(F.col("text")).alias("q"))
        score = F.round(vectors.entries_product(F.col("entries"), F.col("q")), 9)
        scored = asked.join(chunks, "doc_id").withColumn("score", score).filter((F.col("score") > 0) | (F.col("chunk_no") < 2 * k))
        return vectors.top_k(scored, k, "query_id", F.desc("score"), "chunk_no").select("query_id", "rank", "doc_id", "chunk_no", "score", "text")

    def snippets(self, queries: DataFrame, k: int = routing.MOST[4]) -> DataFrame:
        """As ``semantic_search``, for questions as they are asked (query_id, doc_id, query), expanded."""
        asked = routing.understood(queries).select("query_id", "doc_id", F.col("expanded").alias("text"))
        return self.semantic_search(asked, k)

    def keyword_search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, doc_id, chunk_no, score over the chunks of all documents (query_id, text)."""
        return keyword_search(self, queries, k)


def posting_blocks(chunks: DataFrame) -> DataFrame:
    """term, most, n, postings: each term's postings by impact, in blocks of ``BLOCK``.

    Terms are counted within their chunk's row.  The sort deals out ranges of postings,
    not of terms, so a term that is everywhere takes several tasks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            starts = block_starts(rows, BLOCK)
            # The last block may go on in the next batch.
            if len(starts) > 1:
                yield packed_blocks(rows.slice(0, starts[-1]), starts[:-1])
            rest = rows.slice(starts[-1]) if len(starts) else rest
        if rest is not None:
            yield packed_blocks(rest, np.zeros(1, np.int64))

    counts = chunks.select("doc_id", "no", F.explode(search.term_counts(F.col("text"))).alias("c")).select("doc_id", "no", "c.*")
    by_impact = ["term", F.desc("tf"), "doc_id", "no"]
    return counts.repartitionByRange(*by_impact).sortWithinPartitions(*by_impact).mapInArrow(pack, POSTINGS)


def block_starts(rows: pa.Table, most: int) -> np.ndarray:
    """Where terms of sorted ``rows`` begin, and go on after ``most`` postings."""
    code = pa.concat_arrays(rows.column("term").chunks).dictionary_encode().indices.to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int32)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return np.flatnonzero((np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))) % most == 0)


def packed_blocks(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """A row of ``POSTINGS`` for each block of sorted postings."""
    term, tf, doc_id, no = (pa.concat_arrays(rows.column(k).chunks) for k in ("term", "tf", "doc_id", "no"))
    ends = np.append(starts, rows.num_rows)
    postings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([doc_id, no, tf], names=["doc_id", "no", "tf"]))
    at = pa.array(starts)
    return pa.RecordBatch.from_arrays([term.take(at), tf.take(at), pa.array(np.diff(ends), pa.int32()), postings], names=["term", "most", "n", "postings"])


def asked_blocks(index: Index, asked: DataFrame) -> DataFrame:
    """The blocks, with their segment, of the terms of ``asked``, and of few others if these are many."""
    terms = [r.term for r in asked.select("term").distinct().limit(PUSHED + 1).collect()]
    blocks = index._live("postings", POSTINGS)
    return blocks.filter(F.col("term").isin(terms)) if len(terms) <= PUSHED else blocks


def planned_blocks(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, term, n_terms, most, n, postings, segment, floor, used: the blocks of each query's terms, and which are read.

    A first look takes one block of the highest impact for each term; the k-th best sum
    of a query over these is a floor for its k best.  A block can bring a new candidate
    only if its highest count and the other terms' highest counts reach the floor
    together.  Blocks carry up to ``BLOCK`` postings, so a hot term is few rows.
    """
    asked = search.query_terms(queries, 2)
    n = asked.count()
    met = asked_blocks(index, asked).join(small(asked, n), "term")
    tops = met.groupBy("query_id", "term").agg(F.max("most").alias("top"))
    others = tops.select("query_id", "term", (F.sum("top").over(Window.partitionBy("query_id")) - F.col("top")).alias("others"))
    look = met.groupBy("query_id", "term").agg(F.max_by(F.struct("segment", "postings"), F.struct("most", "n")).alias("b"))
    sums = _sums(index, look.select("query_id", "b.segment", "b.postings"))
    floor = vectors.top_k(sums, k, "query_id", F.desc("got"), "doc_id", "no").filter(F.col("rank") == k).select("query_id", F.col("got").alias("floor"))
    # Neither has more rows than the queries have terms, so the blocks stay where they are.
    planned = met.join(small(others, n), ["query_id", "term"]).join(small(floor, n), "query_id", "left")
    return planned.withColumn("used", F.col("most") + F.col("others") >= F.coalesce("floor", F.lit(0))).drop("others")


def _sums(index: Index, blocks: DataFrame) -> DataFrame:
    """query_id, doc_id, no, got: occurrences in the postings of ``blocks`` whose documents are live."""
    rows = blocks.select("query_id", "segment", F.explode("postings").alias("p")).select("query_id", "segment", "p.*")
    return index._without_dead(rows).groupBy("query_id", "doc_id", "no").agg(F.sum("tf").alias("got"))


def keyword_search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, doc_id, chunk_no, score as ``search.keyword_search`` over all chunks, from the blocks that are used.

    Sums are scores where all of a query's blocks were used; where some were not,
    candidates that can still be among the best are counted in their own text.  Where many
    queries share their terms, skipping blocks for each saves less than their sums cost: all
    postings of their terms are read, see ``keyword_search_together``.
    """
    asked = search.query_terms(queries, 2)
    asking = asked.groupBy("term").agg(F.count("*").alias("queries"))
    sizes = asked_blocks(index, asked).join(small(asking, asked.count()), "term").agg(F.sum(F.col("n") * F.col("queries")), F.sum("n")).first()
    if sizes[0] and sizes[0] > SHARED * sizes[1]:
        return keyword_search_together(index, queries, k)
    blocks = planned_blocks(index, queries, k)
    sums = _sums(index, blocks.filter("used"))
    left = blocks.filter("NOT used").groupBy("query_id", "term").agg(F.max("most").alias("most")).groupBy("query_id").agg(F.sum("most").alias("left"))
    n_terms = search.query_terms(queries, 2).groupBy("query_id").agg(F.first("n_terms").alias("n_terms"))
    if not left.isEmpty():
        kth = vectors.top_k(sums, k, "query_id", F.desc("got"), "doc_id", "no").filter(F.col("rank") == k).select("query_id", F.col("got").alias("kth"))
        open_ = sums.join(left, "query_id").join(kth, "query_id", "left").filter(F.col("got") + F.col("left") >= F.coalesce("kth", F.lit(0)))
        texts = index.asked_units(open_).filter("kind = 'chunk'").select("doc_id", "no", search.term_counts(F.col("text")).alias("counts"))
        asked = queries.select("query_id", F.array_distinct(tx.terms(F.col("text"), 2)).alias("t"))
        own = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + F.when(F.array_contains("t", x["term"]), x["tf"]).otherwise(0))
        counted = open_.join(texts, ["doc_id", "no"]).join(asked, "query_id").select("query_id", "doc_id", "no", own.alias("got"))
        sums = sums.join(left, "query_id", "left_anti").unionByName(counted)
    scored = sums.join(n_terms, "query_id").select("query_id", "doc_id", F.col("no").alias("chunk_no"), F.round(F.col("got") / F.col("n_terms"), 9).alias("score"))
    return vectors.top_k(scored, k, "query_id", F.desc("score"), "doc_id", "chunk_no").select("query_id", "rank", "doc_id", "chunk_no", "score")


def keyword_search_together(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """As ``keyword_search``, from all postings of the queries' terms.

    Each posting is dealt out once, by its document, whatever the number of queries that ask for
    its term; tasks keep their k best chunks of each query, so pairs of both are not shuffled.
    """
    asked = search.query_terms(queries, 2)
    terms = asked.select("term").distinct()
    blocks = asked_blocks(index, asked).join(small(terms, terms.count()), "term", "left_semi")
    rows = index._without_dead(blocks.select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.*"))
    words = F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int"))))
    chunks = rows.select("doc_id", F.col("no").alias("chunk_no"), "term", "tf").repartition("doc_id").groupBy("doc_id", "chunk_no").agg(words.alias("_terms"))
    own = queries.select("query_id", F.array_distinct(tx.terms(F.col("text"), 2)).alias("t"))
    return search.best_items(chunks, own, "doc_id", "chunk_no", k=k)


def keyword_report(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, postings, postings_used: what each query's terms have, and what of it is read for this query by itself."""
    used = F.sum(F.when(F.col("used"), F.col("n")).otherwise(0))
    return planned_blocks(index, queries, k).groupBy("query_id").agg(F.sum("n").cast("long").alias("postings"), used.cast("long").alias("postings_used"))
