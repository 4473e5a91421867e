"""Language-model scores: the marginal probability of a text over all segmentations.

A text is a sequence of words, then one end.  Piece probabilities over a public
vocabulary, starting from the vocabulary's own order as scores, are re-estimated
by expectation-maximisation on the training documents; the end is one more
symbol.  The model's score is the log10 probability of the whole text, summed
over every segmentation by the forward recursion in log space.  Beside it stands
a smoothed word-unigram score as a base.

Data flow, for a corpus whose vocabulary has no bound:

1. Each chunk of documents becomes postings, packed by hash part of the word:
   the chunk's distinct words, their training counts, and which document of the
   chunk has how many.  Stored once, together with the chunk's documents.
2. Counts are summed by part.  A word sends one number a chunk, however common.
3. Piece probabilities come from the counted words (bounded by the vocabulary).
4. Counts meet the postings by part; parts over ``part_bytes`` are salted by
   chunk, the counts repeated for each salt.  Each word is scored once a salt.
5. Partial sums return to their chunk and are added up by document.

Defined cases: null or empty text is the end alone; repeated rows (also of one
id) are scored one by one; with no training rows the base score is that of an
empty table; other columns are not read; texts are used whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import lattice as lat
from lectern.llm.blobs import part_of, ranges, unpacked
from lectern.llm.common import partitions, raw_texts, stored, text_chunks

LN10 = float(np.log(10))
#: Pseudo-uses of every piece and of the end.
SMOOTHING = 0.05
DOC_COLUMNS = "ids array<long>, held binary, n_tokens binary, n_train long"
POSTINGS = f"part int, chunk long, words binary, train binary, n_posts binary, docs binary, tf binary, {DOC_COLUMNS}"
PARTS = "chunk long, docs binary, base binary, score binary, known binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def postings(docs: DataFrame, parts: int) -> DataFrame:
    """Packed rows for ``docs`` (doc_id, held_out, text); part -1 holds each chunk's documents."""
    names = [x.split(" ")[0] for x in POSTINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for n, chunk in enumerate(text_chunks(batches, "text")):
            split = [raw.lower().split() for raw in raw_texts(chunk.column("text"))]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            held = np.array(chunk.column("held_out").to_pylist(), bool)
            rows = [(-1, base + n, None, None, None, None, None, chunk.column("doc_id").to_pylist(), held.tobytes(), (sizes + 1).tobytes(), int((~held).sum()))]
            if sizes.any():
                rows += [(part, base + n, *blobs, None, None, None, None) for part, *blobs in packed(split, sizes, held, parts)]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in POSTINGS.split(", "))])
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, POSTINGS)


def packed(split: list[list[bytes]], sizes: np.ndarray, held: np.ndarray, parts: int):
    """For each part: words, training counts, documents a word, documents and their counts."""
    flat = list(itertools.chain.from_iterable(split))
    words = list(dict.fromkeys(flat))
    number = dict(zip(words, range(len(words)), strict=True))
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    docs = np.repeat(np.arange(len(sizes)), sizes)
    key, tf = np.unique(ids * len(sizes) + docs, return_counts=True)
    word, doc = np.divmod(key, len(sizes))
    train = np.bincount(word, tf * ~held[doc], len(words)).astype("<i8")
    n_posts = np.bincount(word, minlength=len(words))
    first = np.cumsum(n_posts) - n_posts
    part = part_of(words, parts)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p, (lo, hi) in enumerate(itertools.pairwise(bounds.tolist())):
        if lo < hi:
            own = order[lo:hi]
            at = ranges(first[own], n_posts[own])
            yield p, b" ".join([words[i] for i in own]), train[own].tobytes(), n_posts[own].astype("<u4").tobytes(), doc[at].astype("<u4").tobytes(), tf[at].astype("<u4").tobytes()


def summed(blobs: Iterator[bytes], numbers: Iterator[bytes]) -> dict[bytes, int]:
    """Counts of words over many chunks."""
    total: dict[bytes, int] = {}
    for words, train in zip(blobs, numbers, strict=True):
        for word, n in zip(words.split(), np.frombuffer(train, "<i8").tolist(), strict=True):
            total[word] = total.get(word, 0) + n
    return total


def word_counts(packed_rows: DataFrame, parts: int) -> DataFrame:
    """part, words, counts over all training documents, n_words, n_distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        part = None
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for word, n in summed(batch.column("words").to_pylist(), batch.column("train").to_pylist()).items():
                total[word] = total.get(word, 0) + n
        counts = np.fromiter(total.values(), "<i8", len(total))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([b" ".join(total)], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], names=["part", "words", "counts", "n_words", "n_distinct"])

    rows = packed_rows.filter("part >= 0").select("part", "words", "train").repartition(parts, "part")
    return rows.groupBy("part").applyInArrow(run, "part int, words binary, counts binary, n_words long, n_distinct long")


def piece_log_p(counts: DataFrame, path: str, ends: int, rounds: int) -> tuple[np.ndarray, float]:
    """Log probability of each piece and of the end; together they sum to one."""
    lattice = lat.loaded(path)
    log_p, log_end = lattice.prior, 0.0
    for _ in range(rounds):
        step = lattice.step(log_p)[:, None]

        def run(batches: Iterator[pa.RecordBatch], step=step) -> Iterator[pa.RecordBatch]:
            own, uses = lat.loaded(path), 0
            for batch in batches:
                for words, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    weight = np.frombuffer(n, "<i8")
                    seen = np.flatnonzero(weight)
                    known = words.split()
                    uses = uses + lat.expected_uses(own, [known[i] for i in seen], weight[seen, None].astype(float), step)[:, 0]
            at = np.flatnonzero(uses)
            if not np.isscalar(uses):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], names=["piece", "n"])

        uses = np.full(lattice.size + 1, SMOOTHING)
        for piece, n in counts.select("words", "counts").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():
            uses[piece] += n
        uses[-1] += ends
        log_p, log_end = np.log(uses[:-1] / uses.sum()), float(np.log(uses[-1] / uses.sum()))
    return log_p, log_end


def score_documents(docs: DataFrame, path: str, *, rounds: int = 2, part_bytes: int = 64 << 20) -> DataFrame:
    """Scores for ``docs`` (doc_id long, held_out boolean, text); learns from rows that are not held out."""
    parts = partitions(docs)
    index = stored(postings(docs, parts), "lm-postings", large=True)
    counts = stored(word_counts(index, parts), "lm-counts", large=True)
    ends = index.filter("part = -1").agg(F.sum("n_train")).first()[0] or 0
    n, v = counts.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    log_p, log_end = piece_log_p(counts, path, ends, rounds)
    step = lat.loaded(path).step(log_p)[:, None]
    lowest = n + 0.5 * (v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lat.loaded(path)
        for batch in batches:
            found = [lat.word_log_p(own, words.split(), step)[:, 0].tobytes() for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("part", "words", "counts")), pa.array(found, pa.binary())], names=["part", "words", "counts", "log_p"])

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        words = [w for blob in right.column("words").to_pylist() for w in blob.split()]
        row = dict(zip(words, range(len(words)), strict=True))
        count, model = unpacked(right.column("counts"), "<i8"), unpacked(right.column("log_p"), "<f8")
        base = np.log10((count + 0.5) / lowest)
        out = []
        for chunk, words, n_posts, doc, tf in zip(*(left.column(k).to_pylist() for k in ("chunk", "words", "n_posts", "docs", "tf")), strict=True):
            at = np.repeat(np.fromiter(map(row.__getitem__, words.split()), np.int64), np.frombuffer(n_posts, "<u4"))
            tf = np.frombuffer(tf, "<u4").astype(float)
            own, doc = np.unique(np.frombuffer(doc, "<u4"), return_inverse=True)
            sums = [np.bincount(doc, tf * x[at], len(own)) for x in (base, model, count > 0)]
            out.append((chunk, own.tobytes(), sums[0].tobytes(), sums[1].tobytes(), sums[2].astype("<i8").tobytes()))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(list(x), kind) for x, kind in zip(columns, kinds, strict=True)], names=["chunk", "docs", "base", "score", "known"])

    end_base = float(np.log10((ends + 0.5) / lowest))

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        at = unpacked(right.column("docs"), "<u4").astype(np.int64)
        sums = [unpacked(right.column(k), kind) for k, kind in (("base", "<f8"), ("score", "<f8"), ("known", "<i8"))]
        out = []
        for ids, held, tokens in zip(*(left.column(k).to_pylist() for k in ("ids", "held", "n_tokens")), strict=True):
            base, score, known = (np.bincount(at, x, len(ids)) for x in sums)
            out.append(pa.table([pa.array(ids, pa.int64()), pa.array(np.frombuffer(held, bool)), pa.array(np.frombuffer(tokens, "<i8")), pa.array(known.astype(np.int64) + (ends > 0)), pa.array(np.full(len(ids), n, np.int64)), pa.array(base + end_base), pa.array((score + log_end) / LN10)], names=[x.split(" ")[0] for x in RESULT.split(", ")]))
        return pa.concat_tables(out)

    # Salts for parts that hold very common words: a part never outgrows part_bytes.
    posts = index.filter("part >= 0").select("part", "chunk", "words", "n_posts", "docs", "tf")
    salts = posts.groupBy("part").agg(F.ceil(F.sum(F.octet_length("docs") + F.octet_length("tf") + F.octet_length("words")) / part_bytes).cast("int").alias("salts"))
    left = posts.join(F.broadcast(salts), "part").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int")).drop("salts")
    right = counts.select("part", "words", "counts").mapInArrow(score, "part int, words binary, counts binary, log_p binary")
    right = right.join(F.broadcast(salts), "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    sums = left.repartition(parts, "part", "salt").groupBy("part", "salt").cogroup(right.repartition(parts, "part", "salt").groupBy("part", "salt")).applyInArrow(partial, PARTS)
    own = index.filter("part = -1").select("chunk", "ids", "held", "n_tokens")
    return own.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(total, RESULT)
