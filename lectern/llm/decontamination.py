"""Benchmark decontamination with a positional inverted index.

The index is dealt by document: a segment holds a run of whole documents, and
for every term the sorted positions at which it stands, all documents of the
segment on one axis with a gap between two of them.  Segments are stored in the
shared folder.  A query never leaves its segment, so that neither indexing nor
searching shuffles, and a passage that a third of all documents share costs each
segment its own share only.

Phrases are found from the rarest term of the segment on: its positions, less
the term's offset, are intersected with the offset-adjusted positions of the
next rarest, until none is left or all terms are used up.  Proximity matches
start from the rarest term's neighbourhoods likewise.

The index keeps all words and is built once; queries are sent to it in blocks of
at most ``block_bytes``, and matches of several blocks are merged by document.  A
segment looks up only the queries whose rarest term it has.

Words: A-Z lower-cased, then runs of digits, letters a-z and characters beyond
ASCII.  Defined cases: a null or empty text has no words and no hits; an item
without words is no query; an item shorter than the window is one window; equal
items or windows are each reported; repeated documents are searched one by one;
a window never reaches from one document into the next.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.blobs import ranges, word_hashes
from lectern.llm.common import raw_texts, release, stored, text_chunks

WINDOW = 10
#: Words within which those of a window count as near.
SPAN = 20
BLOCK_BYTES = 16 << 20
#: Positions left free between two documents; more than any window or span asked for.
GAP = 1024
SEGMENT = "segment long, doc_ids array<long>, first binary, n_words binary, terms binary, offsets binary, positions binary"
#: segment and row: where the document stands in the index, the same for every block of queries.
MATCHES = "segment long, row int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"

_plain = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Maps A-Z to a-z, keeps word bytes, turns all others into spaces.
WORDS_ONLY = bytes(ord(chr(i).lower()) if 0x41 <= i <= 0x5A else i if i in _plain else 0x20 for i in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORDS_ONLY).split()


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` (doc_id long, text): the positions of every word, terms as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        base = TaskContext.get().partitionId() << 32
        for n, chunk in enumerate(text_chunks(batches, "text")):
            split = [words_of(raw) for raw in raw_texts(chunk.column("text"))]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            first = np.cumsum(sizes + GAP) - sizes - GAP
            words = list(itertools.chain.from_iterable(split))
            # Each different word is hashed once.
            number: dict[bytes, int] = {}
            at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            terms = word_hashes(list(number))
            by_hash = np.argsort(terms)
            rank = np.empty(len(terms), np.int32)
            rank[by_hash] = np.arange(len(terms), dtype=np.int32)
            order = np.argsort(rank[at], kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rank[at], minlength=len(terms)))])
            blobs = [first.astype("<i4"), sizes.astype("<i4"), terms[by_hash], offsets.astype("<i4"), ranges(first, sizes)[order].astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([base + n]), pa.array([chunk.column("doc_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=[x.split(" ")[0] for x in SEGMENT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SEGMENT)


class Asked:
    """Queries, ready to be sent to tasks: each is a row of numbers of the different terms, filled up with -1."""

    def __init__(self, queries: dict[tuple[bytes, ...], list[str]]):
        words = sorted({w for q in queries for w in q})
        number = {w: i for i, w in enumerate(words)}
        self.terms = word_hashes(words)
        self.names = list(queries.values())
        self.rows = np.full((len(queries), max(map(len, queries), default=1)), -1, np.int32)
        for row, q in zip(self.rows, queries, strict=True):
            row[: len(q)] = [number[w] for w in q]

    def met(self, segment: Segment) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Queries whose rarest term, and so every term, is in the segment, with their names."""
        often = np.append(np.diff(segment.bounds), 1 << 40)
        for i in np.flatnonzero(often[self.rows].min(axis=1) > 0).tolist():
            row = self.rows[i]
            yield row[row >= 0], self.names[i]


class Segment:
    """One segment's postings, ready to be searched."""

    def __init__(self, row: dict, terms: np.ndarray):
        """``terms`` are those that will be asked for, by their number."""
        self.doc_ids = row["doc_ids"]
        self.first, self.n_words, offsets, self.positions = (np.frombuffer(row[k], "<i4") for k in ("first", "n_words", "offsets", "positions"))
        self.first, self.n_words = self.first.astype(np.int64), self.n_words.astype(np.int64)
        own = np.frombuffer(row["terms"], "<u8")
        at = np.searchsorted(own, terms)
        known = at < len(own)
        known[known] = own[at[known]] == terms[known]
        self.starts, self.ends = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        self.starts[known], self.ends[known] = offsets[at[known]], offsets[at[known] + 1]
        self.bounds = np.stack([self.starts, self.ends], axis=1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.ends[term]]

    def frequency(self, term: int) -> int:
        return self.ends[term] - self.starts[term]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand one after the other."""
        order = np.argsort(self.ends[terms] - self.starts[terms], kind="stable").tolist()
        found = self.postings(terms[order[0]]) - order[0]
        for i in order[1:]:
            if not len(found):
                break
            found = intersect(found, self.postings(terms[i]) - i)
        return found

    def proximity(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Starts of the shortest stretches of at most ``span`` words with all terms, one for each start."""
        need = sorted(set(terms.tolist()), key=self.frequency)
        rare = self.postings(need[0]).astype(np.int64)
        # Rare places that have each other term near, from the next rarest on.
        for term in need[1:]:
            if not len(rare):
                return rare
            own = self.postings(term)
            at = np.searchsorted(own, rare - span + 1)
            rare = rare[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= rare + span - 1)] if len(own) else rare[:0]
        if not len(rare):
            return rare
        near = []
        for term in need:
            own = self.postings(term).astype(np.int64)
            at = np.searchsorted(rare, own)
            before, after = own - rare[np.maximum(at - 1, 0)], rare[np.minimum(at, len(rare) - 1)] - own
            near.append(own[((before >= 0) & (before < span)) | ((after >= 0) & (after < span))])
        at = np.sort(np.concatenate(near))
        # For every start, the first later (or same) position of each term.
        ends = np.full(len(at), -1)
        for own in near:
            nxt = np.searchsorted(own, at)
            ends = np.maximum(ends, np.where(nxt < len(own), own[np.minimum(nxt, len(own) - 1)], 1 << 40))
        return at[ends - at < span]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1


def intersect(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of sorted ``a`` that are in sorted ``b``."""
    if not len(b):
        return a[:0]
    return a[b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a]


def query_windows(items: list[tuple[str, bytes]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Each window of the items' words, with the items that have it."""
    out: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for item, raw in items:
        words = words_of(raw)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            own = out[tuple(words[i : i + window])]
            if item not in own:
                own.append(item)
    return dict(out)


def phrase_matches(index: DataFrame, queries: dict[tuple[bytes, ...], list[str]]) -> DataFrame:
    """For every document: n_words, hit stretches (merged, by word number, end exclusive) and items with hits."""
    asked = Asked(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in one_by_one(batch):
                seg = Segment(row, asked.terms)
                starts, sizes, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], defaultdict(set)
                for terms, names in asked.met(seg):
                    found = seg.phrase(terms)
                    if len(found):
                        starts.append(found)
                        sizes.append(np.full(len(found), len(terms)))
                        for d in np.unique(seg.doc_of(found)).tolist():
                            items[d].update(names)
                hits = spans(np.concatenate(starts), np.concatenate(sizes))
                doc = seg.doc_of(hits[0])
                lo, hi = np.searchsorted(doc, np.arange(len(seg.doc_ids))), np.searchsorted(doc, np.arange(len(seg.doc_ids)), side="right")
                first = seg.first[doc]
                begin, end = hits[0] - first, hits[1] - first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(seg.doc_ids), pa.int64()),
                        pa.array(range(len(seg.doc_ids)), pa.int32()),
                        pa.array(seg.doc_ids, pa.int64()),
                        pa.array(seg.n_words),
                        pa.array([begin[a:b] for a, b in zip(lo, hi, strict=True)], pa.list_(pa.int32())),
                        pa.array([end[a:b] for a, b in zip(lo, hi, strict=True)], pa.list_(pa.int32())),
                        pa.array([sorted(items.get(d, ())) for d in range(len(seg.doc_ids))], pa.list_(pa.string())),
                    ],
                    names=[x.split(" ")[0] for x in MATCHES.split(", ")],
                )

    return index.mapInArrow(run, MATCHES)


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, of which Spark sends many: only one segment is unpacked at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of stretches, as sorted starts and ends."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], (starts + sizes)[order]
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:] - 1, len(starts) - 1)]


def proximity_matches(index: DataFrame, queries: dict[tuple[bytes, ...], list[str]], span: int) -> DataFrame:
    """doc_id, item_id, n_starts: documents with all words of one of an item's queries within ``span`` words (at most the gap), in any order, and the places where such a stretch starts."""
    if span > GAP:
        raise ValueError(f"span must be at most {GAP}")
    asked = Asked(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in one_by_one(batch):
                seg, out = Segment(row, asked.terms), defaultdict(set)
                for terms, names in asked.met(seg):
                    found = seg.proximity(terms, span)
                    for d, p in zip(seg.doc_of(found).tolist(), found.tolist(), strict=True):
                        for item in names:
                            out[d, item].add(p)
                yield pa.RecordBatch.from_arrays([pa.array([seg.doc_ids[d] for d, _ in out], pa.int64()), pa.array([item for _, item in out], pa.string()), pa.array([len(x) for x in out.values()], pa.int64())], names=["doc_id", "item_id", "n_starts"])

    return index.mapInArrow(run, "doc_id long, item_id string, n_starts long")


def query_blocks(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items with words in blocks of at most ``block_bytes``; one block is on the driver at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield [(r.item or "", r.text.encode()) for r in rows]


def stored_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), stored; any number of searches read it."""
    return stored(build_index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "postings", large=True)


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches of every document of ``docs`` (doc_id, text) with the items of ``benchmark``."""
    index = stored_index(docs)
    found = [phrase_matches(index, query_windows(items, window)) for items in query_blocks(benchmark, block_bytes=block_bytes)]
    return found[0] if len(found) == 1 else merged(found)


def near_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_starts: where all words of a window stand within ``span`` words, whatever their order."""
    index = stored_index(docs)
    found = [proximity_matches(index, query_windows(items, window), span) for items in query_blocks(benchmark, block_bytes=block_bytes)]
    return reduce(DataFrame.unionByName, found)


def merged(found: list[DataFrame]) -> DataFrame:
    """Matches of several blocks of queries as one row a document."""
    every = reduce(DataFrame.unionByName, found)
    rows = every.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            pairs = [spans(np.array(s, np.int64), np.array(e, np.int64) - np.array(s, np.int64)) for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("segment", "row", "doc_id", "n_words")), *(pa.array([p[i] for p in pairs], pa.list_(pa.int32())) for i in (0, 1)), batch.column("items")], names=[x.split(" ")[0] for x in MATCHES.split(", ")])

    return rows.select("segment", "row", "doc_id", "n_words", "starts", "ends", "items").mapInArrow(run, MATCHES)


def digest(matches: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated for each row of matches."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return matches.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))
