"""The stored index: equal to a rebuild after any merge, and untouched where nothing changed."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, routing, search, vectors
from lectern.operators import index as ix
from tests.test_goldens import QUESTIONS, TRANSCRIPT

WORDS = "alpha beta gamma delta river stone verse chapter shlok cloud green ink paper".split()


def text(seed):
    r = random.Random(seed)
    lines = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 30))]
    return ("# " if seed % 3 else "") + "\n".join(lines) + (f"\n{TRANSCRIPT}" if seed % 4 == 0 else "")


def table(spark, rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def files(path, name, version=None):
    return {str(p): p.stat().st_mtime_ns for p in path.glob(f"{name}/*/*.parquet")}


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def same_as_rebuilt(spark, index, docs):
    """Units, routes and both searches equal those over the documents themselves."""
    corpus = table(spark, docs.items())
    texts = corpus.withColumn("text", F.coalesce("text", F.lit("")))
    assert rows(index.units()) == rows(routing.units(texts).select(index.units().columns))
    chosen = sorted(docs)[::7]
    asked = spark.createDataFrame([(10 * d + n, d, q) for d in chosen for n, q in enumerate(QUESTIONS)], "query_id long, doc_id long, query string")
    assert rows(index.answers(asked)) == rows(routing.answers(texts, asked))
    queries = spark.createDataFrame([(d, d, text(d + 1000)[:60]) for d in chosen], "query_id long, doc_id long, text string")
    chunks = chunking.structural_chunks(chunking.markdown_blocks(texts), routing.SNIPPET_CHUNKS)
    wanted = vectors.semantic_search(chunks, queries).join(chunks.select("doc_id", "chunk_no", "text"), ["doc_id", "chunk_no"])
    assert rows(index.semantic_search(queries)) == rows(wanted)
    assert rows(index.keyword_search(queries.select("query_id", "text"))) == rows(search.keyword_search(chunks, queries, "doc_id", "chunk_no"))


@pytest.fixture(scope="module")
def docs():
    return {i: text(i) for i in range(60)} | {200: None, 201: ""}


def test_one_percent_changed_touches_nothing_else(spark, tmp_path, docs):
    index, docs = ix.Index(spark, str(tmp_path)), dict(docs)
    assert index.version() == 0 and index.units().count() == 0
    assert index.merge(table(spark, [*docs.items(), (5, docs[5])])) == 1
    before = files(tmp_path, "units") | files(tmp_path, "postings")
    assert index.merge(table(spark, docs.items())) == 1
    docs |= {3: text(5000), 300: text(5001)}
    del docs[4]
    assert index.merge(table(spark, docs.items())) == 2
    after = files(tmp_path, "units") | files(tmp_path, "postings")
    assert before.items() <= after.items()
    # What was written is the one changed and the one added document.
    brought = {r.doc_id for r in spark.read.parquet(str(tmp_path / "units" / "segment=2")).collect()}
    assert brought == {3, 300}
    assert {(r.doc_id, r.segment) for r in spark.read.parquet(str(tmp_path / "dead" / "version=2")).collect()} == {(3, 1), (4, 1)}
    same_as_rebuilt(spark, index, docs)
    # A reader of the first version still sees it.
    assert {r.doc_id for r in index.at(1).manifest().collect()} == (docs.keys() - {300}) | {4}


def test_parts_removals_and_compaction(spark, tmp_path, docs):
    index, docs = ix.Index(spark, str(tmp_path)), dict(docs)
    index.merge(table(spark, docs.items()))
    docs |= {7: docs[8], 8: text(6000)}
    assert index.merge(table(spark, [(7, docs[7]), (8, docs[8]), (None, "x")]), whole=False) == 2
    assert index.remove(table(spark, [(1, None), (999, None)])) == 3 and index.remove(table(spark, [(999, None)])) == 3
    del docs[1]
    docs[1] = text(7000)
    assert index.merge(table(spark, [(1, docs[1])]), whole=False) == 4
    wanted = rows(index.units())
    assert index.compact() == 5 and index._segments(5) == [5] and rows(index.units()) == wanted
    assert index.merge(table(spark, docs.items())) == 5
    docs[2] = "changed once more"
    assert index.merge(table(spark, docs.items())) == 6
    same_as_rebuilt(spark, index, docs)
    assert index.merge(table(spark, [])) == 7 and index.units().count() == 0 == index.manifest().count()


def test_broken_merges_do_not_count(spark, tmp_path, docs, monkeypatch):
    index = ix.Index(spark, str(tmp_path))
    index.merge(table(spark, docs.items()))
    wanted = rows(index.units())
    changed = dict(docs) | {2: "broken off"}
    with monkeypatch.context() as m:
        m.setattr(ix.Index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.merge(table(spark, changed.items()))
    assert index.version() == 1 and rows(index.units()) == wanted
    assert index.merge(table(spark, changed.items())) == 2
    assert rows(index.units()) == rows(routing.units(table(spark, changed.items()).fillna("")).select(index.units().columns))


def test_blocks_that_cannot_count_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 8)
    r = random.Random(1)
    docs = {i: " ".join([r.choice(WORDS)] * r.choice([1, 1, 1, 2]) + ["river"] * (40 - i if i < 20 else 1) + ["stone"] * (30 if i in (3, 150) else i % 3)) for i in range(200)}
    index = ix.Index(spark, str(tmp_path))
    index.merge(table(spark, docs.items()))
    index.merge(table(spark, [(0, "river stone"), (160, "stone " * 35 + "river " * 9)]), whole=False)
    docs |= {0: "river stone", 160: "stone " * 35 + "river " * 9}
    queries = spark.createDataFrame([(1, "river stone"), (2, "river"), (3, "paper ink cloud"), (4, "nowhere"), (5, ""), (6, None)], "query_id long, text string")
    chunks = chunking.structural_chunks(chunking.markdown_blocks(table(spark, docs.items())), routing.SNIPPET_CHUNKS)
    for k in (1, 3, 5, 500):
        assert rows(index.keyword_search(queries, k)) == rows(search.keyword_search(chunks, queries, "doc_id", "chunk_no", k=k))
    report = {x.query_id: x for x in ix.keyword_report(index, queries).collect()}
    assert report[2].postings == 202 and report[2].postings_used <= 24
    best = {x.query_id: x for x in ix.keyword_report(index, queries, 1).collect()}
    assert best[1].postings_used < best[1].postings == report[1].postings
    blocks = spark.read.parquet(str(tmp_path / "postings" / "segment=1")).collect()
    assert max(b.n for b in blocks) == 8 and all(b.most == b.postings[0].tf and len(b.postings) == b.n for b in blocks)


def test_many_asked_documents_are_found_by_bits(spark, tmp_path, docs, monkeypatch):
    index = ix.Index(spark, str(tmp_path))
    index.merge(table(spark, docs.items()))
    asked = spark.createDataFrame([(d, d, QUESTIONS[0]) for d in docs], "query_id long, doc_id long, query string")
    wanted = rows(index.answers(asked))
    monkeypatch.setattr(ix, "PUSHED", 3)
    assert rows(index.answers(asked)) == wanted
    snippets = index.snippets(asked)
    assert snippets.filter("rank > 3").count() == 0 and snippets.select("query_id").distinct().count() == len(docs) - 2


def test_postings_are_dealt_out_once_for_queries_that_share_terms(spark, tmp_path, docs, monkeypatch):
    index = ix.Index(spark, str(tmp_path))
    index.merge(table(spark, docs.items()))
    index.merge(table(spark, ({**docs, 3: text(5000), 300: text(5001)}).items()))
    queries = spark.createDataFrame([(i, text(i + 2000)[:80]) for i in range(40)] + [(40, ""), (41, "zebra")], "query_id long, text string")
    apart = []
    monkeypatch.setattr(ix, "_sums", lambda *_, own=ix._sums: apart.append(1) or own(*_))
    found = rows(index.keyword_search(queries))
    assert not apart  # no pair of a query and a posting is a row
    monkeypatch.setattr(ix, "SHARED", 1000)
    assert rows(index.keyword_search(queries)) == found and apart


def test_blocks_go_on_over_batches(spark, monkeypatch):
    rows_ = [(d, "chunk", n, f"{'alpha ' * (d % 3 + 1)}w{d % 7} beta") for d in range(30) for n in range(4)]
    chunks = spark.createDataFrame(rows_, "doc_id long, kind string, no long, text string")
    monkeypatch.setattr(ix, "BLOCK", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (3, 5, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            blocks = ix.posting_blocks(chunks).collect()
            assert all(b.n == len(b.postings) <= 5 and b.most == b.postings[0].tf == max(p.tf for p in b.postings) for b in blocks)
            got = sorted((b.term, p.doc_id, p.no, p.tf) for b in blocks for p in b.postings)
            assert got == sorted((w, d, n, t.split().count(w)) for d, _, n, t in rows_ for w in set(t.split()))
            assert sum(b.n == 5 for b in blocks) >= 300 // 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
