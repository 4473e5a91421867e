"""Documents and questions as streams: batches that come again, and an index that moves on meanwhile."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lectern.operators import once
from lectern.operators.generation import answer, with_generation
from lectern.operators.index import Index
from lectern.streaming import corpus
from tests.test_goldens import QUESTIONS, TRANSCRIPT

ASKED = "query_id long, doc_id long, query string"


def doc_ids(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder)).select("path", F.xxhash64("path").alias("id")).collect()
    return {r.path.rsplit("/", 1)[1]: r.id for r in files}


def found(spark, path):
    return sorted((r.query_id, r.mode, r.responses, r.version) for r in spark.read.parquet(f"{path}/answers").collect())


def test_files_become_documents_and_questions_keep_their_version(spark, tmp_path, monkeypatch):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_bytes(TRANSCRIPT.encode() + b"\xff")
    index = Index(spark, str(tmp_path / "index"))

    def grow():
        corpus.index_stream(corpus.document_stream(spark, str(folder)), index, str(tmp_path / "log")).awaitTermination()

    grow()
    ids = doc_ids(spark, folder)
    assert index.version() == 1 and [r.doc_id for r in index.manifest().collect()] == [ids["a.txt"]]
    # A batch that comes again changes nothing.
    index.merge(spark.createDataFrame([(ids["a.txt"], TRANSCRIPT.strip())], "doc_id long, text string"), whole=False)
    assert index.version() == 1

    def ask():
        stream = spark.readStream.schema(ASKED).parquet(str(tmp_path / "asked"))
        corpus.answer_stream(stream, index, out, str(tmp_path / "log2")).awaitTermination()

    spark.createDataFrame([(0, ids["a.txt"], QUESTIONS[0]), (1, 5, QUESTIONS[0])], ASKED).write.mode("append").parquet(str(tmp_path / "asked"))
    ask()
    first = found(spark, out)
    assert [x[1] for x in first] == ["exact-shlok-block", "not-found-or-low-quality"]
    # The next batch breaks after it has written its rows, and meanwhile the documents change.
    ids["b.txt"] = None
    (folder / "b.txt").write_text(TRANSCRIPT.replace("૨", "૯"), encoding="utf-8")
    ids = doc_ids(spark, folder)
    spark.createDataFrame([(2, ids["b.txt"], "aama 9 shlok kayo che ?"), (3, ids["a.txt"], QUESTIONS[1]), (4, 0, " ")], ASKED).write.mode("append").parquet(str(tmp_path / "asked"))
    real = corpus.version_of
    with monkeypatch.context() as m:
        m.setattr(corpus, "version_of", lambda *a: real(*a) and (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(StreamingQueryException):
            ask()
    grow()
    assert index.version() == 2
    ask()
    got = found(spark, out)
    assert got[:2] == first and [(x[0], x[1], x[3]) for x in got[2:]] == [(2, "not-found-or-low-quality", 1), (3, "exact-shlok-block", 1)]
    ask()
    assert found(spark, out) == got
    spark.createDataFrame([(5, ids["b.txt"], "aama 9 shlok kayo che ?")], ASKED).write.mode("append").parquet(str(tmp_path / "asked"))
    ask()
    assert [(x[0], x[1], x[3]) for x in found(spark, out)][4:] == [(5, "exact-shlok-block", 2)]


def test_equal_prompts_are_asked_once(spark, tmp_path):
    """Calls are counted in files, as workers make them."""
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()

    def client(prompt):
        import uuid

        (calls / uuid.uuid4().hex).write_text(prompt, encoding="utf-8")
        if "boom" in prompt and not (tmp_path / "mended").exists():
            raise ValueError("no")
        return f" said {len(prompt)} "

    rows = [(i, "q", "m", ["e"]) for i in range(20)] + [(20, "other", "m", ["e", "f"]), (21, "boom", "m", ["e"]), (22, "q", "m", []), (23, None, "m", ["x"])]
    answers = spark.createDataFrame(rows, "query_id long, query string, mode string, responses array<string>").withColumn("key", F.lit("clash"))

    def run():
        return {r.query_id: (r.mode, r.llm_answer, r.llm_error) for r in with_generation(answers, client, cache=cache).collect()}

    got = run()
    assert len(got) == 24 and len({got[i] for i in range(20)}) == 1 and got[0][0] == "m+gemini" and got[0][1].startswith("said ")
    assert got[21] == ("m", None, "Gemini failed: no") and got[22] == ("m", None, None) and got[23][0] == "m+gemini"
    said = [x.read_text(encoding="utf-8") for x in calls.iterdir()]
    assert len(said) == 3 + 3  # three that succeed, and one that is tried three times
    assert {r.attempts for r in once.kept(spark, cache, "string").filter("error IS NOT NULL").collect()} == {3}
    (tmp_path / "mended").touch()
    again = run()
    assert len(list(calls.iterdir())) == 7 and again[21][0] == "m+gemini" and {k: v for k, v in again.items() if k != 21} == {k: v for k, v in got.items() if k != 21}
    assert run() == again and len(list(calls.iterdir())) == 7
    hits = spark.createDataFrame([(1, 1, "text"), (2, 1, "text")], "query_id long, rank int, text string")
    queries = spark.createDataFrame([(1, "what"), (2, "what"), (3, "what")], "query_id long, text string")
    told = answer(hits, queries, client, cache=cache).collect()
    assert len(told) == 3 and len(list(calls.iterdir())) == 9


def test_vectors_are_computed_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "doc_id long, text string")
    load = lambda: lambda text: [float(len(text)), 1.0]
    got = texts.withColumn("key", once.key_of(F.col("text"))).join(once.computed_once(texts, load, "array<double>", str(tmp_path / "v")), "key")
    assert {r.doc_id: r.value for r in got.collect()} == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [0.0, 1.0]}
    assert once.kept(spark, str(tmp_path / "v"), "array<double>").count() == 2
