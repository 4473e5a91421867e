"""Pages of files in shares, with conditions that keep files shut; OCR set-up with injected engines."""

import json
from contextlib import contextmanager
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lectern.plans import documents as plans
from lectern.sources import ocr
from lectern.sources import pages as pg


class Told:
    """Files of lines, one a page; it notes in a folder what is opened and read."""

    def __init__(self, log):
        self.log = str(log)

    def note(self, what, *values):
        import os
        import uuid

        with open(os.path.join(self.log, uuid.uuid4().hex), "w") as f:
            json.dump([what, *values], f)

    def files(self, path):
        yield from pg.Files().files(path)

    @contextmanager
    def open(self, path):
        self.note("open", path.rsplit("/", 1)[1])
        with open(path, "rb") as f:
            yield Lines(self, path.rsplit("/", 1)[1], f.read().split(b"\n"))


class Lines(list):
    def __init__(self, told, name, lines):
        super().__init__(lines)
        self.told, self.file = told, name

    def __getitem__(self, i):
        self.told.note("read", self.file, i + 1)
        return super().__getitem__(i)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "log").mkdir()
    (tmp_path / "in" / "big.scan").write_text("\n".join(f"page {i}" for i in range(1, 1001)))
    for i in range(5):
        (tmp_path / "in" / "sub" / f"small{i}.SCAN").write_text(f"only {i}\nsecond")
    (tmp_path / "in" / "notes.txt").write_text("no scan")
    return tmp_path


def noted(folder):
    return [json.loads(x.read_text()) for x in (folder / "log").iterdir()]


def test_a_large_file_is_read_by_several_tasks(spark, folder):
    found = pg.read_pages(spark, str(folder / "in"), Told(folder / "log"), name="told-a", part_bytes=2000)
    assert not noted(folder)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    big = [r for r in rows if r.source_name == "big.scan"]
    assert sorted(r.page_number for r in big) == list(range(1, 1001)) and {r.page_count for r in big} == {1000}
    assert all(bytes(r.content) == f"page {r.page_number}".encode() for r in big)
    tasks = {t: sum(r.task == t for r in big) for t in {r.task for r in big}}
    assert len(tasks) >= 4 and max(tasks.values()) <= 300
    assert len({r.task for r in rows if r.suffix == ".scan" and r.source_name != "big.scan"}) <= 2
    assert len(rows) == 1000 + 10 + 1


def test_files_and_pages_that_are_not_wanted_are_not_read(spark, folder):
    found = pg.read_pages(spark, str(folder / "in"), Told(folder / "log"), name="told-b", part_bytes=2000, suffixes=[".scan", ".pdf"], first_page=2, last_page=3)
    rows = found.filter("source_name LIKE 'b%'").collect()
    assert [(r.source_name, r.page_number) for r in sorted(rows)] == [("big.scan", 2), ("big.scan", 3)]
    assert sorted(x for x in noted(folder) if x[0] == "read") == sorted([["read", "big.scan", 2], ["read", "big.scan", 3], *(["read", f"small{i}.SCAN", 2] for i in range(5))])
    assert "notes.txt" not in {x[1] for x in noted(folder)}
    assert pg.read_pages(spark, str(folder / "in"), Told(folder / "log"), name="told-d", suffixes=[".pdf"]).count() == 0


def test_one_read_takes_several_filters(spark, folder):
    found = pg.read_pages(spark, str(folder / "in"), Told(folder / "log"), name="told-e", suffixes=[".scan"])
    few, last = found.filter("page_number <= 2"), found.filter("page_number > 999")
    assert [few.count(), found.count(), last.count(), few.union(last).count()] == [12, 1010, 1, 13]


def test_scans_by_page_equal_scans_by_file(spark, folder, monkeypatch):
    """An engine that reads a page's words off its bytes."""

    def read(content, languages):
        return [(1, 1, 1, w, 10 * i, 5, 8, 10, "90") for i, w in enumerate(content.decode().split())] if content != b"second" else []

    found = pg.read_pages(spark, str(folder / "in"), Told(folder / "log"), name="told-c", part_bytes=2000, suffixes=[".scan"])
    results = {r.source_name: r for r in plans.process_pages(found, read=read, decode=bytes).collect()}
    assert len(results) == 6 and results["big.scan"].page_count == 1000
    assert results["small1.SCAN"].markdown == "only 1" and results["small1.SCAN"].notes == ["Page 2: no OCR lines found; check scan quality or OCR backend availability."]


def test_parquet_rows_are_pages(spark, tmp_path):
    spark.createDataFrame([(i, f"<p>{i}</p>" if i % 7 else None) for i in range(100)], "id long, html string").coalesce(1).sortWithinPartitions("id").write.parquet(str(tmp_path / "p.parquet"))
    found = pg.read_pages(spark, str(tmp_path / "p.parquet"), pg.ParquetRows(column="html"), name="rows-a", part_bytes=100)
    assert found.rdd.getNumPartitions() > 3
    got = {r.page_number: bytes(r.content).decode() for r in found.collect()}
    assert got == {i + 1: f"<p>{i}</p>" if i % 7 else "" for i in range(100)}


# --- OCR set-up -----------------------------------------------------------------


def engine(languages):
    def get_languages(config=""):
        if languages is None:
            raise RuntimeError("not installed")
        return languages

    return SimpleNamespace(get_languages=get_languages)


def test_languages_of_a_worker(tmp_path, monkeypatch):
    monkeypatch.delenv("TESSDATA_PREFIX", raising=False)
    assert ocr.tessdata_dir(tmp_path) is None
    assert ocr.available_languages(engine(["eng", "guj"])) == {"eng", "guj"} and ocr.available_languages(engine(None)) == {"eng"}
    (tmp_path / ".tessdata").mkdir()
    assert ocr.tessdata_dir(tmp_path) == tmp_path / ".tessdata"
    named = tmp_path / "named"
    monkeypatch.setenv("TESSDATA_PREFIX", str(named))
    assert ocr.tessdata_dir(tmp_path) == tmp_path / ".tessdata"
    named.mkdir()
    (named / "san.traineddata").touch()
    assert ocr.tessdata_dir(tmp_path) == named and ocr.available_languages(engine(["eng"])) == {"san"}
    assert ocr.chosen_languages(("gu", "san", "xx"), {"san"}) == ["san"] and ocr.chosen_languages(("gu",), {"eng"}) == ["eng"] and ocr.chosen_languages(("gu",), set()) == ["guj"]


def test_the_executable_is_found(tmp_path, monkeypatch):
    monkeypatch.setattr(ocr.shutil, "which", lambda name: None)
    assert ocr.find_tesseract((str(tmp_path / "none"), str(tmp_path))) == str(tmp_path) and ocr.find_tesseract(()) is None
    monkeypatch.setattr(ocr.shutil, "which", lambda name: "/usr/bin/it")
    assert ocr.find_tesseract(()) == "/usr/bin/it"


@pytest.mark.parametrize("text,backend,found,says", [("", "tesseract", None, ocr.NO_LAYER), ("ÐØÆ mojibake", "tesseract", None, ocr.GARBLED_LAYER), ("ÐØÆ", "easyocr", None, None), ("", "tesseract", "/bin/t", None), ("plain text", "tesseract", None, None)])
def test_workers_say_what_is_missing(spark, text, backend, found, says):
    layers = spark.createDataFrame([(1, text)], "doc_id long, text_layer string")
    checked = ocr.with_ocr(layers, backend, lambda: found)
    if says is None:
        assert checked.collect() == layers.collect()
    else:
        with pytest.raises(Exception, match=says.split(".")[0]):
            checked.collect()


def test_text_layers_and_images_of_pdfs(spark, monkeypatch):
    """A PDF library that takes pages from lines."""

    class Document:
        def __init__(self, stream, filetype):
            self.lines = stream.decode().split("\n")
            self.page_count = len(self.lines)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def __iter__(self):
            return iter(self.load_page(i) for i in range(self.page_count))

        def load_page(self, i):
            return SimpleNamespace(get_text=lambda kind: f" {self.lines[i]} ", get_pixmap=lambda matrix, alpha: SimpleNamespace(tobytes=lambda kind: f"{kind}:{self.lines[i]}:{matrix}".encode()))

    library = SimpleNamespace(open=lambda stream, filetype: Document(stream, filetype), Matrix=lambda x, y: round(x, 3))
    monkeypatch.setattr(ocr, "optional", lambda name: library if name == "fitz" else None)
    assert ocr.pdf_text_layer(b"one\n\ntwo") == "one\n\ntwo"
    document = Document(b"one\ntwo", "pdf")
    assert list(pg.PdfPages(document)) == [b"one", b"two"] and pg.PdfPages(document, library.Matrix(220 / 72, 1))[1] == b"png:two:3.056"
    monkeypatch.setattr(ocr, "optional", lambda name: None)
    assert ocr.pdf_text_layer(b"one") == ""
    assert ocr.tesseract_words(None, ("eng",)) == [] and ocr.paddle_lines([[0]]) == []
