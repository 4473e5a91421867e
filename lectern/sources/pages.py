"""Pages of files as a data source: a file of many pages is read by several tasks.

Planning lists files with their sizes and opens none; a large file is several
partitions, each of which counts the file's pages and takes its own share of them, and
small files share one.  Suffixes and a range of pages are options of the read, and are
looked at before a file is opened or a page is read.  (Filters that Spark pushes into a
Python source stay in it from one scan of a DataFrame to the next, so none are taken.)

How files are listed and opened is a reader's matter: ``Files`` goes through pyarrow's
file systems; another (a store of one's own, an engine) is given to ``page_source``.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

PAGES = "path string, source_name string, suffix string, page_number int, page_count int, content binary"
#: Bytes of files for each partition.
PART_BYTES = 16 << 20


class Reader(Protocol):
    """Both methods run in workers and on the driver's worker, so a reader must be picklable."""

    def files(self, path: str) -> Iterable[tuple[str, int]]:
        """Path and size of each file."""

    def open(self, path: str) -> AbstractContextManager[Sequence[bytes]]:
        """The file's pages; one is read when it is asked for."""


class PdfPages(Sequence):
    """Pages of a PDF as PNG images, or as their text layer."""

    def __init__(self, document, matrix=None):
        self.document, self.matrix = document, matrix

    def __len__(self) -> int:
        return self.document.page_count

    def __getitem__(self, i: int) -> bytes:
        page = self.document.load_page(i)
        if self.matrix is None:
            return page.get_text("text").strip().encode()
        return page.get_pixmap(matrix=self.matrix, alpha=False).tobytes("png")


@dataclass(frozen=True)
class Files:
    """A folder's files: pages of PDFs as images at ``dpi`` (None: their text), any other file as one page."""

    dpi: int | None = 220

    def files(self, path: str) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File:
                yield (f"{path.split('://')[0]}://{info.path}" if "://" in path else info.path), info.size

    @contextmanager
    def open(self, path: str) -> Iterator[Sequence[bytes]]:
        from pyarrow import fs

        from lectern.sources.ocr import optional

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(inner) as file:
            content = file.read()
        if not path.lower().endswith(".pdf"):
            yield [content]
            return
        if (fitz := optional("fitz")) is None:
            raise RuntimeError("PyMuPDF is required for PDF input.")
        with fitz.open(stream=content, filetype="pdf") as document:
            yield PdfPages(document, None if self.dpi is None else fitz.Matrix(self.dpi / 72, self.dpi / 72))


@dataclass
class Share(ds.InputPartition):
    """Parts of files: path, which part, of how many."""

    parts: list[tuple[str, int, int]]


def _names(path: str) -> tuple[str, str]:
    name = path.rsplit("/", 1)[-1]
    return name, (f".{name.rsplit('.', 1)[1]}".lower() if "." in name else "")


class PageReader(ds.DataSourceReader):
    def __init__(self, reader: Reader, options: dict):
        self.reader, self.path, self.part_bytes = reader, options["path"], int(options.get("part_bytes", PART_BYTES))
        self.suffixes = tuple(x for x in options.get("suffixes", "").lower().split(",") if x)
        self.first, self.last = int(options.get("first_page", 1)), int(options.get("last_page", 1 << 31))

    def partitions(self) -> list[Share]:
        shares, held = [], 0
        small: list[tuple[str, int, int]] = []
        for path, size in sorted(self.reader.files(self.path)):
            if self.suffixes and _names(path)[1] not in self.suffixes:
                continue
            n = math.ceil(size / self.part_bytes)
            if n > 1:
                shares += [Share([(path, i, n)]) for i in range(n)]
                continue
            if small and held + size > self.part_bytes:
                shares.append(Share(small))
                small, held = [], 0
            small, held = [*small, (path, 0, 1)], held + size
        return [*shares, *([Share(small)] if small else [])] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path, part, of in partition.parts:
            with self.reader.open(path) as pages:
                n = len(pages)
                for i in range(max(part * n // of, self.first - 1), min((part + 1) * n // of, self.last)):
                    yield (path, *_names(path), i + 1, n, pages[i])


def page_source(reader: Reader, short_name: str) -> type[ds.DataSource]:
    """A data source of ``PAGES`` under a name of its own; options: path, part_bytes, suffixes (by commas), first_page, last_page."""

    class PageSource(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> PageReader:
            return PageReader(reader, self.options)

    return PageSource


def read_pages(spark: SparkSession, path: str, reader: Reader = Files(), *, name: str = "pages", part_bytes: int = PART_BYTES, suffixes: Sequence[str] = (), first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """``PAGES`` of the files under ``path`` with one of ``suffixes``, from ``first_page`` to ``last_page``; all without these."""
    spark.dataSource.register(page_source(reader, name))
    options = {"part_bytes": part_bytes, "suffixes": ",".join(suffixes), "first_page": first_page} | ({} if last_page is None else {"last_page": last_page})
    return spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load(path)


class Rows(Sequence):
    """The values of one column of a Parquet file, a row group at a time."""

    def __init__(self, file, column: str):
        self.file, self.column = file, column
        self.ends: list[int] = []
        for i in range(file.num_row_groups):
            self.ends.append((self.ends[-1] if i else 0) + file.metadata.row_group(i).num_rows)
        self.held: tuple[int, list] = (-1, [])

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, i: int) -> bytes:
        group = bisect_right(self.ends, i)
        if self.held[0] != group:
            self.held = group, self.file.read_row_group(group, columns=[self.column]).column(0).to_pylist()
        value = self.held[1][i - (self.ends[group - 1] if group else 0)]
        return value if isinstance(value, bytes) else (value or "").encode()


@dataclass(frozen=True)
class ParquetRows(Files):
    """Archives of pages: every row of a Parquet file is a page, its ``column`` the content."""

    column: str = "content"

    def files(self, path: str) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        info = system.get_file_info(root)
        found = [(path, info.size)] if info.type == fs.FileType.File else super().files(path)
        return ((p, size) for p, size in found if p.endswith(".parquet"))

    @contextmanager
    def open(self, path: str) -> Iterator[Sequence[bytes]]:
        from pyarrow import fs, parquet

        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(inner) as file:
            yield Rows(parquet.ParquetFile(file), self.column)
