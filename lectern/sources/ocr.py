"""OCR: words to lines as DataFrame operations; engines as optional adapters.

Engines run in ``mapInArrow`` on page images, imported in the worker; where one
is missing a page yields no words, as an engine that fails does.
"""

from __future__ import annotations

import importlib
import io
import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import text as tx

BINARISE_ABOVE = 170
WORDS = "doc_id long, page_number int, seq int, block_num int, par_num int, line_num int, text string, left int, top int, width int, height int, conf string"
LINES = "doc_id long, page_number int, line_no int, text string, bbox array<int>, confidence double"


@dataclass(frozen=True)
class OcrConfig:
    backend: str = "tesseract"
    language_hints: tuple[str, ...] = ("eng", "guj", "san")
    render_dpi: int = 220


def valid_words(words: DataFrame) -> DataFrame:
    """Words with text and a confidence of 0 or more; one that is no number counts as -1."""
    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    return words.withColumn("confidence", conf).filter((F.trim("text") != "") & (F.col("confidence") >= 0))


def lines_of_words(words: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no, text, bbox, confidence: words of one line from left to right."""
    own = F.sort_array(F.collect_list(F.struct("left", "seq", F.trim("text").alias("text"))))
    box = F.array(F.min("left"), F.min("top"), F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height")))
    keys = ("doc_id", "page_number", "block_num", "par_num", "line_num")
    lines = valid_words(words).groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"), box.alias("bbox"), F.avg("confidence").alias("confidence"))
    # Number the few lines of a page by their place, in order of their keys.
    number = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("block_num", "par_num", "line_num"))
    return lines.select("doc_id", "page_number", number.alias("line_no"), "text", "bbox", "confidence")


def polygon_bbox(points: Column) -> Column:
    """Bounding box of an array of points."""
    side = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    return F.transform(F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1))), lambda x: x.cast("int"))


def normal_languages(hints: Column) -> Column:
    known = lex.lookup(lex.LANGUAGE_ALIASES)
    found = F.array_distinct(F.array_compact(F.transform(hints, lambda x: known[F.lower(x)])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("eng")))


def easyocr_languages(hints: Column) -> Column:
    known = lex.lookup(lex.EASYOCR_LANGUAGES)
    found = F.array_distinct(F.transform(hints, lambda x: F.coalesce(known[F.lower(x)], F.lit("en"))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("en")))


def paddle_language(hints: Column) -> Column:
    return F.lit("en")


def usable_languages(hints: Column, available: Column) -> Column:
    """Requested languages that are installed; else English if it is, else the first requested."""
    wanted = normal_languages(hints)
    both = F.array_intersect(wanted, available)
    return F.when(F.size(both) > 0, both).when(F.array_contains(available, "eng"), F.array(F.lit("eng"))).otherwise(F.slice(wanted, F.lit(1), F.lit(1)))


# Where an installer puts the executable, besides the search path.
TESSERACT_PLACES = (r"C:\Program Files\Tesseract-OCR\tesseract.exe", r"C:\Program Files (x86)\Tesseract-OCR\tesseract.exe", str(Path.home() / "AppData" / "Local" / "Programs" / "Tesseract-OCR" / "tesseract.exe"))
# What is said where there is nothing to read and nothing to read it with.
GARBLED_LAYER = "PDF text layer appears garbled and Tesseract is not installed. Install Tesseract OCR to extract clean Gujarati/Sanskrit text."
NO_LAYER = "No usable text was found and Tesseract is not installed. Install Tesseract OCR and try again."


def find_tesseract(candidates: tuple[str, ...] = TESSERACT_PLACES) -> str | None:
    return shutil.which("tesseract") or next((c for c in candidates if Path(c).exists()), None)


def tessdata_dir(project: Path = Path(__file__).resolve().parents[2]) -> Path | None:
    """The language files that the environment names, else those in the project's own folder."""
    named = os.environ.get("TESSDATA_PREFIX")
    places = [Path(named)] if named else []
    return next((x for x in [*places, project / ".tessdata"] if x.exists()), None)


def available_languages(engine) -> set[str]:
    """Languages that this worker's engine can read; English if it doesn't tell."""
    folder = tessdata_dir()
    if found := {x.stem for x in folder.glob("*.traineddata")} if folder else set():
        return found
    try:
        return set(engine.get_languages(config=""))
    except Exception:  # an engine that can't be asked
        return {"eng"}


def chosen_languages(hints: tuple[str, ...], available: set[str]) -> list[str]:
    """As ``usable_languages``, on a worker."""
    wanted = list(dict.fromkeys(lex.LANGUAGE_ALIASES[x.lower()] for x in hints if x.lower() in lex.LANGUAGE_ALIASES)) or ["eng"]
    return [x for x in wanted if x in available] or (["eng"] if "eng" in available else wanted[:1])


def need_ocr(text_layer: str, backend: str, tesseract: str | None) -> None:
    """Raises where a file has to be read by tesseract and there is none."""
    if backend == "tesseract" and tesseract is None:
        raise RuntimeError(GARBLED_LAYER if text_layer.strip() else NO_LAYER)


def with_ocr(layers: DataFrame, backend: str, find: Callable[[], str | None] = find_tesseract) -> DataFrame:
    """``layers`` (doc_id, text_layer), as they are; the worker that has a text to be read asks its own machine for the executable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, unread in zip(batch.column("text_layer").to_pylist(), batch.column("_unread").to_pylist(), strict=True):
                if unread:
                    need_ocr(text or "", backend, find())
            yield batch.drop_columns(["_unread"])

    own = layers.select("doc_id", "text_layer").withColumn("_unread", tx.garbled(F.coalesce("text_layer", F.lit(""))))
    return own.mapInArrow(run, own.drop("_unread").schema)


def optional(name: str):
    try:
        return importlib.import_module(name)
    except Exception:  # an optional engine that can't load is an absent one
        return None


def preprocess(image):
    """Rotate as told, gray, median of 3 x 3, full contrast, black and white."""
    ops, filters = importlib.import_module("PIL.ImageOps"), importlib.import_module("PIL.ImageFilter")
    gray = ops.grayscale(ops.exif_transpose(image).convert("RGB")).filter(filters.MedianFilter(size=3))
    return ops.autocontrast(gray).point(lambda px: 255 if px > BINARISE_ABOVE else 0)


def pages_of(content: bytes, name: str, dpi: int):
    """Images of a file's pages."""
    image = importlib.import_module("PIL.Image")
    if not name.lower().endswith(".pdf"):
        return [image.open(io.BytesIO(content)).convert("RGB")]
    fitz = optional("fitz")
    if fitz is None:
        raise RuntimeError("PyMuPDF is required for PDF input.")
    with fitz.open(stream=content, filetype="pdf") as document:
        maps = [page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72), alpha=False) for page in document]
        return [image.frombytes("RGB", (m.width, m.height), m.samples) for m in maps]


def pdf_text_layer(content: bytes) -> str:
    fitz = optional("fitz")
    if fitz is None:
        return ""
    with fitz.open(stream=content, filetype="pdf") as document:
        texts = [page.get_text("text").strip() for page in document]
    return "\n\n".join(t for t in texts if t)


def text_layers(files: DataFrame) -> DataFrame:
    """doc_id, text_layer of PDFs (doc_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pdf_text_layer(x) for x in batch.column("content").to_pylist()], pa.string())], names=["doc_id", "text_layer"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, text_layer string")


def tesseract_words(image, languages: tuple[str, ...]) -> list[tuple]:
    engine = optional("pytesseract")
    if engine is None:
        return []
    if not shutil.which("tesseract") and (found := find_tesseract()):
        engine.pytesseract.tesseract_cmd = found
    folder = tessdata_dir()
    config = "--oem 3 --psm 6" + (f' --tessdata-dir "{folder}"' if folder else "")
    lang = "+".join(chosen_languages(languages, available_languages(engine)))
    try:
        data = engine.image_to_data(preprocess(image), lang=lang, config=config, output_type=engine.Output.DICT)
    except Exception:  # an engine that fails reads nothing
        return []
    names = ("block_num", "par_num", "line_num", "text", "left", "top", "width", "height", "conf")
    return list(zip(*(data[k] for k in names), strict=True))


@lru_cache(maxsize=4)
def _easyocr(languages: tuple[str, ...]):
    engine = optional("easyocr")
    return engine and engine.Reader(list(languages), gpu=False)


@lru_cache(maxsize=1)
def _paddle():
    engine = optional("paddleocr")
    return engine and engine.PaddleOCR(use_angle_cls=True, lang="en")


def easyocr_lines(image, languages: tuple[str, ...]) -> list[tuple]:
    """(polygon, text, confidence); one reader a worker."""
    import numpy as np

    reader = _easyocr(languages)
    return [] if reader is None else [(p, t, c) for p, t, c in reader.readtext(np.array(image)) if t.strip()]


def paddle_lines(image) -> list[tuple]:
    import numpy as np

    reader = _paddle()
    return [] if reader is None else [(p, t[0], t[1]) for page in reader.ocr(np.array(image), cls=True) or [] for p, t in page or [] if t[0].strip()]


def opened(content: bytes):
    """A page image of its bytes."""
    return importlib.import_module("PIL.Image").open(io.BytesIO(content)).convert("RGB")


def page_words(pages: DataFrame, config: OcrConfig = OcrConfig(), read: Callable | None = None, decode: Callable | None = None) -> DataFrame:
    """``WORDS`` of page images (doc_id, page_number, content), a page at a time."""
    read, decode = read or tesseract_words, decode or opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, page, content in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "page_number", "content")), strict=True):
                rows = [(doc, page, seq, *where, text, *box, str(conf)) for seq, (*where, text, b0, b1, b2, b3, conf) in enumerate(read(decode(content), config.language_hints)) for box in [(b0, b1, b2, b3)]]
                kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), *[pa.int32()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split(" ")[0] for x in WORDS.split(", ")])

    return pages.select("doc_id", "page_number", "content").mapInArrow(run, WORDS)


def recognised_words(files: DataFrame, config: OcrConfig = OcrConfig(), read: Callable | None = None) -> DataFrame:
    """``WORDS`` of files (doc_id, source_name, content).  ``read(image, languages)`` gives the engine's words."""
    read = read or tesseract_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, name, content in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "source_name", "content")), strict=True):
                for page, image in enumerate(pages_of(content, name, config.render_dpi), 1):
                    for seq, (block, par, line, text, left, top, width, height, conf) in enumerate(read(image, config.language_hints)):
                        rows.append((doc, page, seq, block, par, line, text, left, top, width, height, str(conf)))
            kinds = [pa.int64(), *[pa.int32()] * 5, pa.string(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split(" ")[0] for x in WORDS.split(", ")])

    return files.mapInArrow(run, WORDS)


def recognised_lines(files: DataFrame, config: OcrConfig) -> DataFrame:
    """``LINES`` by the configured engine; any name but easyocr and paddleocr means tesseract."""
    if config.backend not in ("easyocr", "paddleocr"):
        return lines_of_words(recognised_words(files, config))
    languages = tuple(dict.fromkeys(lex.EASYOCR_LANGUAGES.get(x.lower(), "en") for x in config.language_hints)) or ("en",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, name, content in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "source_name", "content")), strict=True):
                for page, image in enumerate(pages_of(content, name, config.render_dpi), 1):
                    found = easyocr_lines(image, languages) if config.backend == "easyocr" else paddle_lines(image)
                    for n, (points, text, conf) in enumerate(found):
                        xs, ys = zip(*((int(x), int(y)) for x, y in points), strict=True)
                        rows.append((doc, page, n, text.strip(), [min(xs), min(ys), max(xs), max(ys)], float(conf)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[x.split(" ")[0] for x in LINES.split(", ")])

    return files.mapInArrow(run, LINES)
