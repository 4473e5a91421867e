"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities over the pieces of a fixed public
vocabulary, learned by expectation-maximisation from labelled documents.  A
text's score in a language is the sum over its words of the log probability of
the word over all segmentations (forward algorithm); the prediction is the best
language, its posterior under equal priors is the score.

The labelled rows are sampled by a hash of the id down to about
``max_train_docs`` in all, each language by itself (the documented bound of the fit); the model is bounded by
vocabulary times languages, and only that goes to the driver.  Prediction reads
the text alone.

Defined cases: null text, empty text and text without a letter are ``und`` with
score 0; ties go to the first language in alphabetical order; with no labelled
rows all is ``und``; repeated rows are predicted alike; texts are used whole.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import lattice as lat
from lectern.llm.common import held, raw_texts, text_chunks

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: Pseudo-uses of the pooled distribution in each language.
SMOOTHING = 200.0


@dataclass(frozen=True)
class Model:
    path: str
    languages: tuple[str, ...]
    step: np.ndarray  # pieces x languages
    key: str
    #: Whether the last column of ``step`` is of no language, but of the vocabulary as such.
    guarded: bool = False


def train(docs: DataFrame, path: str, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_train_docs: int = 20_000, rounds: int = 2) -> Model:
    labelled = sampled(docs, text, lang, doc_id, max_train_docs)
    lattice = lat.loaded(path)
    pooled, languages = lattice.prior, ()
    step = lattice.step(pooled)[:, None]
    for _ in range(rounds):
        uses = _uses(labelled, path, step, languages)
        languages = tuple(sorted({r[0] for r in uses}))
        if not languages:
            break
        count = np.zeros((lattice.size, len(languages)))
        for language, piece, n in uses:
            count[piece, languages.index(language)] = n
        pooled = count.sum(axis=1) + 0.01
        pooled /= pooled.sum()
        count += SMOOTHING * pooled[:, None]
        step = lattice.step(np.log(count / count.sum(axis=0)))
    return Model(path, languages, step, uuid.uuid4().hex)


def guarded(model: Model) -> Model:
    """The model with a background beside its languages: the whole vocabulary, weighed by its own order.

    A text that no learned language makes likelier than the background does is in none of
    them, however much likelier one of them is than the others.
    """
    lattice = lat.loaded(model.path)
    step = np.concatenate([model.step.reshape(lattice.size, -1), lattice.step(lattice.prior)[:, None]], axis=1)
    return replace(model, step=step, key=f"{model.key}-guarded", guarded=True)


def sampled(docs: DataFrame, text: str, lang: str, doc_id: str, most: int) -> DataFrame:
    """_text, _lang of labelled rows, by a hash of the id down to about ``most``, as many of each language if it has them."""
    labelled = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(F.col(doc_id)).alias("_h")).filter("_text IS NOT NULL AND _lang IS NOT NULL")
    counts = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}
    each = max(1, most // max(1, len(counts)))
    shares = [F.lit(x) for language, n in counts.items() if n > each for x in (language, int(each / n * (1 << 30)))]
    if shares:
        labelled = labelled.filter(F.pmod("_h", F.lit(1 << 30)) < F.coalesce(F.try_element_at(F.create_map(*shares), "_lang"), F.lit(1 << 30)))
    return labelled.select("_text", "_lang")


def _uses(labelled: DataFrame, path: str, step: np.ndarray, languages: tuple[str, ...]) -> list:
    """Expected uses of pieces by language; all languages share one model until each has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = lat.loaded(path), {}
        for chunk in text_chunks(batches, "_text"):
            words: dict[str, Counter] = {}
            for raw, language in zip(raw_texts(chunk.column("_text")), chunk.column("_lang").to_pylist(), strict=True):
                words.setdefault(language, Counter()).update(raw.lower().split())
            for language, count in words.items():
                own = step[:, [languages.index(language)]] if language in languages else step[:, :1]
                found = lat.expected_uses(lattice, list(count), np.fromiter(count.values(), np.float64, len(count))[:, None], own)[:, 0]
                total[language] = total.get(language, 0) + found
        for language, uses in total.items():
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(uses[at])], names=["lang", "piece", "n"])

    return labelled.mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n")).collect()


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score for every row."""
    return determined(docs, model, keep, text).toDF(*keep, "lang_pred", "score")


def identified(docs: DataFrame, model: Model, *, text: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is determined with a score of at least ``least_score``."""
    found = determined(docs, model, tuple(docs.columns), text)
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).drop("lang_pred", "score").toDF(*docs.columns)


def determined(docs: DataFrame, model: Model, keep: tuple[str, ...], text: str) -> DataFrame:
    """``keep`` columns as c0, c1 and so on (any name may come along), lang_pred and score."""
    own = docs.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(keep)), F.col(text).alias("_text"))
    schema = own.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "_text"):
            predicted, score = predict(model, raw_texts(chunk.column("_text")))
            yield pa.RecordBatch.from_arrays([*(chunk.column(f"c{i}") for i in range(len(keep))), pa.array(predicted, pa.string()), pa.array(score)], names=schema.names)

    return own.mapInArrow(run, schema)


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    sums = log_likelihoods(model, texts)
    known = np.array([LETTER.search(raw.decode("utf-8", "replace")) is not None for raw in texts], bool)
    if model.guarded:
        sums, background = sums[:, :-1], sums[:, -1]
        known &= sums.max(axis=1) >= background
    sums = sums - sums.max(axis=1, keepdims=True)
    share = np.exp(sums)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known.tolist(), strict=True)], np.where(known, share[np.arange(len(best)), best], 0.0)


def log_likelihoods(model: Model, texts: list[bytes]) -> np.ndarray:
    """Log probability of each text in each language, and in the background if there is one."""
    scores = held(("words", model.key), lambda: lat.WordScores(lat.loaded(model.path), model.step))
    split = [raw.lower().split() for raw in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    values = scores.of(list(itertools.chain.from_iterable(split)))
    sums = np.zeros((len(texts), model.step.shape[1]))
    if full := np.flatnonzero(sizes).tolist():
        sums[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], axis=0)
    return sums
