"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's score is linear in its own features and in those
of the lines before and after it; a chain over the document's lines adds what one
label says about the next.  Forward-backward gives each line's marginal, and a
document's quality is the mean marginal, weighted by length and calibrated by two
numbers.

Labels mark documents, not lines.  So lines begin with their document's label, and
in a bad document those of its better half that a first fit of lines by themselves
finds good become good.  The fit reads a sample of labelled rows, bounded by ``max_train_docs`` and
``max_train_lines`` (as many of each label if there are); all else covers all rows.

Sums over chains are segmented scans of 2 x 2 matrices by doubling, so a document of
a million lines takes twenty steps, not a million.

Defined cases: a null or empty text is one empty line; repeated rows score alike;
labels without a value are left out, and a document labelled twice has the lower one;
with no labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import raw_texts, text_chunks

#: Kinds of bytes that are counted in a line.
LOWER, UPPER, WIDE, DIGIT, BLANK, SENTENCE, SHOUT, SYMBOL, INNER = range(9)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[ord("a") : ord("z") + 1] = LOWER
KIND[ord("A") : ord("Z") + 1] = UPPER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[0x80:0xC0] = INNER  # inside a character
KIND[0xC0:] = WIDE
for signs, kind in ((b" \t\r\x0b\x0c", BLANK), (b".,;:'\"()-", SENTENCE), (b"!?", SHOUT)):
    KIND[list(signs)] = kind
#: Features of a line: a one, shares of the kinds, length, words, ends and beginning, repetition.
FEATURES = 18
#: Share of good, by its own features, above which a line of a bad document counts as good.
LEAST_GOOD = 0.5
RIDGE = 0.01


@dataclass(frozen=True)
class Model:
    #: Weights of the features of the line, the one before and the one after (3 x FEATURES).
    weights: np.ndarray
    #: What label a before label b adds (2 x 2); calibration: slope and intercept.
    moves: np.ndarray
    slope: float
    intercept: float


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (lines x FEATURES), the lines' number in their text, and each line's characters."""
    whole = b"\n".join(texts) + b"\n"
    data = np.frombuffer(whole, np.uint8)
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    kinds = KIND[data]
    counts = np.empty((len(stop), 9))
    for kind in range(9):
        to = np.concatenate([[0], np.cumsum(kinds == kind)])
        counts[:, kind] = to[stop] - to[start]
    chars = counts[:, :INNER].sum(axis=1)
    per_text = np.fromiter((x.count(b"\n") + 1 for x in texts), np.int64, len(texts))
    first = np.cumsum(per_text) - per_text
    number = np.arange(len(stop)) - np.repeat(first, per_text)
    words, distinct, again = (np.zeros(len(stop)) for _ in range(3))
    at = 0
    for text in texts:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            own = line.split()
            words[at], distinct[at] = len(own), len(set(own))
            if own:
                again[at] = line in seen
                seen.add(line)
            at += 1
    out = np.empty((len(stop), FEATURES))
    size, n = np.maximum(chars, 1), np.maximum(words, 1)
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, WIDE]
    out[:, 0] = 1
    out[:, 1:9] = counts[:, :INNER] / size[:, None]
    out[:, 9] = np.log1p(chars) / 8
    out[:, 10] = np.minimum(letters / n / 10, 3)
    out[:, 11] = 1 - distinct / n
    out[:, 12] = (1 - distinct / n) * np.minimum(np.log1p(words) / 4, 1.5)
    out[:, 13] = again
    filled = stop > start
    ends, begins = kinds[np.maximum(stop - 1, 0)], kinds[np.minimum(start, len(kinds) - 1)]
    out[:, 14] = filled & (ends == SENTENCE)
    out[:, 15] = filled & ((begins == UPPER) | (begins == WIDE))
    out[:, 16] = words == 0
    out[:, 17] = np.minimum(counts[:, SYMBOL] / n, 3)
    return out, number, chars


def neighbours(features: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of the line before and after each line, zeros where there is none."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    inside = number[1:] > 0
    before[1:][inside] = features[:-1][inside]
    after[:-1][inside] = features[1:][inside]
    return before, after


def scan(steps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Logarithms of the products of each segment's matrices (n x 2 x 2, logarithms) from its begin to each place."""
    out, reach = steps.copy(), 1
    while len(place) and reach <= place.max():
        at = np.flatnonzero(place >= reach)
        left, right = out[at - reach], out[at]
        out[at] = np.logaddexp(left[:, :, :1] + right[:, :1, :], left[:, :, 1:] + right[:, 1:, :])
        reach *= 2
    return out


def chains(score: np.ndarray, moves: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of good for each line, expected label pairs (2 x 2), and the sum of the log partition functions."""
    local = np.stack([np.zeros_like(score), score], axis=1)
    steps = moves[None] + local[:, None, :]
    steps[number == 0] = local[number == 0][:, None, :]
    ahead = scan(steps, number)[:, 0, :]
    # From the end back: what follows each line is the product of the later lines' steps.
    last = np.append(number[1:] == 0, True) if len(number) else np.zeros(0, bool)
    left = _left(number)
    later = np.empty_like(steps)
    later[:-1] = steps[1:].transpose(0, 2, 1)
    later[last] = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)
    back = np.logaddexp.reduce(scan(later[::-1], left[::-1])[::-1], axis=1)
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    if (at := np.flatnonzero(number > 0)).size:
        joint = ahead[at - 1][:, :, None] + steps[at] + back[at][:, None, :] - total[at][:, None, None]
        pairs = np.exp(joint).sum(axis=0)
    return np.exp(both[:, 1] - total), pairs, float(total[last].sum())


def _left(number: np.ndarray) -> np.ndarray:
    """How many lines of its text come after each line."""
    begins = np.flatnonzero(number == 0)
    sizes = np.diff(np.append(begins, len(number)))
    return np.repeat(sizes, sizes) - 1 - number


def minimised(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """A minimum of a smooth convex function by limited-memory quasi-Newton steps with halving."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            kept.append(a)
            way -= a * y
        way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += s * (a - y @ way / (s @ y))
        step, slope = 1.0, g @ way
        while step > 1e-8:
            new = x - step * way
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = f - f_new < 1e-7 * abs(f)
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def fitted(features: np.ndarray, number: np.ndarray, labels: np.ndarray, chars: np.ndarray) -> Model:
    """``labels``: of each line, its document's."""
    before, after = neighbours(features, number)
    every = np.concatenate([features, before, after], axis=1)
    width = every.shape[1]
    # A document counts as one.
    sizes = np.repeat(_left(number)[number == 0] + 1, _left(number)[number == 0] + 1)

    def alone(x: np.ndarray) -> tuple[float, np.ndarray]:
        score = features @ x
        miss = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - good
        return float((weight * (np.logaddexp(0, score) - good * score)).sum() + RIDGE / 2 * x @ x), features.T @ (weight * miss) + RIDGE * x

    good, weight = labels.astype(np.float64), 1 / sizes
    share = 1 / (1 + np.exp(-np.clip(features @ minimised(alone, np.zeros(FEATURES)), -500, 500)))
    # Half of a bad document's lines at least, the worse ones, stay bad.
    begins = np.flatnonzero(number == 0)
    order = np.lexsort((share, np.repeat(begins, sizes[begins])))
    better = np.empty(len(share), bool)
    better[order] = number >= (sizes + 1) // 2
    good = np.where((labels == 0) & better & (share > LEAST_GOOD), 1.0, good)
    at = np.flatnonzero(number > 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[at - 1].astype(int), good[at].astype(int)), 1)

    def chain(x: np.ndarray) -> tuple[float, np.ndarray]:
        moves, score = x[width:].reshape(2, 2), every @ x[:width]
        share, pairs, total = chains(score, moves, number)
        value = total - good @ score - (seen * moves).sum() + RIDGE / 2 * x @ x
        return float(value), np.concatenate([every.T @ (share - good), (pairs - seen).ravel()]) + RIDGE * x

    x = minimised(chain, np.zeros(width + 4))
    weights, moves = x[:width], x[width:].reshape(2, 2)
    mean = averaged(chains(every @ weights, moves, number)[0], number, chars)
    label = labels[begins].astype(np.float64)

    def calibrated(x: np.ndarray) -> tuple[float, np.ndarray]:
        score = x[0] * mean + x[1]
        miss = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - label
        return float((np.logaddexp(0, score) - label * score).sum() + 0.05 * x @ x), np.array([miss @ mean, miss.sum()]) + 0.1 * x

    slope, intercept = minimised(calibrated, np.zeros(2))
    return Model(weights, moves, max(float(slope), 0.0), float(intercept))


def averaged(share: np.ndarray, number: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Mean of the lines' marginals in each text, by characters; the line end is one."""
    begins, weight = np.flatnonzero(number == 0), chars + 1
    return np.add.reduceat(share * weight, begins) / np.add.reduceat(weight, begins) if len(begins) else np.zeros(0)


def scored(model: Model | None, texts: list[bytes]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    features, number, chars = lines_of(texts)
    score = sum(part @ w for part, w in zip((features, *neighbours(features, number)), model.weights.reshape(3, FEATURES), strict=True))
    mean = averaged(chains(score, model.moves, number)[0], number, chars)
    return 1 / (1 + np.exp(-(model.slope * mean + model.intercept)))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train_docs: int = 6000, max_train_lines: int = 150_000) -> Model | None:
    """Learned from about ``max_train_docs`` labelled documents, and no more lines than ``max_train_lines`` and one document's."""
    marked = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL").groupBy("_id").agg(F.min("_label").alias("_label"))
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    if not counts:
        return None
    each = max_train_docs // len(counts)
    order = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    share = F.try_element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int(each / n * (1 << 30)))))), "_label")
    # About max_train_docs rows of two numbers.
    chosen = F.broadcast(marked.filter(order < share).withColumn("_order", order))
    own = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(chosen, "_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "_text"):
            features, number, chars = lines_of(raw_texts(chunk.column("_text")))
            cuts = np.append(np.flatnonzero(number == 0), len(number)).tolist()
            packed = [[x[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x in (features, chars)]
            yield pa.RecordBatch.from_arrays([chunk.column("_order"), chunk.column("_label"), *(pa.array(x, pa.binary()) for x in packed)], names=["at", "label", "features", "chars"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, chars, labels, n = [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist() if n < max_train_lines else ():
                features.append(np.frombuffer(row["features"], np.float32).reshape(-1, FEATURES))
                chars.append(np.frombuffer(row["chars"], np.float32))
                labels.append(row["label"])
                n += len(chars[-1])
                if n >= max_train_lines:
                    break
        if features:
            sizes = [len(x) for x in chars]
            number = np.concatenate([np.arange(x) for x in sizes])
            found = fitted(np.concatenate(features).astype(np.float64), number, np.repeat(np.array(labels) > 0, sizes), np.concatenate(chars).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([found.weights, found.moves.ravel(), [found.slope, found.intercept]]).tolist()], pa.list_(pa.float64()))], names=["model"])

    sample = own.select("_order", "_label", "_text").mapInArrow(measure, "at long, label int, features binary, chars binary")
    rows = sample.repartition(1).sortWithinPartitions("at", "label", F.xxhash64("features")).mapInArrow(fit, "model array<double>").collect()
    if not rows:
        return None
    x = np.array(rows[0].model)
    return Model(x[: 3 * FEATURES], x[-6:-2].reshape(2, 2), x[-2], x[-1])


def score_documents(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the score (0 to 1) of every text."""
    own = docs.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(keep)), F.col(text).alias("_text"))
    schema = own.drop("_text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "_text"):
            score = scored(model, raw_texts(chunk.column("_text")))
            yield pa.RecordBatch.from_arrays([*(chunk.column(f"c{i}") for i in range(len(keep))), pa.array(score)], names=schema.names)

    return own.mapInArrow(run, schema).toDF(*keep, "score")
