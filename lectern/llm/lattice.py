"""Subword lattices: the probability of a word over all its segmentations.

The pieces come from a fixed public vocabulary.  A word is written with the
vocabulary's word mark in front, so that pieces never span two words and the
probability of a text is the product over its words.  A character without a
piece of its own is one step of the unknown piece, spread over all code points.
With piece probabilities that sum to one, the forward recursion gives the exact
marginal probability of a word, in log space.

Many words are one numpy problem: nodes lie in one flat array, and arcs are
handled by their distance from the word's start.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
from sentencepiece import SentencePieceProcessor

from lectern.llm.common import CACHES, MEMO_BYTES, MEMO_ENTRIES

MARK = "▁"
CODE_POINTS = 0x110000
WORDS_AT_ONCE = 8192
CHARS_AT_ONCE = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _grown(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one code point longer."""
    return (hashes ^ points) * _FACTOR + (hashes >> np.uint64(29))


class Lattice:
    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.size, self.unknown = model.get_piece_size(), model.unk_id()
        self.pieces: dict[str, int] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or MARK in piece[1:]):
                self.pieces[piece] = i
        # All prefixes of pieces by their hash, with the piece that they are, or -1.
        prefixes = {piece[:n]: -1 for piece in self.pieces for n in range(1, len(piece) + 1)} | self.pieces
        hashes = np.zeros(len(prefixes), np.uint64)
        for n in range(max(map(len, prefixes))):
            own = [(k, ord(p[n])) for k, p in enumerate(prefixes) if len(p) > n]
            at, points = np.array(own).T
            hashes[at] = _grown(hashes[at], points.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.piece = hashes[order], np.fromiter(prefixes.values(), np.int64)[order]
        # Most strings are no prefix: a bit for each hash tells.
        self.may = np.zeros(1 << 21, bool)
        self.may[hashes >> np.uint64(43)] = True
        self.scores = np.array([model.get_score(i) for i in range(self.size)])
        # The vocabulary's own order as scores: a piece of rank r weighs 1 / (r + 1).
        weights = 1.0 / np.arange(1, self.size + 1)
        self.prior = np.log(weights / weights.sum())

    def step(self, log_p: np.ndarray) -> np.ndarray:
        """Log weight of an arc with each piece."""
        out = log_p.copy()
        out[self.unknown] -= np.log(CODE_POINTS)
        return out

    def arcs(self, words: list[bytes]) -> Arcs:
        """All pieces in the words: from every place on, prefixes of pieces grow by a character while there are any."""
        points = np.frombuffer(b" ".join([b"", *words]).decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
        begins = points == 32
        points[begins] = ord(MARK)
        word = np.cumsum(begins) - 1
        stop = np.append(np.flatnonzero(begins)[1:], len(points))[word]
        # A word has a node more than it has characters.
        at, hashes = np.arange(len(points)), np.zeros(len(points), np.uint64)
        starts, ends, pieces, n = [], [], [], 0
        while len(at):
            hashes = _grown(hashes, points[at + n])
            n += 1
            known = self.may[hashes >> np.uint64(43)]
            place = np.searchsorted(self.hashes, hashes[known])
            place[place == len(self.hashes)] = 0
            known[known] = self.hashes[place] == hashes[known]
            piece = np.full(len(at), -1)
            piece[known] = self.piece[np.searchsorted(self.hashes, hashes[known])]
            if n == 1:  # a character that is no piece is one step of the unknown piece
                piece[piece < 0] = self.unknown
            found = piece >= 0
            starts.append(at[found] + word[at[found]])
            ends.append(starts[-1] + n)
            pieces.append(piece[found])
            on = known & (at + n < stop[at])
            at, hashes = at[on], hashes[on]
        sizes = np.bincount(word, minlength=len(words)) + 1
        return Arcs(*(np.concatenate([np.empty(0, np.int64), *x]) for x in (starts, ends, pieces)), sizes)


class Arcs:
    """The arcs of some words' lattices."""

    def __init__(self, starts, ends, pieces, sizes):
        self.nodes = int(sizes.sum())
        self.first = np.cumsum(sizes) - sizes
        self.last = self.first + sizes - 1
        self.starts, self.ends, self.pieces = starts, ends, pieces
        self.word = np.repeat(np.arange(len(sizes)), sizes)[starts] if len(starts) else starts

    def _levels(self, at: np.ndarray, forward: bool):
        """Runs of arcs whose node ``at`` lies as far from the word's start, with the bounds of each node."""
        distance = at - self.first[self.word]
        order = np.lexsort((at, distance if forward else -distance))
        distance, at = distance[order], at[order]
        cuts = np.flatnonzero(np.diff(distance)) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(order)]):
            here = at[lo:hi]
            yield order[lo:hi], here, np.concatenate([[0], np.flatnonzero(np.diff(here)) + 1])

    def forward(self, step: np.ndarray) -> np.ndarray:
        """Log mass that reaches each node; ``step`` has one column for each model."""
        alpha = np.full((self.nodes, step.shape[1]), -np.inf)
        alpha[self.first] = 0
        if len(self.ends):
            for arcs, node, bounds in self._levels(self.ends, True):
                mass = alpha[self.starts[arcs]] + step[self.pieces[arcs]]
                alpha[node[bounds]] = np.logaddexp.reduceat(mass, bounds, axis=0)
        return alpha

    def backward(self, step: np.ndarray) -> np.ndarray:
        beta = np.full((self.nodes, step.shape[1]), -np.inf)
        beta[self.last] = 0
        if len(self.ends):
            for arcs, node, bounds in self._levels(self.starts, False):
                mass = beta[self.ends[arcs]] + step[self.pieces[arcs]]
                beta[node[bounds]] = np.logaddexp.reduceat(mass, bounds, axis=0)
        return beta

    def expected(self, step: np.ndarray, weight: np.ndarray, pieces: int) -> np.ndarray:
        """Expected uses of each piece for each model, words weighted by ``weight`` (words x models)."""
        alpha, beta = self.forward(step), self.backward(step)
        total = alpha[self.last]
        share = np.exp(alpha[self.starts] + step[self.pieces] + beta[self.ends] - total[self.word]) * weight[self.word]
        return np.stack([np.bincount(self.pieces, share[:, k], pieces) for k in range(step.shape[1])], axis=1)


def word_runs(words: list[bytes]):
    """Slices of words sorted by length, so that a run has few levels; yields positions."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    start, total = 0, 0
    for i, n in enumerate(sizes[order].tolist()):
        if i > start and (i - start >= WORDS_AT_ONCE or total + n > CHARS_AT_ONCE):
            yield order[start:i]
            start, total = i, 0
        total += n
    if start < len(order):
        yield order[start:]


def word_log_p(lattice: Lattice, words: list[bytes], step: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability (words x models)."""
    out = np.empty((len(words), step.shape[1]))
    for run in word_runs(words):
        arcs = lattice.arcs([words[i] for i in run])
        out[run] = arcs.forward(step)[arcs.last]
    return out


def expected_uses(lattice: Lattice, words: list[bytes], weight: np.ndarray, step: np.ndarray) -> np.ndarray:
    out = np.zeros((lattice.size, step.shape[1]))
    for run in word_runs(words):
        out += lattice.arcs([words[i] for i in run]).expected(step, weight[run], lattice.size)
    return out


class WordScores:
    """Rows of scores for the words met so far; starts over when they are full."""

    def __init__(self, lattice: Lattice, step: np.ndarray, most: int = MEMO_ENTRIES, most_bytes: int = MEMO_BYTES):
        self.lattice, self.step, self.most, self.most_bytes = lattice, step, most, most_bytes
        self.rows: dict[bytes, int] = {}
        self.bytes = 0
        self.values = np.empty((1 << 12, step.shape[1]))

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row for each of the words."""
        new = list(set(words) - self.rows.keys())
        if self.rows and (len(self.rows) + len(new) > self.most or self.bytes > self.most_bytes):
            self.rows, self.bytes = {}, 0
            new = list(set(words))
        if new:
            old, size = len(self.rows), len(self.rows) + len(new)
            if size > len(self.values):
                self.values = np.concatenate([self.values[:old], np.empty((max(size, 2 * len(self.values)) - old, self.step.shape[1]))])
            self.values[old:size] = word_log_p(self.lattice, new, self.step)
            self.rows.update(zip(new, range(old, size), strict=True))
            self.bytes += sum(map(len, new))
        return self.values[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


@lru_cache(maxsize=2)
def loaded(path: str) -> Lattice:
    return Lattice(path)


CACHES.append(loaded.cache_clear)
