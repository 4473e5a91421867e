"""BPE encoding and decoding by backtracking over longest matches.

A word's symbols are its byte characters, the last one carrying the end mark.
An Aho-Corasick automaton over the vocabulary gives, for every position, the
tokens that start there.  The encoder takes the longest one that is compatible
with its left neighbour, and backs up when none is; a sequence whose neighbours
are all compatible is the one that the merges produce, so the result is exact
and every position is refused at most once.  Two tokens are compatible when
merging their joined symbols gives just these two; a table holds the verdicts.
A verdict comes from what stands at the border over time: the pieces at the
left token's right edge and at the right token's left edge, each from the merge
that makes it to the merge that absorbs it.

Decoding gathers token strings from one byte table through an offset table.

Defined cases: null or empty text has no tokens; repeated rows give repeated
rows; other columns are not read; a text is never cut.  Special strings are taken
one after the other, however many there are; a very long word is encoded in parts
between symbols that no token has side by side, which gives the same ids.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lectern.llm.common import MEMO_ENTRIES, Memo, held, raw_texts, text_chunks

END = "</w>"
#: Added to the code point of a word's last character: one symbol for "x</w>".
LAST = 0x10000
NEVER = 1 << 60
#: Latin letters, which have no other normal form, and marks after them, which are a word of their own; an apostrophe may begin a contraction.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
#: Symbols beyond which a word is split where it may be.
LONG_WORD = 4096


class Bpe:
    """Encoder and decoder for a ``tokenizers`` file of BPE with word ends and byte-level characters."""

    def __init__(self, path: str):
        # The file's own normaliser and word splitter run in the library; the merges and ids are ours.
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        vocab = model["vocab"]
        self.ids = {self._symbols(token): i for token, i in vocab.items()}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self._symbols(a), self._symbols(b)] = rank
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.parts = {}
        for (a, b), rank in self.ranks.items():
            self.parts.setdefault(a + b, (a, b, rank))
        self.matcher, self.inside = ahocorasick.Automaton(), set()
        for symbols in self.ids:
            if self._merged(symbols) == [symbols]:
                self.matcher.add_word(symbols, symbols)
                self.inside.update(zip(symbols, symbols[1:], strict=False))
        self.matcher.make_automaton()
        self.right_edge = Memo(lambda token: self._edge(token, 1), 2 * len(self.ids))
        self.left_edge = Memo(lambda token: self._edge(token, 0), 2 * len(self.ids))
        self.compatible = Memo(self._compatible)
        self.words = Memo(self.encode_symbols, MEMO_ENTRIES // 4)
        # Letters as the splitter writes their bytes.
        latin = [chr(i) for i in range(0xDF, 0x100) if i != 0xF7]
        self.letters = {ord(c): self.split(c)[0][0] for c in latin}
        texts = {i: token for token, i in vocab.items()} | {i: text for text, i in self.special.items()}
        pieces = [texts.get(i, "").encode() for i in range(max(texts) + 1)]
        self.table = np.frombuffer(b"".join(b" " + p for p in pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])

    @staticmethod
    def _symbols(token: str) -> str:
        if not token.endswith(END) or token == END:
            return token
        token = token[: -len(END)]
        return token[:-1] + chr(ord(token[-1]) + LAST)

    @staticmethod
    def _last(word: str) -> str:
        """A word's symbols."""
        return word[:-1] + chr(ord(word[-1]) + LAST)

    def _merged(self, symbols: str) -> list[str]:
        """The merges by rank, plainly; only single tokens and pairs of tokens come here."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """Pieces at one edge of a token, smallest first, each with the rank that absorbs it."""
        edge, until = [], NEVER
        while token in self.parts:
            edge.append((token, until))
            until = self.parts[token][2]
            token = self.parts[token][side]
        return [*edge, (token, until)][::-1]

    def _compatible(self, pair: tuple[str, str]) -> bool:
        left, right = self.right_edge[pair[0]], self.left_edge[pair[1]]
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            # Of equal ranks the leftmost merge comes first.
            rank = self.ranks.get((a, b), NEVER)
            if rank < a_until and rank <= b_until and rank != NEVER:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one word given as symbols."""
        ids, compatible, size = self.ids, self.compatible, len(symbols)
        if symbols in ids and symbols in self.matcher:
            return [ids[symbols]]
        starts: list[list[str]] = [[] for _ in range(size + 1)]
        for end, token in self.matcher.iter(symbols):
            starts[end + 1 - len(token)].append(token)  # shorter ones first
        path: list[str] = []
        rest: list[list[str]] = []  # what each start on the path has not tried yet
        closed: set[int] = set()
        pos, tries, before = 0, starts[0], ""
        while pos < size:
            while tries:
                token = tries.pop()
                if pos + len(token) not in closed and (not pos or compatible[before, token]):
                    path.append(token)
                    rest.append(tries)
                    pos += len(token)
                    tries, before = starts[pos].copy(), token
                    break
            else:
                closed.add(pos)
                if not path:
                    raise ValueError("no segmentation: the vocabulary lacks a byte")
                pos -= len(path.pop())
                tries, before = rest.pop(), path[-1] if path else ""
        return [ids[token] for token in path]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special strings in it taken as special tokens."""
        out: list[int] = []
        done = 0
        for found in itertools.chain(self.specials.finditer(text), [None]):
            for word, _ in self.split(self.normalize(text[done : found.start() if found else len(text)])):
                symbols = self._last(word)
                if len(symbols) <= LONG_WORD:
                    out += self.words[symbols]
                else:
                    for part in self.parts_of(symbols):
                        out += self.encode_symbols(part)
            if found:
                out.append(self.special[found[0]])
                done = found.end()
        return out

    def parts_of(self, symbols: str) -> Iterator[str]:
        """Parts of a long word that no merge can join: no token has the two symbols at the border side by side."""
        start, inside = 0, self.inside
        for i in range(LONG_WORD, len(symbols)):
            if i - start >= LONG_WORD and (symbols[i - 1], symbols[i]) not in inside:
                yield symbols[start:i]
                start = i
        yield symbols[start:]

    def encode_word(self, raw: bytes) -> bytes:
        """Ids of a text without white space, as bytes."""
        text = raw.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(text) if len(raw) <= LONG_WORD else None
        if plain:  # one place to split
            ids = self.words[self._last(plain[1].lower().translate(self.letters))]
            if plain[2]:
                ids = ids + self.words[self._last(plain[2])]
        else:
            ids = self.encode(text)
        return array("I", ids).tobytes()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Token strings joined by one space, as UTF-8."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        done = np.cumsum(size)
        return self.table[np.repeat(start - done + size, size) + np.arange(done[-1])].tobytes()[1:]


def loaded(path: str) -> tuple[Bpe, Memo]:
    """One encoder a worker, with its memo of words: spaces end words, and no token spans one."""

    def make() -> tuple[Bpe, Memo]:
        bpe = Bpe(path)
        return bpe, Memo(bpe.encode_word)

    return held(("bpe", path), make)


def encode_documents(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ids array<int> and decoded string for every row of ``docs``."""
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return _encoded(docs, path, keep, text, schema, _full_columns)


def encode_digests(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """As ``encode_documents``, with n_tokens and SHA-256 of ids and decoded text; the ids only if asked for."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if not with_ids:
        return _encoded(docs, path, keep, text, schema, _digest_columns)
    schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return _encoded(docs, path, keep, text, schema, lambda bpe, ids: [*_digest_columns(bpe, ids), _id_column(ids)])


def _encoded(docs, path, keep, text, schema, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = loaded(path)
        get = memo.__getitem__
        for chunk in text_chunks(batches, "_text"):
            ids = [b"".join(map(get, raw.split())) for raw in raw_texts(chunk.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(chunk.column(k) for k in keep), *columns(bpe, ids)], names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def _digest_columns(bpe: Bpe, ids: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(bpe.decode_bytes(_ids(x))).hexdigest() for x in ids], pa.string()),
    ]


def _id_column(ids: list[bytes]) -> pa.Array:
    return pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))


def _full_columns(bpe: Bpe, ids: list[bytes]) -> list[pa.Array]:
    return [_id_column(ids), pa.array([bpe.decode_bytes(_ids(x)).decode() for x in ids], pa.string())]
