"""Token counts without the tokens.

Arrow batches are cut to equal bytes.  A text is split where it is safe: at the
ASCII spaces that the vocabulary's own splitter drops, across which no token,
special string or Unicode composition reaches.  The pieces that a worker has
not met are encoded by the library in one batch, and only lengths are kept.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows give
repeated rows; a long text without any space is split where no token can reach across; nothing
is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe
from lectern.llm.common import MEMO_BYTES, MEMO_ENTRIES, held, raw_texts, text_chunks

#: Pieces that go to the library at once: bounds the memory of its encodings.
BATCH_PIECES, BATCH_BYTES = 4096, 1 << 18
#: Bytes of a piece beyond which it is split further, between symbols that no token has side by side.
LONG_PIECE = 1 << 16


def loaded(path: str) -> tuple[Tokenizer, dict[bytes, int]]:
    return held(("tokenizer", path), lambda: (Tokenizer.from_file(path), {}))


def piece_batches(pieces: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of pieces of about the same bytes."""
    start, total = 0, 0
    for i, piece in enumerate(pieces):
        if i > start and (i - start >= BATCH_PIECES or total + len(piece) > BATCH_BYTES):
            yield pieces[start:i]
            start, total = i, 0
        total += len(piece)
    if start < len(pieces):
        yield pieces[start:]


def lengths_of(path: str, tokenizer: Tokenizer, known: dict[bytes, int], texts: list[bytes]) -> list[int]:
    """Tokens of each text; ``known`` keeps what pieces have given."""
    if len(known) > MEMO_ENTRIES or sum(map(len, known)) > MEMO_BYTES:
        known.clear()
    split = [text.split() for text in texts]
    new = sorted({piece for pieces in split for piece in pieces if piece not in known})
    # The library needs much memory for one very long word.
    known.update((piece, len(bpe.loaded(path)[0].encode(piece.decode("utf-8", "replace")))) for piece in new if len(piece) > LONG_PIECE)
    new = [piece for piece in new if len(piece) <= LONG_PIECE]
    for run in piece_batches(new):
        found = tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in run], add_special_tokens=False)
        known.update(zip(run, map(len, found), strict=True))
    return [sum(map(known.__getitem__, pieces)) for pieces in split]


def token_counts(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 2048) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) for every row."""
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = loaded(path)
        for chunk in text_chunks(batches, "_text"):
            texts = raw_texts(chunk.column("_text"))
            n = np.array(lengths_of(path, tokenizer, known, texts), np.int64)
            yield pa.RecordBatch.from_arrays([*(chunk.column(k) for k in keep), pa.array([len(x) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
