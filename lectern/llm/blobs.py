"""Shuffles of packed rows.

Operators that deal out many small keyed entries pack those of one chunk and one
hash part into a few byte columns.  A hundred thousand entries then cost Spark
one row, and a key that is everywhere adds one entry a chunk at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash


def part_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % parts


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the given ranges, one after the other."""
    done = np.cumsum(sizes)
    return np.repeat(starts - done + sizes, sizes) + np.arange(done[-1] if len(done) else 0)


def unpacked(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """All rows' bytes as one array."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
