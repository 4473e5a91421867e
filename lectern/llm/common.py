"""What the operators of this folder share: tables, shared scratch space, batches.

Texts cross into Python as Arrow batches.  ``text_chunks`` cuts those into
pieces of about equal bytes, so that a run of very long documents needs no more
memory than a run of short ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import shuffles

CHUNK_BYTES = 4 << 20
#: Entries, and bytes of their keys, that a worker's memo may hold before it starts over.
MEMO_ENTRIES, MEMO_BYTES = 1 << 18, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, *, large: bool = False, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, drops shuffle files.

    Only ``large`` tables are compressed: each column of each file takes native memory for that.
    ``files`` bounds the number of files of a table whose size is known.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df if files is None else df.coalesce(files)
    with shuffles.dropped(spark):
        df.write.option("compression", "zstd" if large else "uncompressed").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    SCRATCH[path] = out
    return out


#: The tables that are stored now, in the order in which they came.
SCRATCH: dict[str, DataFrame] = {}


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """A ``stored`` table under other column names."""
    out = df.toDF(*names)
    out.stored_at = df.stored_at
    return out


def _path(df: DataFrame):
    """File system and path of a ``stored`` table."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def forget(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that no later step reads."""
    for df in tables:
        files, path = _path(df)
        files.delete(path, True)
        SCRATCH.pop(df.stored_at, None)


#: The most that is broadcast; beyond it Spark joins by shuffling both sides.
BROADCAST_BYTES = 32 << 20


def checked(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A ``stored`` table marked for broadcast if its measured size allows, else as it is.

    Measured are the files and, as these are packed, 16 bytes for each value of each row.
    """
    files, path = _path(df)
    size = max(2 * files.getContentSummary(path).getLength(), 16 * len(df.columns) * df.count())
    return F.broadcast(df) if size <= most else df


#: Bytes of input for each part that a shuffle deals out.
PART_BYTES = 16 << 20


def partitions(docs: DataFrame) -> int:
    """Parts to deal out what comes of ``docs``: as many as its bytes need, the session's setting at least."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Tables of unknown size report an absurd one.
    return max(least, -(-size // PART_BYTES)) if size < 1 << 58 else least


def fold_is(col, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def text_chunks(batches: Iterable[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < len(sizes):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(sizes.searchsorted(done + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_held: dict = {}


def held(key, make):
    """What a worker keeps from task to task: the one thing made last, so that operators do not add up their memos."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


#: What empties the caches of modules that hold much.
CACHES: list = []


def release() -> None:
    """Give back to the system what other operators' tasks have left in this worker."""
    if not _held:
        return
    _held.clear()
    for clear in CACHES:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """A dict that computes what it lacks, bounded by entries and by the length of keys.

    It holds two generations of half that size.  When the young one is full it becomes the
    old one, and what is asked for again comes back from there; so common keys stay.
    """

    def __init__(self, make, most: int = MEMO_ENTRIES, most_bytes: int = MEMO_BYTES):
        super().__init__()
        self.make, self.most, self.most_bytes, self.bytes, self.old = make, most // 2, most_bytes // 2, 0, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most or self.bytes >= self.most_bytes:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self[key] = out
        self.bytes += len(key)
        return out
