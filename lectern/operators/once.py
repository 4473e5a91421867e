"""Costly results by content: computed once for each different text, and kept in a stored table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

KEPT = "key string, batch string, attempts int, error string, value "


def key_of(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def kept(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What the table at ``path`` has, failures included; nothing before its first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], KEPT + kind)
    return spark.read.schema(KEPT + kind).parquet(path)


def computed_once(texts: DataFrame, load: Callable[[], Callable[[str], object]], kind: str, path: str, *, text: str = "text", in_flight: int = 8, tries: int = 3) -> DataFrame:
    """key, value, error, attempts for each different ``text``: of the table at ``path``, or computed now and added to it.

    ``load`` gives a worker its function; ``kind`` is the type of its values.  Texts are
    told apart by SHA-256, deduplicated, and anti-joined with what the table has, before
    any is computed.  As many tasks run at a time as calls may be in flight, and a call
    that fails is tried again up to ``tries`` times.  A text that failed counts as not
    computed, so a later batch tries it again, alone; its error is given with this batch.
    """
    spark = texts.sparkSession
    batch = uuid.uuid4().hex
    done = kept(spark, path, kind)
    wanted = texts.select(key_of(F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["key"])
    missing = wanted.join(done.filter("error IS NULL").select("key"), "key", "left_anti")
    arrow = to_arrow_type(T._parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = load()
        for part in batches:
            rows = []
            for key, value in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                for attempt in range(1, tries + 1):
                    try:
                        rows.append((key, batch, attempt, None, compute(value)))
                        break
                    except Exception as error:  # whatever the call raises is kept with its text
                        if attempt == tries:
                            rows.append((key, batch, attempt, str(error), None))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), arrow]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "batch", "attempts", "error", "value"])

    missing.repartition(in_flight, "key").mapInArrow(run, KEPT + kind).write.mode("append").parquet(path)
    every = kept(spark, path, kind).filter((F.col("error").isNull()) | (F.col("batch") == batch))
    # Two writers may have computed one text.
    found = every.groupBy("key").agg(F.min_by(F.struct("value", "error", "attempts"), F.struct(F.col("error").isNotNull(), "batch")).alias("x")).select("key", "x.*")
    return wanted.select("key").join(found, "key")
