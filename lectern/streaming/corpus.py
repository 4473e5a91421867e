"""A corpus that grows while it is asked: streams of files and of questions over a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.index import Index
from lectern.sources.files import utf8_ignoring_errors
from lectern.streaming.questions import asked


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text of the files that come into ``folder``; a file's id is a hash of its path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), utf8_ignoring_errors("content").alias("text"))


def index_stream(docs: DataFrame, index: Index, checkpoint: str) -> StreamingQuery:
    """Bring a stream of (doc_id, text) into the index; a batch that comes again changes nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        index.merge(batch, whole=False)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_of(index: Index, path: str, epoch: int) -> int:
    """The index version that a batch is answered with: the last one when it was first asked, ever after the same."""
    spark, at = index.spark, f"{path}/versions/epoch={epoch}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        spark.createDataFrame([(index.version(),)], "version int").coalesce(1).write.mode("overwrite").parquet(at)
    return spark.read.schema("version int").parquet(at).first().version


def answer_stream(questions: DataFrame, index: Index, path: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of (query_id, doc_id, query) into ``path``/answers, each batch with one version of the index.

    A batch that comes again after a restart is answered with the version that it had,
    and overwrites its own folder, so its rows are there once and the same.
    """

    def answer(batch: DataFrame, epoch: int) -> None:
        version = version_of(index, path, epoch)
        found = index.at(version).answers(asked(batch)).withColumn("version", F.lit(version))
        found.write.mode("overwrite").parquet(f"{path}/answers/epoch={epoch}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
