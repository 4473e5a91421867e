"""Shuffle files of stored tables go with the write."""

import re
import time

from pyspark.sql import functions as F

from lectern.functions import shuffles
from lectern.llm.common import forget, stored


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(",")))


def left(spark, before):
    """Files that are new, after the little time that their removal may take."""
    for _ in range(50):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_a_stored_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7).repartition(4, "x").mapInArrow(lambda batches: batches, "id long, x long")
    before, setting = shuffle_files(spark), spark.conf.get(shuffles.CLEANUP)
    one = stored(df, "shuffled")
    assert not left(spark, before)
    assert spark.conf.get(shuffles.CLEANUP) == setting
    # What was written once can be written again, and other actions keep theirs.
    two = stored(df.union(one), "shuffled")
    assert (one.count(), two.count(), df.count()) == (1000, 2000, 1000)
    assert not left(spark, before | shuffle_files(spark))
    forget(one, two)
