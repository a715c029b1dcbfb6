"""Stored steps of the corpus operators."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from reviewops.llm.common import SHUFFLE_CLEANUP, written


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {f for f in files.split() if "/shuffle_" in f}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    was, before = spark.conf.get(SHUFFLE_CLEANUP), shuffle_files(spark)
    counted = spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).count().orderBy("k")
    stored = written(counted, "counted")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    # what was stored, and the frame it came from, can still be read
    assert stored.count() == counted.count() == 5000 and spark.conf.get(SHUFFLE_CLEANUP) == was
