"""Shuffle files of finished jobs."""

from __future__ import annotations

import gc
import time

from pyspark.sql import SparkSession


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of jobs whose result has been written as a table.

    The cleaner acts on what the driver's garbage collector has found, in its own thread.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)
