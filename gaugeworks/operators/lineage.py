"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FOLDER_CONF = "spark.checkpoint.dir"
_scopes: list[list[tuple[str, StructType]]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder the session names for checkpoints; a temporary one only for an unset local session."""
    folder = spark.conf.get(FOLDER_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {FOLDER_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="gaugeworks-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder name that no other table has, in the shared folder."""
    return f"{shared_folder(spark)}/gaugeworks/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame once as a table in the shared folder and go on from its files.

    Unlike a checkpoint this runs the plan one time, and later reads take only the columns they need.
    Lost executors cost nothing but their running tasks.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    if _scopes:
        _scopes[-1].append((path, df.schema))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are emptied at the end, also after a failure.

    Frames made inside read them, so a result must be written or collected before the scope ends.  Scopes nest; each
    empties its own tables.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path, schema in _scopes.pop():
            # Spark's writer is the one way to delete that works on any store the folder may lie in.
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
