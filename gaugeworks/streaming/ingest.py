"""Structured Streaming ingest: messages to tables, and idempotent appends.

Every micro-batch overwrites its own ``batch=<id>`` folder, so a batch replayed after a failure leaves the
tables as if it had run once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.tables import DAY, days_of, on_days, open_table, unseen
from ..sources.messages import hood_rows, rejects, water_rows, decode


def _batch_folder(path: str, table: str, batch: int) -> str:
    return f"{path}/{table}/batch={batch}"


def ingest_messages(stream: DataFrame, payload: str, out: str, checkpoint: str) -> StreamingQuery:
    """Messages to ``water``, ``hood`` and ``rejects`` tables under ``out``; runs until the input is used up."""

    def write(df: DataFrame, batch: int) -> None:
        decoded = decode(df, payload).persist()
        try:
            for table, rows in (("water", water_rows(decoded)), ("hood", hood_rows(decoded)), ("rejects", rejects(decoded, payload))):
                rows.write.mode("overwrite").parquet(_batch_folder(out, table, batch))
        finally:
            decoded.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new(stream: DataFrame, keys: list[str], ts: str, delay: str, path: str, checkpoint: str, tie: list[str] | None = None) -> StreamingQuery:
    """Append rows whose keys are not stored yet; repeats inside the watermark never reach the table.

    The table ``rows`` under ``path`` lies in partitions of (day of ``ts``, batch), and ``ts`` must be one of the keys.  A batch reads
    the stored keys of its own days only and replaces its own partitions, so its replay after a failure changes nothing.
    """
    if ts not in keys or {DAY, "batch"} & set(stream.columns):
        raise ValueError(f"the time must be one of the keys, and {DAY} and batch are the table's own columns")
    once = stream.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(keys).drop("_event_time")
    table = f"{path}/rows"

    def write(df: DataFrame, batch: int) -> None:
        dated = df.withColumn(DAY, F.col(ts).cast("date")).where(F.col(DAY).isNotNull()).persist()
        try:
            stored = open_table(df.sparkSession, table)
            known = dated.limit(0) if stored is None else on_days(stored, days_of(dated)).where(F.col("batch") < batch)
            fresh = unseen(dated, known, [*keys, DAY], tie).withColumn("batch", F.lit(batch))
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "batch").parquet(table)
        finally:
            dated.unpersist()

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
