"""Structured Streaming forms of the append, upsert and resume operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators.reshape import upsert


def stream_upsert(events: DataFrame, base: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """IO-11 per micro-batch: version n+1 of the table at base is version n with the batch upserted.

    Versions are folders; a batch that is run again after a failure writes the same version anew, so
    the result is exactly-once. Ends when the available input is used up.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates()
        if epoch:
            new = upsert(spark.read.parquet(f"{base}/v{epoch - 1}"), new, keys)
        else:
            new = upsert(new.limit(0), new, keys)
        new.write.mode("overwrite").parquet(f"{base}/v{epoch}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Append log to counts per window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))
