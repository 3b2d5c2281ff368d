"""A revision log fed by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch once: a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Changes by key and tumbling window; what is later than the watermark is dropped with its state."""
    rows = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return rows.groupBy(F.window("__t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
