"""The same plans over streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import append_results


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def appending(df: DataFrame, path: str, key, checkpoint: str):
    """Starts an append of each micro-batch; a batch that is replayed adds no row twice."""
    return (
        df.writeStream.foreachBatch(lambda batch, _: append_results(batch, path, key))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def sessions(events: DataFrame, series: str, ts: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Runs of events with at most ``gap`` between them, with a watermark; for batches and streams."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(series, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return out.select(series, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
