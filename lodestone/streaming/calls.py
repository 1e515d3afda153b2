"""An extension: the call log as a stream. Nothing else needs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import govern


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the call log's files as they come."""
    return spark.readStream.schema(govern.CALLS).json(folder)


def daily_counts(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls of each day and status; a day is closed once its lateness has passed."""
    timed = calls.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day"), "status").agg(F.count("*").alias("n"), F.sum("secs").alias("secs"))


def to_table(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Closed days are appended, once each; their state is dropped."""
    return counts.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
