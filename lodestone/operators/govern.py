"""Calls to outside services as relations: cache keys, daily quota, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUL = "\u0000"
#: Fixed value: the schema version in cache keys.
SCHEMA_VERSION = "3"
CALLS = "ts string, agent string, backend string, model string, prompt_chars bigint, secs double, status string, input_tokens bigint, output_tokens bigint"
#: Outcomes of a diagnosis, from best to worst.
STATUSES = ("ok", "info", "warn", "error")


def cache_key(prompt: Column, model: Column, backend: Column, inputs: Column) -> Column:
    parts = [prompt, F.lit(NUL), model, F.lit(NUL), backend, F.lit(NUL), inputs, F.lit(NUL), F.lit(SCHEMA_VERSION)]
    return F.sha2(F.concat(*parts), 256)


def cached(requests: DataFrame, entries: DataFrame, disabled: bool = False, no_read: bool = False) -> DataFrame:
    """requests(key) with the cached text, null where there is none. entries(key, text, and ord where a key may be stored twice: the last stands)."""
    if disabled or no_read:
        return requests.withColumn("text", F.lit(None).cast("string"))
    last = F.max_by("text", "ord") if "ord" in entries.columns else F.max("text")
    return requests.join(entries.groupBy("key").agg(last.alias("text")), "key", "left")


def day(ts: Column) -> Column:
    return F.date_format(F.to_timestamp(ts), "yyyy-MM-dd")


def daily(calls: DataFrame) -> DataFrame:
    return calls.groupBy(day(F.col("ts")).alias("date")).agg(F.count("*").alias("n"))


def admitted(calls: DataFrame, cap: int, *order: str) -> DataFrame:
    """calls with admitted: the first ``cap`` of each day are.

    Ranks are bucketed by minute: a running sum over the minutes of a day, then a rank in the minute, so a day's calls are never in one task.
    """
    rows = calls.withColumn("date", day(F.col("ts"))).withColumn("minute", F.date_trunc("minute", F.to_timestamp("ts")))
    minutes = rows.groupBy("date", "minute").agg(F.count("*").alias("n"))
    minutes = minutes.select("date", "minute", (F.sum("n").over(W.partitionBy("date").orderBy("minute")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("date", "minute").orderBy("ts", *order))
    ranked = rows.withColumn("rank", rank).join(minutes, ["date", "minute"])
    return ranked.withColumn("admitted", F.col("before") + F.col("rank") <= cap).drop("rank", "before", "minute")


def audit(calls: DataFrame) -> DataFrame:
    """agent, status, calls and seconds."""
    return calls.groupBy("agent", "status").agg(F.count("*").alias("calls"), F.round(F.sum("secs"), 6).alias("secs"))


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def run_stats(calls: DataFrame, hits: DataFrame) -> DataFrame:
    """calls made, cache hits and the seconds they saved. hits: secs."""
    made = calls.agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum("secs"), F.lit(0.0)), 6).alias("secs"))
    return made.crossJoin(hits.agg(F.count("*").alias("hits"), F.round(F.coalesce(F.sum("secs"), F.lit(0.0)), 6).alias("saved_secs")))


def worst(checks: DataFrame) -> DataFrame:
    """The worst status of checks(status)."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return checks.agg(F.max_by("status", rank).alias("status"))


def last_call(calls: DataFrame) -> DataFrame:
    """How many, and the one of the latest line. calls: line and the record."""
    record = F.struct(*(c for c in calls.columns if c != "line"))
    return calls.agg(F.count("*").alias("n"), F.max_by(record, "line").alias("last"))
