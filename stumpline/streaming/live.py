"""Structured Streaming forms of the ordered-event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def timed(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time with a watermark (timestamps without zone are taken as UTC)."""
    return events.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, late)


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so that a feed may be read again."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_runs(events: DataFrame, value: str, ts: str = "ts", length: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Events and sum of a value in tumbling or sliding windows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = timed(events, ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(c("w.start").alias("start"), c("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with pauses below the gap."""
    out = timed(events, ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, c("w.start").alias("start"), c("w.end").alias("end"), "n")


def running_totals(events: DataFrame, keys: list[str], runs: str, wicket: str) -> DataFrame:
    """Score so far of every key, updated with each batch (output mode update or complete)."""
    return events.groupBy(*keys).agg(F.sum(runs).alias("runs"), F.count_if(c(wicket)).alias("wickets"), F.count(F.lit(1)).alias("balls"))
