"""Audit of a feed that comes in batches: which matches are whole, partial or without balls, told once whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import ingest_log

c = F.col


def log_batch(batch: DataFrame, number: int, path: str, match: str = "match_id", item: str = "sequence") -> None:
    """For foreachBatch: what a batch brought, into the folder of its number.

    A batch that is replayed after a crash has its number again and takes the place of what was written, in part or
    whole, so the log holds each batch once.
    """
    seen = batch.select(c(match).alias("match_id"), c(item).alias("item")).filter("match_id is not null").distinct()
    seen.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def audit(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """match_id, items, balls, status (ok, partial, no_balls) of each expected match after all batches in the log.

    expected: match_id, items.  An item that several batches brought counts once.
    """
    items = spark.read.parquet(path).select("match_id", "item").distinct()
    return ingest_log(items, expected)


def compacted(spark: SparkSession, path: str, into: str) -> None:
    """The log of all batches as one table without repeats, for a log of very many batches."""
    spark.read.parquet(path).groupBy("match_id", "item").agg(F.min("batch").alias("batch")).write.mode("overwrite").partitionBy("batch").parquet(into)
