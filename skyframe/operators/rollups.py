"""Materialised rollups: a log of the buckets that new rows touch, refresh of those alone, and reads that add the open buckets.

A store holds finished buckets, all that lie before ``upto``; what comes later is open and is rolled up when it is read.
Rows that come late touch finished buckets. The log says which, so a refresh reads and replaces these and no others, as
long as they are not older than ``start_offset``; later still, a row is left out, as the reference's policies leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import rollup


def bucket_of(seconds: int, time: str = "timestamp") -> Column:
    return (F.floor(F.col(time) / seconds) * seconds).cast("double")


def finished_before(now: float, seconds: int, end_offset: float) -> float:
    """The end of the last bucket that is finished: at least ``end_offset`` seconds old."""
    return (now - end_offset) // seconds * seconds


def touched(rows: DataFrame, seconds: int) -> DataFrame:
    """(bucket): what a batch of rows adds to the log. Partial aggregates make it one row a bucket and task."""
    return rows.select(bucket_of(seconds).alias("bucket")).distinct()


def due(log: DataFrame, seconds: int, now: float, start_offset: float, end_offset: float) -> DataFrame:
    """(bucket): the logged buckets that a refresh makes again: finished ones that still take late rows."""
    lo, hi = finished_before(now, seconds, start_offset), finished_before(now, seconds, end_offset)
    return log.select("bucket").filter((F.col("bucket") >= lo) & (F.col("bucket") < hi)).distinct()


def refresh(store: DataFrame, positions: DataFrame, log: DataFrame, seconds: int, now: float, start_offset: float, end_offset: float) -> DataFrame:
    """The store with the due buckets made again from the positions.

    Positions are cut to the span of time that can be due before anything else, so that old files are skipped by their bounds, and
    then to the due buckets, a small table that Spark broadcasts if it is.
    """
    again = due(log, seconds, now, start_offset, end_offset)
    lo, hi = finished_before(now, seconds, start_offset), finished_before(now, seconds, end_offset)
    rows = positions.filter((F.col("timestamp") >= lo) & (F.col("timestamp") < hi)).withColumn("bucket", bucket_of(seconds))
    fresh = rollup(rows.join(again, "bucket", "left_semi").drop("bucket"), seconds)
    return store.join(again, "bucket", "left_anti").select(fresh.columns).unionByName(fresh)


def real_time(store: DataFrame, positions: DataFrame, seconds: int, upto: float) -> DataFrame:
    """Every bucket: finished ones from the store, those from ``upto`` on from the positions themselves."""
    return store.filter(F.col("bucket") < upto).unionByName(rollup(positions.filter(F.col("timestamp") >= upto), seconds))
