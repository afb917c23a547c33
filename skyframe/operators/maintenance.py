"""Table jobs: retention, thinning, phantoms, schema, layout. Each returns the table's new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prune(table: DataFrame, hours: float, now: float, time: str = "timestamp") -> DataFrame:
    return table.filter(F.col(time) >= now - hours * 3600)


def downsample(positions: DataFrame, older_than_hours: float, interval: float, now: float) -> DataFrame:
    """Of rows older than the cutoff, the one with the largest id in each interval of each aircraft; newer rows stay."""
    cutoff = now - older_than_hours * 3600
    old, new = positions.filter(F.col("timestamp") < cutoff), positions.filter(F.col("timestamp") >= cutoff)
    bucket = F.floor(F.col("timestamp") / interval)
    kept = old.groupBy("icao", bucket.alias("__b")).agg(F.max_by(F.struct(*positions.columns), "id").alias("r")).select("r.*")
    return kept.unionByName(new)


def tiered_retention(positions: DataFrame, now: float, delete_hours: float = 72, thin_hours: float = 24, interval: float = 30) -> DataFrame:
    return downsample(prune(positions, delete_hours, now), thin_hours, interval, now)


def phantoms(aircraft: DataFrame, positions: DataFrame, min_age_hours: float, now: float) -> DataFrame:
    """Aircraft that never had a position and weren't heard from for so long."""
    return aircraft.filter(F.col("last_seen") < now - min_age_hours * 3600).join(positions.select("icao").distinct(), "icao", "left_anti")


def prune_phantoms(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    return {name: t.join(gone.select("icao"), "icao", "left_anti") for name, t in tables.items()}


def add_missing_column(table: DataFrame, name: str, kind: T.DataType | str) -> DataFrame:
    return table if name in table.columns else table.withColumn(name, F.lit(None).cast(kind))


def compact(positions: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrites a table by day, sorted by aircraft and newest time, so that files prune by their minima and maxima.

    Rows are dealt to ranges of (day, aircraft, time), so that a long day is written by many tasks, a busy aircraft's too,
    and each file covers a span of aircraft that only touches its neighbours'.
    """
    order = ["dt", "icao", F.col("timestamp").desc()]
    rows = positions.withColumn("dt", F.to_date(F.timestamp_seconds("timestamp"))).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("dt").parquet(path)
