"""Heatmaps, rollups, statistics and upserts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import clock


def event_time(time: str = "timestamp") -> Column:
    """Epoch seconds as a timestamp, to the microsecond."""
    return F.timestamp_micros(F.round(F.col(time) * 1_000_000).cast("long"))


def heatmap_density(positions: DataFrame, minutes: float, resolution: float, now: float | None = None, limit: int | None = 5000) -> DataFrame:
    """Cells of rounded coordinates with count and mean altitude (cut to a whole number), densest first."""
    rows = positions.filter(F.col("timestamp") >= clock(positions, now) - minutes * 60)
    cell = [F.round(F.col(c) / resolution).cast("long").alias(f"{c}_cell") for c in ("lat", "lon")]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("cnt"), F.avg("altitude_ft").cast("int").alias("avg_altitude"))
    cells = cells.withColumns({c: F.col(f"{c}_cell") * F.lit(resolution) for c in ("lat", "lon")})
    cells = cells.orderBy(F.col("cnt").desc(), "lat_cell", "lon_cell")
    return cells if limit is None else cells.limit(limit)


def heatmap_normalised(cells: DataFrame) -> DataFrame:
    """Weight of each cell against the densest, 0.1 at least."""
    top = cells.agg(F.max("cnt").alias("top"))
    return cells.crossJoin(F.broadcast(top)).withColumn("weight", F.greatest(F.lit(0.1), F.col("cnt") / F.col("top"))).drop("top")


def heatmap_sample(positions: DataFrame, minutes: float, limit: int, seed: int = 1, now: float | None = None) -> DataFrame:
    """A seeded random sample of the points in the window."""
    rows = positions.filter(F.col("timestamp") >= clock(positions, now) - minutes * 60)
    return rows.orderBy(F.md5(F.concat_ws(":", "id", F.lit(seed)).cast("binary")), "id").limit(limit)


def density_grid(positions: DataFrame, hours: float | None, size: float, now: float | None = None) -> DataFrame:
    """(lat_b, lon_b, cnt): floor cells of the window, or of all positions where hours is None."""
    rows = positions if hours is None else positions.filter(F.col("timestamp") >= clock(positions, now) - hours * 3600)
    return rows.groupBy(*(F.floor(F.col(c) / size).cast("int").alias(f"{c}_b") for c in ("lat", "lon"))).agg(F.count("*").alias("cnt"))


def rollup(positions: DataFrame, seconds: int, circular: bool = False) -> DataFrame:
    """Means per aircraft and bucket. ``circular`` averages headings as directions instead of numbers."""
    heading = F.avg("heading_deg")
    if circular:
        a = F.radians("heading_deg")
        heading = F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))) + 360, F.lit(360.0))
    bucket = (F.floor(F.col("timestamp") / seconds) * seconds).cast("double").alias("bucket")
    return positions.groupBy("icao", bucket).agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("altitude_ft").cast("int").alias("altitude_ft"), F.avg("speed_kts").alias("speed_kts"),
        heading.alias("heading_deg"), F.avg("vertical_rate_fpm").cast("int").alias("vertical_rate_fpm"), F.count("*").alias("sample_count"),
    )


def refresh_rollup(old: DataFrame, positions: DataFrame, seconds: int, now: float, start_offset: float, end_offset: float) -> DataFrame:
    """The rollup with the buckets of a range of time made again from the positions, late ones included.

    Refreshed are the whole buckets from ``now - start_offset`` to ``now - end_offset``; others stay as they are.
    """
    lo, hi = (math.floor((now - x) / seconds) * seconds for x in (start_offset, end_offset))
    inside = (F.col("bucket") >= lo) & (F.col("bucket") < hi)
    again = positions.filter((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
    return old.filter(~inside).unionByName(rollup(again, seconds))


def stats(tables: dict[str, DataFrame], time_of: str, now: float) -> DataFrame:
    """One row: how many rows each table has, and ``feed_age_seconds`` of the table ``time_of`` (null if empty)."""
    parts = [t.agg(F.count("*").alias("n"), (F.max("timestamp") if k == time_of else F.lit(None).cast("double")).alias("t")).withColumn("k", F.lit(k)) for k, t in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in tables), F.greatest(F.lit(0.0), F.lit(now) - F.max("t")).alias("feed_age_seconds"))


def hourly_counts(positions: DataFrame) -> DataFrame:
    return positions.groupBy(F.window(event_time(), "1 hour")["start"].alias("hour")).agg(F.count("*").alias("cnt"))


def positions_last_day(hourly: DataFrame, now: float) -> DataFrame:
    """Sum of the hourly buckets of the last 24 hours, the open one included."""
    start = F.timestamp_seconds(F.lit(now - 24 * 3600))
    return hourly.filter(F.col("hour") >= F.date_trunc("hour", start)).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("positions_24h"))


def feed_age(positions: DataFrame, now: float) -> DataFrame:
    return positions.agg(F.greatest(F.lit(0.0), F.lit(now) - F.max("timestamp")).alias("age"))


def feed_freshness(ages: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Adds ``stale`` and a label in seconds, minutes, or hours and minutes."""
    s = F.floor("age").cast("long")
    label = (
        F.when(F.col("age") < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(F.col("age") < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m")))
    )
    return ages.withColumns({"stale": F.col("age") > threshold, "label": F.when(F.col("age").isNotNull(), label)})


def _newest(value: str, order: Column) -> Column:
    """The newest value that isn't null."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def upsert_aircraft(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per aircraft: newest known country and registration, military once seen so, first and last times.

    ``old`` is the table so far, ``new`` has arrivals with ``seq``; the result replaces the table.
    """
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    order = F.col("seq")
    return rows.groupBy("icao").agg(
        _newest("registration", order).alias("registration"), _newest("country", order).alias("country"), F.bool_or("is_military").alias("is_military"),
        F.min_by("first_seen", order).alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def upsert_sightings(updates: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """One row per (icao, capture), a null capture being one of its own; updates come with ``seq``.

    Rows of ``old``, the table so far, come before all updates and keep their counts, bounds and first times.
    """
    order = F.col("seq")
    rows = updates.select(
        "icao", "capture_id", "seq", "callsign", "squawk", F.col("altitude_ft").alias("min_altitude_ft"), F.col("altitude_ft").alias("max_altitude_ft"),
        F.lit(1).cast("long").alias("message_count"), F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"),
    )
    if old is not None:
        rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(rows)
    return rows.groupBy("icao", "capture_id").agg(
        _newest("callsign", order).alias("callsign"), _newest("squawk", order).alias("squawk"), F.min("min_altitude_ft").alias("min_altitude_ft"),
        F.max("max_altitude_ft").alias("max_altitude_ft"), F.sum("message_count").alias("message_count"), F.min_by("first_seen", order).alias("first_seen"), F.max_by("last_seen", order).alias("last_seen"),
    )


def upsert_vessels(updates: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Newest name, type and flag that aren't null; last_seen of the newest update; ``old`` comes before all updates."""
    order = F.col("seq")
    rows = updates.withColumns({"first_seen": F.col("timestamp"), "last_seen": F.col("timestamp")}).drop("timestamp")
    if old is not None:
        rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(rows)
    return rows.groupBy("mmsi").agg(
        *(_newest(c, order).alias(c) for c in ("name", "vessel_type", "flag")), F.min_by("first_seen", order).alias("first_seen"), F.max_by("last_seen", order).alias("last_seen")
    )


def register_receivers(requests: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(receivers, rejected): the first request for a name wins, and one that is in the table ``old`` is taken."""
    if old is not None:
        taken = requests.join(old.select("name"), "name", "left_semi")
        fresh, again = register_receivers(requests.join(old.select("name"), "name", "left_anti"))
        return old.unionByName(fresh), again.unionByName(taken)
    first = requests.groupBy("name").agg(F.min("seq").alias("seq"))
    return requests.join(first, ["name", "seq"], "left_semi"), requests.join(first, ["name", "seq"], "left_anti")


def receiver_status(heartbeats: DataFrame, now: float, online_seconds: float = 120.0) -> DataFrame:
    """Latest status of each receiver; fields that a heartbeat leaves out keep their last value."""
    order = F.col("received_at")
    fields: Sequence[str] = ("lat", "lon", "frames_captured", "frames_sent", "active_aircraft", "uptime_sec")
    rows = heartbeats.groupBy("receiver").agg(*(_newest(f, order).alias(f) for f in fields), F.max("received_at").alias("last_heartbeat"))
    return rows.withColumn("online", F.lit(now) - F.col("last_heartbeat") < online_seconds)


def altitude_profile(positions: DataFrame, icao: str) -> DataFrame:
    """(timestamp, altitude, axis) of one aircraft in time order; nothing for fewer than two positions."""
    rows = positions.filter(F.col("icao") == icao).select("timestamp", "id", F.coalesce("altitude_ft", F.lit(0)).alias("altitude"))
    top = rows.agg(F.greatest(F.max("altitude"), F.lit(1000)).alias("axis"), F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(top)).filter("n > 1").drop("n").orderBy("timestamp", "id")


def capture_summary(frames: DataFrame) -> DataFrame:
    """Start, end, frames and aircraft of each capture."""
    return frames.groupBy("capture_id").agg(
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("total_frames"), F.count_distinct("icao").alias("aircraft_count")
    )
