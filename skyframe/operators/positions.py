"""Reading positions: enrichment, filters, latest and newest rows, trails, history.

Every function takes DataFrames and returns one. ``now`` is an argument: the newest time of the rows if it is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEWEST = ("timestamp", "id")


def clock(df: DataFrame, now: float | None, time: str = "timestamp") -> Column:
    """``now`` as a column: a one-row aggregate read as a scalar if it isn't given."""
    return F.lit(now) if now is not None else F.lit(df.agg(F.max(time)).first()[0])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = NEWEST) -> DataFrame:
    """The newest row of each key, by a partial aggregate: no sort, and one row a key and task in the shuffle."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return picked.select("r.*")


def latest_with_ties(df: DataFrame, key: str, time: str = "timestamp") -> DataFrame:
    """All rows at the newest time of their key."""
    top = df.groupBy(key).agg(F.max(time).alias("__top"))
    return df.join(top, key).filter(F.col(time) == F.col("__top")).drop("__top")


def newest(df: DataFrame, limit: int, order: Sequence[str] = NEWEST) -> DataFrame:
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(limit)


def newest_per_key(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = NEWEST) -> DataFrame:
    """The newest n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def enrich_positions(positions: DataFrame, aircraft: DataFrame, sightings: DataFrame) -> DataFrame:
    """Positions with what is known of the aircraft and its latest sighting."""
    last = latest_per_key(sightings, ["icao"], ("last_seen", "capture_id")).select("icao", "callsign", "squawk")
    known = aircraft.select("icao", "is_military")
    return positions.join(known, "icao", "left").join(last, "icao", "left")


def query_positions(
    enriched: DataFrame, min_alt: int | None = None, max_alt: int | None = None, icao: str | None = None, military: bool | None = None,
    min_speed: float | None = None, limit: int = 1000,
) -> DataFrame:
    """Newest positions under any of the filters; the filters reach the scan where they can."""
    tests = [
        (min_alt, F.col("altitude_ft") >= min_alt if min_alt is not None else None),
        (max_alt, F.col("altitude_ft") <= max_alt if max_alt is not None else None),
        (icao, F.col("icao") == icao if icao is not None else None),
        (military, F.coalesce("is_military", F.lit(False)) == military if military is not None else None),
        (min_speed, F.col("speed_kts") > min_speed if min_speed is not None else None),
    ]
    for value, test in tests:
        if value is not None:
            enriched = enriched.filter(test)
    return newest(enriched, limit)


def between(positions: DataFrame, start: float | None = None, end: float | None = None, limit: int = 10_000, ascending: bool = True) -> DataFrame:
    """Rows with start <= timestamp <= end; a missing bound is open."""
    if start is not None:
        positions = positions.filter(F.col("timestamp") >= start)
    if end is not None:
        positions = positions.filter(F.col("timestamp") <= end)
    return positions.orderBy("timestamp", "id").limit(limit) if ascending else newest(positions, limit)


def recent(positions: DataFrame, minutes: float, limit: int, now: float | None = None) -> DataFrame:
    return newest(positions.filter(F.col("timestamp") >= clock(positions, now) - minutes * 60), limit)


def get_events(events: DataFrame, event_type: str | None = None, icao: str | None = None, limit: int = 100) -> DataFrame:
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    if icao is not None:
        events = events.filter(F.col("icao") == icao)
    return newest(events, limit)


def new_events_since(events: DataFrame, last_id: int) -> DataFrame:
    return events.filter(F.col("id") > last_id)


def aircraft_page(aircraft: DataFrame, military: bool | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    if military is not None:
        aircraft = aircraft.filter(F.col("is_military") == military)
    return aircraft.orderBy(F.col("last_seen").desc(), "icao").offset(offset).limit(max(1, min(5000, limit)))


def aircraft_page_total(aircraft: DataFrame, military: bool | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """The page with ``total``, the number of aircraft that it was taken from; a page past the end is empty."""
    rows = aircraft if military is None else aircraft.filter(F.col("is_military") == military)
    return aircraft_page(rows, None, offset, limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def get_aircraft(aircraft: DataFrame, icao: str) -> DataFrame:
    return aircraft.filter(F.col("icao") == icao)


def get_receivers(receivers: DataFrame) -> DataFrame:
    return receivers.orderBy("name")


def aircraft_detail(aircraft: DataFrame, positions: DataFrame, events: DataFrame, icao: str, n_positions: int = 100, n_events: int = 50) -> DataFrame:
    """One row: the aircraft with arrays of its newest positions and events."""

    def nested(df: DataFrame, n: int, name: str) -> DataFrame:
        rows = newest(df.filter(F.col("icao") == icao), n)
        key = F.struct((-F.col("timestamp")).alias("t"), (-F.col("id")).alias("i"), F.struct(*df.columns).alias("r"))
        return rows.groupBy("icao").agg(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["r"]).alias(name))

    one = aircraft.filter(F.col("icao") == icao)
    return one.join(nested(positions, n_positions, "positions"), "icao", "left").join(nested(events, n_events, "events"), "icao", "left")


def search_aircraft(
    aircraft: DataFrame, text: str = "", columns: Sequence[str] = ("icao", "callsign"), military: bool | None = None, live: DataFrame | None = None,
    sort: str = "icao", ascending: bool = True, limit: int = 500,
) -> DataFrame:
    """Case-insensitive substring search; ``live`` keeps aircraft that have a position there; nulls sort as blanks."""
    if text:
        hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower()) for c in columns]
        found = hits[0]
        for h in hits[1:]:
            found = found | h
        aircraft = aircraft.filter(found)
    if military is not None:
        aircraft = aircraft.filter(F.col("is_military") == military)
    if live is not None:
        aircraft = aircraft.join(live.select("icao").distinct(), "icao", "left_semi")
    key = F.coalesce(F.col(sort).cast("string"), F.lit(""))
    return aircraft.orderBy(key.asc() if ascending else key.desc(), "icao").limit(limit)


def trails(positions: DataFrame, minutes: float, per_aircraft: int, now: float | None = None, dedup_receivers: bool = False) -> DataFrame:
    """The newest points of each aircraft in the window; receivers that saw the same moment count once if asked."""
    rows = positions.filter(F.col("timestamp") >= clock(positions, now) - minutes * 60)
    if dedup_receivers:
        rank = F.row_number().over(Window.partitionBy("icao", "timestamp").orderBy("receiver_id", "id"))
        rows = rows.withColumn("__first", rank).filter("__first = 1").drop("__first")
    return newest_per_key(rows, ["icao"], per_aircraft)


def trail_table(minutes: float) -> str:
    """Which table serves a trail of this length: raw positions, the 30 second or the 5 minute rollup."""
    return "positions" if minutes <= 120 else "positions_30s" if minutes <= 360 else "positions_5m"


def tiered_trails(tables: dict[str, DataFrame], minutes: float, per_aircraft: int, now: float) -> DataFrame:
    """(icao, timestamp, lat, lon, altitude_ft): trails from the table that serves their length; raw positions count
    receivers that saw the same moment once, rollups stand at the start of their bucket."""
    name = trail_table(minutes)
    columns = ("icao", "timestamp", "lat", "lon", "altitude_ft")
    if name == "positions":
        return trails(tables[name], minutes, per_aircraft, now, dedup_receivers=True).select(*columns)
    rows = tables[name].withColumnRenamed("bucket", "timestamp").filter(F.col("timestamp") >= now - minutes * 60)
    return newest_per_key(rows, ["icao"], per_aircraft, ("timestamp",)).select(*columns)


def nested_trails(positions: DataFrame, per_aircraft: int) -> DataFrame:
    """(icao, points): newest points of each aircraft in time order."""
    rows = newest_per_key(positions, ["icao"], per_aircraft)
    return rows.groupBy("icao").agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", "lat", "lon", "altitude_ft"))).alias("points"))


def aircraft_history(aircraft: DataFrame, sightings: DataFrame, hours: float, now: float) -> DataFrame:
    """Aircraft seen since the cutoff with the facts of each of their sightings (one row per sighting)."""
    seen = aircraft.filter(F.col("last_seen") >= now - hours * 3600)
    facts = sightings.select("icao", "capture_id", "callsign", "squawk", "min_altitude_ft", "max_altitude_ft", "message_count")
    return seen.join(facts, "icao", "left")


def positions_snapshot(positions: DataFrame, aircraft: DataFrame, sightings: DataFrame, minutes: float, now: float | None = None) -> DataFrame:
    """Latest positioned row of each aircraft active in the window, with identity; the military flag defaults to false."""
    rows = positions.filter(F.col("timestamp") >= clock(positions, now) - minutes * 60)
    out = enrich_positions(latest_per_key(rows, ["icao"]), aircraft, sightings)
    return out.withColumn("is_military", F.coalesce("is_military", F.lit(False)))


def valid_geofences(fences: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): names of 1 to 64 characters without < or >, radius in (0, 500], coordinates in range."""
    fine = (
        F.length("name").between(1, 64) & ~F.col("name").rlike("[<>]") & (F.col("radius_nm") > 0) & (F.col("radius_nm") <= 500)
        & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    )
    marked = fences.withColumn("__ok", F.coalesce(fine, F.lit(False)))
    place = F.when(F.col("__ok"), F.row_number().over(Window.partitionBy("__ok").orderBy("id")))
    marked = marked.withColumn("__ok", F.col("__ok") & (place <= most))
    return marked.filter("__ok").drop("__ok"), marked.filter("NOT __ok").drop("__ok")


def delete_geofence(fences: DataFrame, fence_id: int) -> DataFrame:
    return fences.filter(F.col("id") != fence_id)


def valid_receivers(receivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): names of 1 to 64 characters; coordinates, where given, in range."""
    fine = F.length(F.trim("name")).between(1, 64) & F.coalesce(F.col("lat").between(-90, 90), F.lit(True)) & F.coalesce(F.col("lon").between(-180, 180), F.lit(True))
    marked = receivers.withColumn("__ok", F.coalesce(fine, F.lit(False)))
    return marked.filter("__ok").drop("__ok"), marked.filter("NOT __ok").drop("__ok")


def cross_validate(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], tolerance: float = 0.15) -> DataFrame:
    """Field by field agreement of two decode outputs: (field, n_both, n_match, only_a, only_b)."""
    left, right = a.select(key, F.struct(*fields).alias("a")), b.select(key, F.struct(*fields).alias("b"))
    both = left.join(right, key, "full_outer")
    rows = []
    for f in fields:
        x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
        numeric = a.schema[f].dataType.typeName() in ("double", "float", "integer", "long")
        near = F.coalesce(F.abs(x - y) < tolerance, F.lit(False)) if numeric else F.lit(False)
        rows.append(F.struct(F.lit(f).alias("field"), (x.eqNullSafe(y) | near).alias("same")))
    each = both.select("a", "b", F.explode(F.array(*rows)).alias("r"))
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    return each.groupBy(F.col("r.field").alias("field")).agg(
        F.count_if(there).alias("n_both"), F.count_if(there & F.col("r.same")).alias("n_match"),
        F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
    )
