"""Derived series: interpolation, dead reckoning, trail segments, headings of silent aircraft."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import RADIUS_KM, bearing, haversine
from .positions import newest_per_key

HOLD = 300.0


def interpolate_at(positions: DataFrame, step: float, start: float, end: float) -> DataFrame:
    """(icao, t, lat, lon, altitude_ft, heading_deg) at every step of a time grid where a position is known.

    Each point covers the time to the next one, or five minutes if that is later or missing; the grid times inside are
    made from the point itself, so there is no join.
    """
    w = Window.partitionBy("icao").orderBy("timestamp", "id")
    rows = positions.withColumn("__n", F.lead(F.struct("timestamp", "lat", "lon", "altitude_ft", "heading_deg")).over(w))
    n, t0 = F.col("__n"), F.col("timestamp")
    gap = F.coalesce(n["timestamp"] - t0, F.lit(float("inf")))
    far = gap > HOLD
    until = F.least(F.lit(end), F.when(far, F.least(t0 + HOLD, F.coalesce(n["timestamp"], t0 + HOLD))).otherwise(n["timestamp"]))
    first = F.ceil((F.greatest(t0, F.lit(start)) - start) / step)
    last = F.ceil((until - start) / step) - 1
    grid = F.when(last >= first, F.sequence(first, last))
    each = rows.withColumn("__far", far).withColumn("__k", F.explode(grid)).withColumn("t", F.lit(start) + F.col("__k") * step)
    f = F.when(F.col("__far"), 0.0).otherwise((F.col("t") - t0) / (n["timestamp"] - t0))
    linear = lambda c: F.col(c) + f * (F.coalesce(n[c], F.col(c)) - F.col(c))
    turn = F.pmod(F.coalesce(n["heading_deg"], F.col("heading_deg")) - F.col("heading_deg") + 540, F.lit(360.0)) - 180
    return each.select(
        "icao", "t", linear("lat").alias("lat"), linear("lon").alias("lon"), F.round(linear("altitude_ft")).cast("int").alias("altitude_ft"),
        F.pmod(F.col("heading_deg") + f * turn + 360, F.lit(360.0)).alias("heading_deg"),
    )


def dead_reckon(states: DataFrame, minutes: float, steps: int = 4) -> DataFrame:
    """(icao, step, lat, lon): where an aircraft gets on its course; none for slow or unknown speeds."""
    rows = states.filter((F.col("speed_kts") >= 30) & F.col("heading_deg").isNotNull())
    each = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    nm = F.col("speed_kts") * (minutes / 60) * F.col("step") / steps
    a = F.radians("heading_deg")
    return each.select("icao", "id", "step", (F.col("lat") + nm / 60 * F.cos(a)).alias("lat"), (F.col("lon") + nm / 60 * F.sin(a) / F.cos(F.radians("lat"))).alias("lon"))


def trail_segments(points: DataFrame, gap_km: float = 50.0, band_ft: int = 5000) -> DataFrame:
    """(icao, segment, point columns): trails cut at long gaps, and by height band with the border point in both parts."""
    w = Window.partitionBy("icao").orderBy("timestamp", "id")
    band = F.floor(F.coalesce("altitude_ft", F.lit(0)) / band_ft)
    rows = points.withColumn("band", band).withColumn("__p", F.lag(F.struct("lat", "lon", "band")).over(w))
    p = F.col("__p")
    far = p.isNull() | (haversine(p["lat"], p["lon"], F.col("lat"), F.col("lon"), RADIUS_KM) > gap_km)
    change = ~far & (p["band"] != F.col("band"))
    rows = rows.withColumns({"__new": F.when(far | change, 1).otherwise(0), "__change": change})
    rows = rows.withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the first point of a new height band also ends the segment before
    parts = F.when(F.col("__change"), F.array(F.col("segment") - 1, F.col("segment"))).otherwise(F.array("segment"))
    rows = rows.withColumn("segment", F.explode(parts)).drop("__p", "__new", "__change", "band")
    size = F.count("*").over(Window.partitionBy("icao", "segment"))
    return rows.withColumn("__n", size).filter("__n > 1").drop("__n")


def derived_heading(positions: DataFrame, active: DataFrame) -> DataFrame:
    """(icao, heading_deg) from the last two points of aircraft without a live state."""
    rows = newest_per_key(positions, ["icao"], 2).join(active.select("icao"), "icao", "left_anti")
    order = F.sort_array(F.collect_list(F.struct("timestamp", "id", "lat", "lon")))
    two = rows.groupBy("icao").agg(order.alias("p")).filter(F.size("p") == 2)
    a, b = F.col("p")[0], F.col("p")[1]
    return two.select("icao", bearing(a["lat"], a["lon"], b["lat"], b["lon"]).alias("heading_deg"))


def trail_up_to(points: DataFrame, t: float) -> DataFrame:
    return points.filter(F.col("timestamp") <= t)
