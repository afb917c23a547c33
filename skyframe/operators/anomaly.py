"""Anomaly scores: physical rules against the previous position, and a learned density of positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine
from .aggregates import density_grid


def score_positions(positions: DataFrame, order: str = "id", key: Sequence[str] = ("icao",)) -> DataFrame:
    """Adds ``rule_score`` and ``flags``; the previous position is the one before in arrival order."""
    before = Window.partitionBy(*key).orderBy(order)
    prev = F.lag(F.struct("lat", "lon", "altitude_ft", "timestamp")).over(before)
    rows = positions.withColumn("__p", prev)
    p = F.col("__p")
    dt = F.col("timestamp") - p["timestamp"]
    there, forward = p.isNotNull(), p.isNotNull() & (dt > 0)
    miles = haversine(p["lat"], p["lon"], F.col("lat"), F.col("lon"))
    rules: list[tuple[str, float, Column]] = [
        ("extreme_speed", 1.0, F.col("speed_kts") > 750),
        ("extreme_vertical_rate", 1.0, F.abs("vertical_rate_fpm") > 12000),
        ("nonmonotonic_time", 0.5, there & (dt <= 0)),
        ("position_teleport", 2.0, forward & (miles / (dt / 3600) > 1500)),
        ("altitude_jump", 1.0, forward & (F.abs((F.col("altitude_ft") - p["altitude_ft"]) / dt * 60) > 20000)),
        ("stuck_position", 0.5, forward & (miles < 0.001) & (dt > 30) & (F.coalesce("speed_kts", F.lit(0.0)) > 100)),
    ]
    fired = F.array(*(F.when(test, F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))) for name, weight, test in rules))
    rows = rows.withColumn("__f", F.filter(fired, lambda x: x.isNotNull())).drop("__p")
    total = F.aggregate("__f", F.lit(0.0), lambda s, x: s + x["weight"])
    return rows.withColumns({"rule_score": total, "flags": F.transform("__f", lambda x: x["name"])}).drop("__f")


def grid_codes(grid: DataFrame) -> DataFrame:
    """Grid cells with their code length -ln((cnt + 1) / (total + cells))."""
    sums = grid.agg(F.sum("cnt").alias("total"), F.count("*").alias("cells"))
    code = -F.ln((F.col("cnt") + 1) / (F.col("total") + F.col("cells")))
    return grid.crossJoin(F.broadcast(sums)).withColumn("code", code)


def grid_offset(grid: DataFrame) -> DataFrame:
    """(offset, total, cells): the code length that half of all observations don't exceed.

    Cells of one code are summed first: codes depend on counts alone, and there are few different counts.
    """
    codes = grid_codes(grid).groupBy("cnt", "total", "cells").agg(F.min("code").alias("code"), F.sum("cnt").alias("weight"))
    running = codes.withColumn("run", F.sum("weight").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)))
    return running.filter(F.col("run") >= F.floor(F.col("total") / 2)).agg(F.min("code").alias("offset"), F.max("total").alias("total"), F.max("cells").alias("cells"))


def density_score(positions: DataFrame, grid: DataFrame, size: float = 0.1) -> DataFrame:
    """Adds ``density_score`` in [0, 5]; 0 if the grid is empty."""
    lat_b, lon_b = (F.floor(F.col(c) / size).cast("int") for c in ("lat", "lon"))
    rows = positions.withColumns({"lat_b": lat_b, "lon_b": lon_b}).join(grid.select("lat_b", "lon_b", "cnt"), ["lat_b", "lon_b"], "left")
    rows = rows.crossJoin(F.broadcast(grid_offset(grid)))
    code = -F.ln((F.coalesce("cnt", F.lit(0)) + 1) / (F.col("total") + F.col("cells")))
    score = F.when(F.coalesce("total", F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(5.0), code - F.col("offset"))))
    return rows.withColumn("density_score", score).drop("lat_b", "lon_b", "cnt", "offset", "total", "cells")


def combined_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("anomaly_score", F.col("rule_score") + F.col("density_score"))


def tier(score: Column) -> Column:
    return F.when(score < 0.5, "none").when(score < 2, "low").when(score < 4, "med").otherwise("high")


def refresh_baseline(positions: DataFrame, now: float, hours: float = 168, size: float = 0.1) -> DataFrame:
    """The density baseline made anew from a window of positions: its cells with counts, and the median code length.

    A job writes this small table each hour; scores read it instead of the positions.
    """
    grid = density_grid(positions, hours, size, now)
    return grid.crossJoin(F.broadcast(grid_offset(grid).select("offset")))  # one row


def baseline_health(grid: DataFrame, refreshed_at: float) -> DataFrame:
    return grid.agg(F.count("*").alias("cells"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total")).withColumn("refreshed_at", F.lit(refreshed_at))
