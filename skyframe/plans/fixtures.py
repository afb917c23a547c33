"""Flights, made of the table ``events``: the same projections for Spark and, as SQL, for comparison.

The tables that these queries run on hold no flights, so each event becomes a position. All of the given table is
used. Time is synthetic: a quarter of a second an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.refdata import values_sql

_ICAO = "CASE WHEN user_id % 11 = 0 THEN 11401160 + user_id ELSE 10485761 + (user_id * 6007) % 900000 END"
_POSITIONS = """
 CAST(user_id % 3 AS BIGINT) AS receiver_id,
 35.0{d} + ((user_id * 97 + event_id * 7) % 2000) / 1000.0{d} AS lat,
 -83.0{d} + ((user_id * 61 + event_id * 3) % 3000) / 1000.0{d} AS lon,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value * 90) AS INT) END AS altitude_ft,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 37) % 800 AS DOUBLE) END AS speed_kts,
 CAST((event_id * 29) % 360 AS DOUBLE) AS heading_deg,
 CAST(((event_id * 17) % 240 - 120) * 64 AS INT) AS vertical_rate_fpm,
 1704067200.0{d} + event_id * 0.25{d} AS timestamp,
 CASE (event_id % 5) WHEN 0 THEN NULL ELSE concat(CASE user_id % 4 WHEN 0 THEN 'AAL' WHEN 1 THEN 'UPS' WHEN 2 THEN 'RCH' ELSE 'N' END, CAST(user_id AS STRING)) END AS callsign,
 CASE event_id % 97 WHEN 0 THEN '7700' WHEN 1 THEN '7600' WHEN 2 THEN '7500' ELSE '1200' END AS squawk"""
_STATES = "SELECT event_id AS id, {icao} AS icao," + _POSITIONS + " FROM {events}"
STATES_SPARK = _STATES.replace("{icao}", f"lpad(hex({_ICAO}), 6, '0')").replace("{d}", "D")
STATES_SQL = _STATES.replace("{icao}", f"printf('%06X', CAST(({_ICAO}) AS BIGINT))").replace("{d}", "::DOUBLE")
_AIRCRAFT = "SELECT icao, max(icao) >= 'ADF7C8' AS is_military, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM {states} GROUP BY icao"
_SIGHTINGS = """SELECT icao, CAST(floor(id / 1000) AS BIGINT) AS capture_id, max(callsign) AS callsign, max(squawk) AS squawk, min(altitude_ft) AS min_altitude_ft,
 max(altitude_ft) AS max_altitude_ft, count(*) AS message_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM {states} GROUP BY icao, CAST(floor(id / 1000) AS BIGINT)"""
_EVENTS = """SELECT id, icao, CASE id % 3 WHEN 0 THEN 'military_detected' WHEN 1 THEN 'low_altitude' ELSE 'rapid_descent' END AS event_type,
 concat('event of ', icao) AS description, lat, lon, altitude_ft, timestamp FROM {states} WHERE id % 7 = 0"""
COLUMNS = "id, icao, receiver_id, lat, lon, altitude_ft, speed_kts, heading_deg, vertical_rate_fpm, timestamp"

FX = f"""WITH states AS ({STATES_SQL.replace("{events}", "events")}), positions AS (SELECT {COLUMNS} FROM states),
aircraft AS ({_AIRCRAFT.format(states="states")}), sightings AS ({_SIGHTINGS.format(states="states")}), flight_events AS ({_EVENTS.format(states="states")}),
clock AS (SELECT max(timestamp) AS now FROM states)"""

#: Airports (code, name, latitude, longitude, elevation, kind).
AIRPORTS = [
    ("KATL", "Atlanta Hartsfield-Jackson", 33.6367, -84.4281, 1026, "major"),
    ("KCLT", "Charlotte Douglas", 35.2140, -80.9431, 748, "major"),
    ("KAVL", "Asheville Regional", 35.4362, -82.5418, 2165, "major"),
    ("KTYS", "Knoxville McGhee Tyson", 35.8110, -83.9940, 981, "major"),
]
FENCES = [("north", 36.5, -82.0, 20.0), ("south", 35.2, -81.0, 12.5), ("west", 35.6, -82.7, 5.0)]
AIRPORTS_CTE = values_sql("airports", "code, name, lat, lon, elevation_ft, kind", AIRPORTS)
FENCES_CTE = values_sql("fences", "name, lat, lon, radius_nm", FENCES)


def _run(df: DataFrame, sql: str) -> DataFrame:
    return df.sparkSession.sql(sql.replace("{states}", "{t}").replace("{events}", "{t}"), t=df)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value"), STATES_SPARK)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).drop("callsign", "squawk")


def aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(states(spark, sf_dir), _AIRCRAFT)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(states(spark, sf_dir), _SIGHTINGS)


def flight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(states(spark, sf_dir), _EVENTS)


def airports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AIRPORTS, "code string, name string, lat double, lon double, elevation_ft int, kind string")


def fences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FENCES, "name string, lat double, lon double, radius_nm double")
