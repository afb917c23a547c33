"""Queries over positions, aircraft, sightings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import positions as P
from . import fixtures as X
from .base import query

FX, COLS = X.FX, X.COLUMNS
LATEST_SIGHTING = "latest_sighting AS (SELECT icao, callsign, squawk FROM (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY last_seen DESC, capture_id DESC) AS rn FROM sightings) WHERE rn = 1)"
ENRICHED = f"{LATEST_SIGHTING}, enriched AS (SELECT p.*, a.is_military, s.callsign, s.squawk FROM positions p LEFT JOIN aircraft a USING (icao) LEFT JOIN latest_sighting s USING (icao))"


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return P.enrich_positions(X.positions(spark, d), X.aircraft(spark, d), X.sightings(spark, d))


@query(f"{FX}, {ENRICHED} SELECT * FROM enriched")
def p1_enrich_positions(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d)


@query(f"{FX}, {ENRICHED} SELECT * FROM enriched WHERE altitude_ft >= 1000 AND altitude_ft <= 8000 AND is_military ORDER BY timestamp DESC, id DESC LIMIT 500")
def p2_query_positions(spark: SparkSession, d: str) -> DataFrame:
    return P.query_positions(enriched(spark, d), min_alt=1000, max_alt=8000, military=True, limit=500)


@query(f"{FX}, {ENRICHED} SELECT * FROM enriched WHERE NOT is_military ORDER BY timestamp DESC, id DESC LIMIT 300")
def p2_query_positions_civilian(spark: SparkSession, d: str) -> DataFrame:
    return P.query_positions(enriched(spark, d), military=False, limit=300)


@query(f"{FX} SELECT * FROM positions WHERE timestamp >= 1704067250.0 AND timestamp <= 1704067900.0 ORDER BY timestamp, id LIMIT 2000")
def p3_positions_between(spark: SparkSession, d: str) -> DataFrame:
    return P.between(X.positions(spark, d), 1704067250.0, 1704067900.0, 2000)


@query(f"{FX}, {ENRICHED} SELECT * FROM enriched WHERE timestamp >= (SELECT now FROM clock) - 600 ORDER BY timestamp, id LIMIT 5000")
def p4_export_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = enriched(spark, d)
    now = X.positions(spark, d).agg(F.max("timestamp")).first()[0]
    return P.between(rows, start=now - 600, limit=5000)


@query(f"{FX} SELECT * FROM positions WHERE icao = (SELECT min(icao) FROM positions) ORDER BY timestamp DESC, id DESC LIMIT 100")
def p5_get_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    one = rows.agg(F.min("icao").alias("icao"))
    return P.newest(rows.join(F.broadcast(one), "icao", "left_semi").select(rows.columns), 100)


@query(f"{FX} SELECT * FROM positions WHERE timestamp >= (SELECT now FROM clock) - 300 ORDER BY timestamp DESC, id DESC LIMIT 50000")
def p6_recent_positions(spark: SparkSession, d: str) -> DataFrame:
    return P.recent(X.positions(spark, d), 5, 50_000)


@query(f"{FX} SELECT * FROM flight_events WHERE event_type = 'low_altitude' ORDER BY timestamp DESC, id DESC LIMIT 100")
def p7_get_events(spark: SparkSession, d: str) -> DataFrame:
    return P.get_events(X.flight_events(spark, d), "low_altitude")


@query(f"{FX} SELECT * FROM aircraft WHERE is_military = false ORDER BY last_seen DESC, icao LIMIT 40 OFFSET 20")
def p8_all_aircraft(spark: SparkSession, d: str) -> DataFrame:
    return P.aircraft_page(X.aircraft(spark, d), False, 20, 40)


@query(f"{FX} SELECT *, (SELECT count(*) FROM aircraft WHERE is_military = false) AS total FROM aircraft WHERE is_military = false ORDER BY last_seen DESC, icao LIMIT 40 OFFSET 20")
def p8_page_total(spark: SparkSession, d: str) -> DataFrame:
    return P.aircraft_page_total(X.aircraft(spark, d), False, 20, 40)


@query(f"{FX} SELECT * FROM aircraft WHERE icao = (SELECT max(icao) FROM positions)")
def p12_get_aircraft(spark: SparkSession, d: str) -> DataFrame:
    return P.get_aircraft(X.aircraft(spark, d), X.positions(spark, d).agg(F.max("icao")).first()[0])


RECEIVERS = "SELECT concat(CASE WHEN user_id % 9 = 0 THEN ' ' ELSE 'rx' END, CASE WHEN user_id % 9 = 0 THEN '' ELSE CAST(user_id AS STRING) END) AS name, user_id AS id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 120 - 20 AS DOUBLE) END AS lat, CAST(user_id % 400 - 200 AS DOUBLE) AS lon FROM (SELECT DISTINCT user_id FROM {t}) AS u"


@query(f"WITH r AS ({RECEIVERS.format(t='events')}) SELECT * FROM r WHERE length(trim(name)) BETWEEN 1 AND 64 AND coalesce(lat BETWEEN -90 AND 90, true) AND coalesce(lon BETWEEN -180 AND 180, true)")
def p13_valid_receivers(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(RECEIVERS, t=spark.read.parquet(f"{d}/events.parquet"))
    return P.get_receivers(P.valid_receivers(rows)[0])


@query(
    f"{FX}, one AS (SELECT min(icao) AS icao FROM positions), p AS (SELECT * FROM positions WHERE icao = (SELECT icao FROM one) ORDER BY timestamp DESC, id DESC LIMIT 100), "
    "e AS (SELECT * FROM flight_events WHERE icao = (SELECT icao FROM one) ORDER BY timestamp DESC, id DESC LIMIT 50) "
    "SELECT a.icao, a.is_military, a.first_seen, a.last_seen, (SELECT count(*) FROM p) AS n_positions, (SELECT max(id) FROM p) AS newest_position, (SELECT count(*) FROM e) AS n_events FROM aircraft a WHERE a.icao = (SELECT icao FROM one)"
)
def p9_aircraft_detail(spark: SparkSession, d: str) -> DataFrame:
    icao = X.positions(spark, d).agg(F.min("icao")).first()[0]
    rows = P.aircraft_detail(X.aircraft(spark, d), X.positions(spark, d), X.flight_events(spark, d), icao)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return rows.select("icao", "is_military", "first_seen", "last_seen", size("positions").alias("n_positions"), F.get("positions", F.lit(0))["id"].alias("newest_position"), size("events").alias("n_events"))


@query(f"{FX}, {LATEST_SIGHTING} SELECT a.*, s.callsign FROM aircraft a LEFT JOIN latest_sighting s USING (icao) WHERE (contains(lower(icao), 'ups') OR contains(lower(coalesce(s.callsign, '')), 'ups')) AND icao IN (SELECT icao FROM positions) ORDER BY coalesce(s.callsign, ''), icao LIMIT 500")
def p10_search_aircraft(spark: SparkSession, d: str) -> DataFrame:
    names = P.latest_per_key(X.sightings(spark, d), ["icao"], ("last_seen", "capture_id")).select("icao", "callsign")
    return P.search_aircraft(X.aircraft(spark, d).join(names, "icao", "left"), "UPS", live=X.positions(spark, d), sort="callsign")


@query(f"{FX}, {ENRICHED} SELECT * FROM enriched WHERE speed_kts > 500 ORDER BY timestamp DESC, id DESC LIMIT 1000")
def p11_preset_fast(spark: SparkSession, d: str) -> DataFrame:
    return P.query_positions(enriched(spark, d), min_speed=500.0)


@query(f"{FX} SELECT (SELECT count(*) FROM positions) AS positions, (SELECT count(*) FROM aircraft) AS aircraft, (SELECT count(*) FROM sightings) AS sightings, (SELECT count(*) FROM flight_events) AS events")
def p12_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = {"positions": X.positions, "aircraft": X.aircraft, "sightings": X.sightings, "events": X.flight_events}
    parts = [f(spark, d).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, f in tables.items()]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in tables))


@query(f"{FX}, {LATEST_SIGHTING}, r AS (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, id DESC) AS rn FROM positions WHERE timestamp >= (SELECT now FROM clock) - 300) "
       f"SELECT {', '.join('r.' + c.strip() for c in COLS.split(','))}, coalesce(a.is_military, false) AS is_military, s.callsign, s.squawk FROM r LEFT JOIN aircraft a USING (icao) LEFT JOIN latest_sighting s USING (icao) WHERE rn = 1")  # fmt: skip
def p14_positions_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return P.positions_snapshot(X.positions(spark, d), X.aircraft(spark, d), X.sightings(spark, d), 5)


@query(f"{FX}, c AS (SELECT user_id AS id, concat(CASE WHEN user_id % 9 = 0 THEN '<' ELSE 'zone ' END, user_id) AS name, CAST(user_id % 120 - 20 AS DOUBLE) AS lat, CAST(user_id % 400 - 200 AS DOUBLE) AS lon, CAST(user_id % 600 AS DOUBLE) AS radius_nm FROM (SELECT DISTINCT user_id FROM events)), "
       "ok AS (SELECT * FROM c WHERE length(name) BETWEEN 1 AND 64 AND NOT regexp_matches(name, '[<>]') AND radius_nm > 0 AND radius_nm <= 500 AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) SELECT * FROM ok ORDER BY id LIMIT 100")  # fmt: skip
def p13_valid_geofences(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    made = users.select(
        F.col("user_id").alias("id"), F.concat(F.when(F.col("user_id") % 9 == 0, "<").otherwise("zone "), F.col("user_id").cast("string")).alias("name"),
        (F.col("user_id") % 120 - 20).cast("double").alias("lat"), (F.col("user_id") % 400 - 200).cast("double").alias("lon"), (F.col("user_id") % 600).cast("double").alias("radius_nm"),
    )
    return P.valid_geofences(made)[0]


@query(f"{FX} SELECT p.*, a.is_military FROM positions p JOIN aircraft a USING (icao)")
def j1_inner_equi(spark: SparkSession, d: str) -> DataFrame:
    return X.positions(spark, d).join(X.aircraft(spark, d).select("icao", "is_military"), "icao")


@query(f"{FX} SELECT s.* FROM sightings s JOIN (SELECT icao, max(capture_id) AS m FROM sightings GROUP BY icao) t ON s.icao = t.icao AND s.capture_id = t.m")
def j3_latest_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_with_ties(X.sightings(spark, d), "icao", "capture_id")


@query(f"{FX} SELECT a.icao, a.is_military, a.first_seen, a.last_seen, s.capture_id, s.callsign, s.squawk, s.min_altitude_ft, s.max_altitude_ft, s.message_count FROM aircraft a LEFT JOIN sightings s USING (icao) WHERE a.last_seen >= (SELECT now FROM clock) - 24 * 3600")
def a15_aircraft_history(spark: SparkSession, d: str) -> DataFrame:
    now = X.positions(spark, d).agg(F.max("timestamp")).first()[0]
    return P.aircraft_history(X.aircraft(spark, d), X.sightings(spark, d), 24, now)


@query(f"{FX} SELECT * FROM positions WHERE id IN (SELECT max(id) FROM positions GROUP BY icao)")
def j5_semi_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    return rows.join(rows.groupBy("icao").agg(F.max("id").alias("id")).select("id"), "id", "left_semi").select(rows.columns)


@query(f"{FX} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, id DESC) AS rn FROM positions) WHERE rn = 1".replace("SELECT * FROM (SELECT *,", f"SELECT {COLS} FROM (SELECT *,"))
def w1_latest_per_aircraft(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_per_key(X.positions(spark, d), ["icao"])


@query(f"{FX} SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, id DESC) AS rn FROM positions WHERE timestamp >= (SELECT now FROM clock) - 1800) WHERE rn <= 20")
def w2_trails(spark: SparkSession, d: str) -> DataFrame:
    return P.trails(X.positions(spark, d), 30, 20)


@query(f"{FX}, two AS (SELECT * FROM positions UNION ALL SELECT id + 1000000000, icao, receiver_id + 1, lat, lon, altitude_ft, speed_kts, heading_deg, vertical_rate_fpm, timestamp FROM positions), one AS (SELECT *, row_number() OVER (PARTITION BY icao, timestamp ORDER BY receiver_id, id) AS f FROM two WHERE timestamp >= (SELECT now FROM clock) - 1800) "
       f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, id DESC) AS rn FROM one WHERE f = 1) WHERE rn <= 15")  # fmt: skip
def w3_trails_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    again = rows.withColumns({"id": F.col("id") + 1_000_000_000, "receiver_id": F.col("receiver_id") + 1})
    return P.trails(rows.unionByName(again), 30, 15, dedup_receivers=True)


@query(f"{FX} SELECT icao, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, id DESC) AS rn FROM positions) WHERE rn <= 50 GROUP BY icao")
def w2_nested_trails(spark: SparkSession, d: str) -> DataFrame:
    rows = P.nested_trails(X.positions(spark, d), 50)
    return rows.select("icao", F.size("points").cast("long").alias("n"), F.col("points")[0]["id"].alias("first_id"), F.element_at("points", -1)["id"].alias("last_id"))


@query(f"{FX} SELECT * FROM flight_events WHERE id > 5000")
def x14_new_events_since(spark: SparkSession, d: str) -> DataFrame:
    return P.new_events_since(X.flight_events(spark, d), 5000)


@query(f"{FX}, a AS (SELECT id, altitude_ft, speed_kts, heading_deg FROM positions WHERE id % 10 <> 0), b AS (SELECT id, CASE WHEN id % 50 = 1 THEN altitude_ft + 25 ELSE altitude_ft END AS altitude_ft, speed_kts + 0.1 AS speed_kts, heading_deg FROM positions WHERE id % 10 <> 5), "
       "f AS (SELECT a.id AS ai, b.id AS bi, unnest(['altitude_ft', 'speed_kts', 'heading_deg']) AS field, unnest([(a.altitude_ft IS NOT DISTINCT FROM b.altitude_ft) OR coalesce(abs(a.altitude_ft - b.altitude_ft) < 0.15, false), (a.speed_kts IS NOT DISTINCT FROM b.speed_kts) OR coalesce(abs(a.speed_kts - b.speed_kts) < 0.15, false), (a.heading_deg IS NOT DISTINCT FROM b.heading_deg)]) AS same FROM a FULL JOIN b ON a.id = b.id) "
       "SELECT field, count(*) FILTER (ai IS NOT NULL AND bi IS NOT NULL) AS n_both, count(*) FILTER (ai IS NOT NULL AND bi IS NOT NULL AND same) AS n_match, count(*) FILTER (bi IS NULL) AS only_a, count(*) FILTER (ai IS NULL) AS only_b FROM f GROUP BY field")  # fmt: skip
def j13_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d).select("id", "altitude_ft", "speed_kts", "heading_deg")
    b = rows.filter("id % 10 <> 5").withColumns({"altitude_ft": F.when(F.col("id") % 50 == 1, F.col("altitude_ft") + 25).otherwise(F.col("altitude_ft")), "speed_kts": F.col("speed_kts") + 0.1})
    return P.cross_validate(rows.filter("id % 10 <> 0"), b, "id", ["altitude_ft", "speed_kts", "heading_deg"])


def _tier(seconds: int, minutes: int) -> str:
    return (
        f"SELECT {minutes} AS minutes, icao, timestamp, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT icao, floor(timestamp / {seconds}) * {seconds}.0::DOUBLE AS timestamp, avg(lat) AS lat, avg(lon) AS lon FROM positions GROUP BY 1, 2) "
        f"WHERE timestamp >= (SELECT now FROM clock) - {minutes * 60} QUALIFY row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC) <= 10"
    )


@query(f"{FX} SELECT 120 AS minutes, icao, timestamp, round(lat, 6) AS lat, round(lon, 6) AS lon FROM positions WHERE timestamp >= (SELECT now FROM clock) - 7200 QUALIFY row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, id DESC) <= 10 UNION ALL ({_tier(30, 360)}) UNION ALL ({_tier(300, 600)})")
def w4_tiered_trails(spark: SparkSession, d: str) -> DataFrame:
    """One trail from each of the three tables."""
    rows = X.positions(spark, d)
    tables, now = {"positions": rows, "positions_30s": A.rollup(rows, 30), "positions_5m": A.rollup(rows, 300)}, rows.agg(F.max("timestamp")).first()[0]
    parts = [P.tiered_trails(tables, m, 10, now).select(F.lit(m).alias("minutes"), "icao", "timestamp", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")) for m in (120, 360, 600)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
