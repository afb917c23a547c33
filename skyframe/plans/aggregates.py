"""Queries: heatmaps, rollups, statistics, upserts, anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..operators import aggregates as A
from ..operators import anomaly as G
from ..operators import positions as P
from ..operators import rollups as U
from . import fixtures as X
from .base import query
from .positions import LATEST_SIGHTING

FX = X.FX
COLS = X.COLUMNS
CELLS = "cells AS (SELECT CAST(round(lat / 0.05) AS BIGINT) AS lat_cell, CAST(round(lon / 0.05) AS BIGINT) AS lon_cell, count(*) AS cnt, CAST(trunc(avg(altitude_ft)) AS INT) AS avg_altitude, CAST(round(lat / 0.05) AS BIGINT) * 0.05::DOUBLE AS lat, CAST(round(lon / 0.05) AS BIGINT) * 0.05::DOUBLE AS lon FROM positions WHERE timestamp >= (SELECT now FROM clock) - 3600 GROUP BY ALL)"


def _now(spark: SparkSession, d: str) -> float:
    return X.positions(spark, d).agg(F.max("timestamp")).first()[0]


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"{FX}, {CELLS} SELECT * FROM cells ORDER BY cnt DESC, lat_cell, lon_cell LIMIT 5000")
def a1_heatmap_density(spark: SparkSession, d: str) -> DataFrame:
    return A.heatmap_density(X.positions(spark, d), 60, 0.05)


@query(f"{FX}, {CELLS} SELECT *, greatest(0.1, cnt / (SELECT max(cnt) FROM cells)) AS weight FROM cells")
def a2_heatmap_normalised(spark: SparkSession, d: str) -> DataFrame:
    return A.heatmap_normalised(A.heatmap_density(X.positions(spark, d), 60, 0.05, limit=None))


@query(f"{FX} SELECT lat, lon FROM positions WHERE timestamp >= (SELECT now FROM clock) - 1800 ORDER BY timestamp DESC, id DESC LIMIT 50000")
def a3_heatmap_recent(spark: SparkSession, d: str) -> DataFrame:
    return P.recent(X.positions(spark, d), 30, 50_000).select("lat", "lon")


@query(f"{FX} SELECT {COLS} FROM positions WHERE timestamp >= (SELECT now FROM clock) - 3600 ORDER BY md5(concat(id, ':1')), id LIMIT 1000")
def a4_heatmap_sample(spark: SparkSession, d: str) -> DataFrame:
    return A.heatmap_sample(X.positions(spark, d), 60, 1000)


@query(f"{FX} SELECT CAST(floor(lat / 0.1) AS INT) AS lat_b, CAST(floor(lon / 0.1) AS INT) AS lon_b, count(*) AS cnt FROM positions WHERE timestamp >= (SELECT now FROM clock) - 168 * 3600 GROUP BY 1, 2")
def a5_density_grid(spark: SparkSession, d: str) -> DataFrame:
    return A.density_grid(X.positions(spark, d), 168, 0.1)


def _rollup_sql(seconds: int) -> str:
    return (
        f"{FX} SELECT icao, floor(timestamp / {seconds}) * {seconds}.0::DOUBLE AS bucket, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, CAST(trunc(avg(altitude_ft)) AS INT) AS altitude_ft, round(avg(speed_kts), 6) AS speed_kts, "
        f"round(avg(heading_deg), 6) AS heading_deg, CAST(trunc(avg(vertical_rate_fpm)) AS INT) AS vertical_rate_fpm, count(*) AS sample_count FROM positions GROUP BY 1, 2"
    )


@query(_rollup_sql(30))
def a6_rollup_30s(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(A.rollup(X.positions(spark, d), 30))


@query(_rollup_sql(300))
def a6_rollup_5m(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(A.rollup(X.positions(spark, d), 300))


@query(
    f"{FX} SELECT icao, floor(timestamp / 300) * 300.0::DOUBLE AS bucket, round(abs(sum(sin(radians(heading_deg)))) + abs(sum(cos(radians(heading_deg)))), 4) AS pull, count(*) AS n FROM positions GROUP BY 1, 2"
)
def a6_rollup_circular(spark: SparkSession, d: str) -> DataFrame:
    rows = A.rollup(X.positions(spark, d), 300, circular=True)
    own = X.positions(spark, d).withColumn("bucket", (F.floor(F.col("timestamp") / 300) * 300).cast("double"))
    a = F.radians("heading_deg")
    pull = own.groupBy("icao", "bucket").agg(F.round(F.abs(F.sum(F.sin(a))) + F.abs(F.sum(F.cos(a))), 4).alias("pull"))
    return rows.join(pull, ["icao", "bucket"]).select("icao", "bucket", "pull", F.col("sample_count").alias("n"))


@query(f"{FX} SELECT date_trunc('hour', make_timestamp(CAST(timestamp * 1000000 AS BIGINT))) AS hour, count(*) AS cnt FROM positions GROUP BY 1")
def a7_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.hourly_counts(X.positions(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f"{FX} SELECT CAST(count(*) AS BIGINT) AS positions_24h FROM positions WHERE timestamp >= floor(((SELECT now FROM clock) - 24 * 3600) / 3600) * 3600")
def a7_positions_last_day(spark: SparkSession, d: str) -> DataFrame:
    return A.positions_last_day(A.hourly_counts(X.positions(spark, d)), _now(spark, d))


@query(f"{FX}, a AS (SELECT icao, greatest(0.0, (SELECT now FROM clock) + 5 - max(timestamp)) AS age FROM positions GROUP BY icao) SELECT icao, age, age > 60 AS stale, CASE WHEN age < 60 THEN concat(CAST(floor(age) AS BIGINT), 's') WHEN age < 3600 THEN concat(CAST(floor(age) AS BIGINT) // 60, 'm') ELSE concat(CAST(floor(age) AS BIGINT) // 3600, 'h ', (CAST(floor(age) AS BIGINT) % 3600) // 60, 'm') END AS label FROM a")
def a9_feed_freshness(spark: SparkSession, d: str) -> DataFrame:
    now = _now(spark, d) + 5
    ages = X.positions(spark, d).groupBy("icao").agg(F.greatest(F.lit(0.0), F.lit(now) - F.max("timestamp")).alias("age"))
    return A.feed_freshness(ages)


@query(f"{FX} SELECT (SELECT count(*) FROM positions) AS positions, (SELECT count(*) FROM aircraft) AS aircraft, (SELECT count(*) FROM sightings) AS sightings, (SELECT count(*) FROM flight_events) AS events, (SELECT count(DISTINCT receiver_id) FROM positions) AS receivers, greatest(0.0, (SELECT now FROM clock) + 7.5 - (SELECT max(timestamp) FROM positions)) AS feed_age_seconds")
def a8_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    tables = {"positions": rows, "aircraft": X.aircraft(spark, d), "sightings": X.sightings(spark, d), "events": X.flight_events(spark, d), "receivers": rows.select("receiver_id").distinct()}
    return A.stats(tables, "positions", _now(spark, d) + 7.5)


@query(f"{FX}, u AS (SELECT icao, id, CASE WHEN id % 3 = 0 THEN NULL ELSE concat('N', id % 100) END AS registration, CASE WHEN id % 4 = 0 THEN NULL ELSE concat('C', id % 7) END AS country, icao >= 'ADF7C8' AND id % 2 = 0 AS is_military, timestamp FROM positions) "
       "SELECT icao, max_by(registration, id) FILTER (registration IS NOT NULL) AS registration, max_by(country, id) FILTER (country IS NOT NULL) AS country, bool_or(is_military) AS is_military, min_by(timestamp, id) AS first_seen, max(timestamp) AS last_seen FROM u GROUP BY icao")  # fmt: skip
def a10_upsert_aircraft(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d).select(
        "icao", F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE concat('N', id % 100) END").alias("registration"), F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE concat('C', id % 7) END").alias("country"),
        F.expr("icao >= 'ADF7C8' AND id % 2 = 0").alias("is_military"), F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"), F.col("id").alias("seq"),
    )
    half = rows.agg(F.max("seq")).first()[0] // 2
    empty = rows.drop("seq").limit(0)
    table = A.upsert_aircraft(empty, rows.filter(F.col("seq") < half))
    return A.upsert_aircraft(table, rows.filter(F.col("seq") >= half))


@query(f"{FX}, u AS (SELECT *, CASE WHEN id % 10 = 0 THEN NULL ELSE id // 1000 END AS capture_id FROM states) SELECT icao, capture_id, max_by(callsign, id) FILTER (callsign IS NOT NULL) AS callsign, max_by(squawk, id) AS squawk, min(altitude_ft) AS min_altitude_ft, max(altitude_ft) AS max_altitude_ft, count(*) AS message_count, min_by(timestamp, id) AS first_seen, max_by(timestamp, id) AS last_seen FROM u GROUP BY icao, capture_id")
def a11_upsert_sightings(spark: SparkSession, d: str) -> DataFrame:
    rows = X.states(spark, d).withColumns({"seq": F.col("id"), "capture_id": F.expr("CASE WHEN id % 10 = 0 THEN NULL ELSE id div 1000 END")})
    half = rows.agg(F.max("seq")).first()[0] // 2
    return A.upsert_sightings(rows.filter(F.col("seq") >= half), A.upsert_sightings(rows.filter(F.col("seq") < half)))


@query(f"{FX}, r AS (SELECT concat('rx', user_id % 40) AS name, event_id AS seq, CAST(user_id % 50 AS DOUBLE) AS lat FROM events) SELECT name, min(seq) AS seq, min_by(lat, seq) AS lat FROM r GROUP BY name")
def a13_register_receivers(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("rx"), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("event_id").alias("seq"), (F.col("user_id") % 50).cast("double").alias("lat"))
    half = rows.agg(F.max("seq")).first()[0] // 2
    return A.register_receivers(rows.filter(F.col("seq") >= half), A.register_receivers(rows.filter(F.col("seq") < half))[0])[0]


HEARTBEATS = "SELECT concat('rx', user_id % 25) AS receiver, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 90 AS DOUBLE) END AS lat, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 180 AS DOUBLE) END AS lon, event_id * 3 AS frames_captured, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 2 END AS frames_sent, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 60 END AS active_aircraft, event_id AS uptime_sec, CAST(1704067200 + event_id * 10 AS DOUBLE) AS received_at FROM {events}"


@query(f"WITH h AS ({HEARTBEATS.format(events='events')}) SELECT receiver, max_by(lat, received_at) FILTER (lat IS NOT NULL) AS lat, max_by(lon, received_at) FILTER (lon IS NOT NULL) AS lon, max_by(frames_captured, received_at) AS frames_captured, max_by(frames_sent, received_at) FILTER (frames_sent IS NOT NULL) AS frames_sent, max_by(active_aircraft, received_at) FILTER (active_aircraft IS NOT NULL) AS active_aircraft, max_by(uptime_sec, received_at) AS uptime_sec, max(received_at) AS last_heartbeat, (SELECT max(received_at) FROM h) - max(received_at) < 120 AS online FROM h GROUP BY receiver")
def a14_receiver_status(spark: SparkSession, d: str) -> DataFrame:
    beats = spark.sql(HEARTBEATS.replace("{events}", "{t}"), t=spark.read.parquet(f"{d}/events.parquet"))
    return A.receiver_status(beats, beats.agg(F.max("received_at")).first()[0])


@query(f"{FX}, r AS (SELECT timestamp, id, coalesce(altitude_ft, 0) AS altitude FROM positions WHERE icao = (SELECT max(icao) FROM positions)) SELECT *, (SELECT greatest(max(altitude), 1000) FROM r) AS axis FROM r WHERE (SELECT count(*) FROM r) > 1")
def a17_altitude_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    return A.altitude_profile(rows, rows.agg(F.max("icao")).first()[0])


@query(f"{FX} SELECT id // 1000 AS capture_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS total_frames, count(DISTINCT icao) AS aircraft_count FROM positions GROUP BY 1")
def t11_capture_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.capture_summary(X.positions(spark, d).withColumn("capture_id", F.expr("id div 1000")))


DIST = haversine_sql("plat", "plon", "lat", "lon")
SCORED = (
    "l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(altitude_ft) OVER w AS palt, lag(timestamp) OVER w AS pt FROM positions WINDOW w AS (PARTITION BY icao ORDER BY id)), "
    f"m AS (SELECT *, timestamp - pt AS dt, {DIST} AS nm FROM l), "
    "f AS (SELECT *, coalesce(speed_kts > 750, false) AS f1, abs(vertical_rate_fpm) > 12000 AS f2, coalesce(dt <= 0, false) AS f3, coalesce(dt > 0 AND nm / (dt / 3600) > 1500, false) AS f4, "
    "coalesce(dt > 0 AND abs((altitude_ft - palt) / dt * 60) > 20000, false) AS f5, coalesce(dt > 0 AND nm < 0.001 AND dt > 30 AND coalesce(speed_kts, 0) > 100, false) AS f6 FROM m), "
    "scored AS (SELECT *, f1::INT + f2::INT + 0.5::DOUBLE * f3::INT + 2 * f4::INT + f5::INT + 0.5::DOUBLE * f6::INT AS rule_score, "
    "concat_ws(',', CASE WHEN f1 THEN 'extreme_speed' END, CASE WHEN f2 THEN 'extreme_vertical_rate' END, CASE WHEN f3 THEN 'nonmonotonic_time' END, CASE WHEN f4 THEN 'position_teleport' END, CASE WHEN f5 THEN 'altitude_jump' END, CASE WHEN f6 THEN 'stuck_position' END) AS flags FROM f)"
)
#: The grid counts the whole table, as its SQL does; the reference's window of 168 hours is in a query of its own above.
GRID = (
    "grid AS (SELECT CAST(floor(lat / 0.1) AS INT) AS lat_b, CAST(floor(lon / 0.1) AS INT) AS lon_b, count(*) AS cnt FROM positions GROUP BY 1, 2), "
    "sums AS (SELECT sum(cnt) AS total, count(*) AS cells FROM grid), codes AS (SELECT cnt, sum(cnt) AS weight, -ln((cnt + 1) / ((SELECT total FROM sums) + (SELECT cells FROM sums))) AS code FROM grid GROUP BY cnt), "
    "runs AS (SELECT code, sum(weight) OVER (ORDER BY code) AS run FROM codes), off AS (SELECT min(code) AS o FROM runs WHERE run >= floor((SELECT total FROM sums) / 2))"
)


@query(f"{FX}, {SCORED} SELECT id, icao, rule_score, flags FROM scored")
def g1_score_positions(spark: SparkSession, d: str) -> DataFrame:
    return G.score_positions(X.positions(spark, d)).select("id", "icao", "rule_score", F.concat_ws(",", "flags").alias("flags"))


DENSITY = "density AS (SELECT p.id, greatest(0.0, least(5.0, -ln((coalesce(g.cnt, 0) + 1) / (s.total + s.cells)) - off.o)) AS density_score FROM positions p LEFT JOIN grid g ON CAST(floor(p.lat / 0.1) AS INT) = g.lat_b AND CAST(floor(p.lon / 0.1) AS INT) = g.lon_b, sums s, off)"


@query(f"{FX}, {GRID}, {DENSITY} SELECT id, round(density_score, 6) AS density_score FROM density")
def g2_density_score(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    return _rounded(G.density_score(rows, A.density_grid(rows, None, 0.1)).select("id", "density_score"))


@query(f"{FX}, {GRID} SELECT round(o, 6) AS offset, CAST(total AS BIGINT) AS total, cells FROM off, sums")
def g3_grid_offset(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.grid_offset(A.density_grid(X.positions(spark, d), None, 0.1)))


@query(f"{FX}, {SCORED}, {GRID}, {DENSITY}, {LATEST_SIGHTING}, r AS (SELECT s.*, density_score, row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, s.id DESC) AS rn FROM scored s JOIN density USING (id)) "
       "SELECT r.id, r.icao, lat, lon, altitude_ft, timestamp, is_military, callsign, round(rule_score + density_score, 6) AS anomaly_score, "
       "CASE WHEN rule_score + density_score < 0.5 THEN 'none' WHEN rule_score + density_score < 2 THEN 'low' WHEN rule_score + density_score < 4 THEN 'med' ELSE 'high' END AS tier "
       "FROM r LEFT JOIN aircraft USING (icao) LEFT JOIN latest_sighting USING (icao) WHERE rn = 1")  # fmt: skip
def g4_latest_scored(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    scored = G.combined_score(G.density_score(G.score_positions(rows), A.density_grid(rows, None, 0.1)))
    last = P.enrich_positions(P.latest_per_key(scored, ["icao"]), X.aircraft(spark, d), X.sightings(spark, d))
    return last.select("id", "icao", "lat", "lon", "altitude_ft", "timestamp", "is_military", "callsign", F.round("anomaly_score", 6).alias("anomaly_score"), G.tier(F.col("anomaly_score")).alias("tier"))


@query(f"{FX}, {GRID} SELECT cells, CAST(total AS BIGINT) AS total, 1.5::DOUBLE AS refreshed_at FROM sums")
def g6_baseline_health(spark: SparkSession, d: str) -> DataFrame:
    return G.baseline_health(A.density_grid(X.positions(spark, d), None, 0.1), 1.5)


WINDOW_GRID = GRID.replace("FROM positions GROUP BY", "FROM positions WHERE timestamp >= (SELECT now FROM clock) - 168 * 3600 GROUP BY")


@query(f"{FX}, {WINDOW_GRID} SELECT lat_b, lon_b, cnt, round(o, 6) AS offset FROM grid, off")
def g5_refresh_baseline(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.refresh_baseline(X.positions(spark, d), _now(spark, d)))


@query(_rollup_sql(300))
def r5_refresh_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A rollup that missed the rows of two in three receivers in its second half is whole again after the refresh."""
    rows, now = X.positions(spark, d), _now(spark, d)
    begin = rows.agg(F.min("timestamp")).first()[0]
    middle = (begin + now) / 2
    old = A.rollup(rows.filter((F.col("timestamp") < middle) | (F.col("receiver_id") == 0)), 300)
    return _rounded(A.refresh_rollup(old, rows, 300, now, now - middle, -300))


#: One position in eight comes late, by an hour; the clock of the first refresh is a third into the data, that of the second at its end.
LATE = (
    f"{FX}, come AS (SELECT *, timestamp + CASE WHEN id % 8 = 0 THEN 3600 ELSE 0 END AS arrives FROM positions), k AS (SELECT min(timestamp) + (max(timestamp) - min(timestamp)) / 3 AS one, max(timestamp) AS two FROM positions), "
    "seen AS (SELECT * FROM come, k WHERE arrives <= one OR (timestamp >= floor((two - 600) / 30) * 30) OR (arrives <= two AND floor(timestamp / 30) * 30 >= floor((two - 7200) / 30) * 30 AND timestamp < floor((two - 600) / 30) * 30))"
)


@query(f"{LATE} SELECT icao, CAST(floor(timestamp / 30) * 30 AS DOUBLE) AS bucket, count(*) AS sample_count, round(avg(lat), 9) AS lat, CAST(trunc(avg(altitude_ft)) AS INT) AS altitude_ft FROM seen GROUP BY icao, 2")
def w9_real_time_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Two refreshes of a stored rollup, of touched buckets alone, and the open buckets: late rows within two hours are in, later ones aren't."""
    rows = X.positions(spark, d)
    ends = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    one, two = ends[0] + (ends[1] - ends[0]) / 3, ends[1]
    come = rows.withColumn("arrives", F.col("timestamp") + F.when(F.col("id") % 8 == 0, 3600).otherwise(0))
    before, after = come.filter(F.col("arrives") <= one).drop("arrives"), come.filter((F.col("arrives") > one)).drop("arrives")
    # what has arrived by the second refresh; rows of open buckets are read as they stand
    by_now = come.filter((F.col("arrives") <= two) | (F.col("timestamp") >= U.finished_before(two, 30, 600))).drop("arrives")
    store = U.refresh(A.rollup(rows.limit(0), 30), before, U.touched(before, 30), 30, one + 600 + 30, 1e9, 600)
    store = U.refresh(store, by_now, U.touched(after, 30), 30, two, 7200, 600)
    return U.real_time(store, by_now, 30, U.finished_before(two, 30, 600)).select("icao", "bucket", "sample_count", F.round("lat", 9).alias("lat"), "altitude_ft")
