"""Queries: vessels, derived series, maintenance, exports and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions.geo import haversine_sql
from ..operators import aggregates as A
from ..operators import maintenance as M
from ..operators import positions as P
from ..operators import series as S
from ..operators import sinks as K
from ..operators import vessels as V
from ..sources import readers
from . import fixtures as X
from .base import query

FX, COLS = X.FX, X.COLUMNS
SHIPS_CTE = R.values_sql("ships", "f, l, label", [(int(a), int(b), c) for a, b, c in R.rows(R.SHIP_TYPES, 3)])

# AIS documents from events: three kinds of message, metadata under two names, sentinels, places out of range.
MMSI = "CAST(200000000 + user_id AS STRING)"
LAT, LON = "CAST(event_id % 2000 AS DOUBLE) / 10 - 100", "CAST(event_id % 3700 AS DOUBLE) / 10 - 185"
SOG = "CASE WHEN event_id % 11 = 0 THEN 102.3 ELSE CAST(event_id % 300 AS DOUBLE) / 10 END"
COG = "CASE WHEN event_id % 13 = 0 THEN 360 ELSE event_id % 360 END"
HDG = "CASE WHEN event_id % 17 = 0 THEN 511 ELSE event_id % 360 END"
CODE = "event_id % 110"
# static data of a kind that isn't read, fill characters before and inside names, numbers of ships as text
KIND = "CASE WHEN event_id % 25 = 0 THEN 'StaticDataReport' ELSE 'ShipStaticData' END"
STATIC_NAME = "concat(CASE WHEN event_id % 3 = 0 THEN '@ ' ELSE '' END, 'SHIP@ ', user_id)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    value = f"""CASE WHEN event_id % 5 = 0 THEN
      format_string('{{"MessageType":"%s","MetaData":{{"MMSI":%s,"ShipName":"META %d@@"}},"Message":{{"%s":{{"Name":"%sSHIP@ %d@@","Type":%d}}}}}}', {KIND}, {MMSI}, user_id, {KIND}, CASE WHEN event_id % 3 = 0 THEN '@ ' ELSE ' ' END, user_id, {CODE})
     WHEN event_id % 7 = 0 THEN '{{"MessageType":"Other","MetaData":{{"MMSI":1}},"Message":{{}}}}'
     ELSE concat('{{"MessageType":"PositionReport","', CASE WHEN event_id % 2 = 0 THEN 'MetaData' ELSE 'Metadata' END, '":{{"MMSI":', CASE WHEN event_id % 23 = 0 THEN concat('"', {MMSI}, '"') ELSE {MMSI} END, ',"ShipName":"', CASE WHEN event_id % 3 = 0 THEN '@@@' ELSE concat('SHIP ', user_id, '  ') END,
       '"}},"Message":{{"PositionReport":{{"Latitude":', {LAT}, ',"Longitude":', {LON}, ',"Sog":', {SOG}, ',"Cog":', {COG}, ',"TrueHeading":', {HDG}, '}}}}}}') END"""
    return e.select("event_id", F.expr(value).alias("value"), (F.lit(1704067200.0) + F.col("event_id") * 0.25).alias("timestamp"))


VPOS = f"""vpos AS (SELECT event_id, {MMSI} AS mmsi, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('SHIP ', user_id) END AS name, {LAT} AS lat, {LON} AS lon, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 300 AS DOUBLE) / 10 END AS sog,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 360 AS DOUBLE) END AS cog, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 360 AS DOUBLE) END AS heading, 1704067200.0::DOUBLE + event_id * 0.25::DOUBLE AS timestamp
 FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 23 <> 0 AND {LAT} BETWEEN -90 AND 90 AND {LON} BETWEEN -180 AND 180)"""


def _vessel_positions(spark: SparkSession, d: str) -> DataFrame:
    return V.parse_positions(V.parse_ais(_documents(spark, d)), "event_id", "timestamp")


@query(f"WITH {VPOS} SELECT event_id, mmsi, name, lat, lon, sog, cog, heading FROM vpos")
def v1_parse_ais_positions(spark: SparkSession, d: str) -> DataFrame:
    return _vessel_positions(spark, d).drop("timestamp")


@query(f"WITH {SHIPS_CTE} SELECT event_id, {MMSI} AS mmsi, {STATIC_NAME} AS name, coalesce(label, 'Unknown') AS vessel_type FROM events LEFT JOIN ships ON {CODE} BETWEEN f AND l WHERE event_id % 5 = 0 AND event_id % 25 <> 0")
def v2_parse_ais_static(spark: SparkSession, d: str) -> DataFrame:
    return V.parse_static(V.parse_ais(_documents(spark, d)), R.ship_types(spark), "event_id").drop("flag")


VESSELS = (f"WITH {VPOS}, {SHIPS_CTE}, u AS (SELECT mmsi, name, NULL AS vessel_type, timestamp, event_id AS seq FROM vpos WHERE name IS NOT NULL UNION ALL SELECT {MMSI}, {STATIC_NAME}, coalesce(label, 'Unknown'), 1704067200.0::DOUBLE + event_id * 0.25::DOUBLE, event_id FROM events LEFT JOIN ships ON {CODE} BETWEEN f AND l WHERE event_id % 5 = 0 AND event_id % 25 <> 0) "
       "SELECT mmsi, max_by(name, seq) AS name, max_by(vessel_type, seq) FILTER (vessel_type IS NOT NULL) AS vessel_type, min_by(timestamp, seq) AS first_seen, max_by(timestamp, seq) AS last_seen FROM u GROUP BY mmsi")  # fmt: skip


@query(VESSELS)
def v4_vessels_upserted(spark: SparkSession, d: str) -> DataFrame:
    docs = V.parse_ais(_documents(spark, d))
    updates = V.parse_updates(docs, R.ship_types(spark), "timestamp", F.col("event_id").alias("seq"))
    half = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] // 2
    table = A.upsert_vessels(updates.filter(F.col("seq") < half))
    return A.upsert_vessels(updates.filter(F.col("seq") >= half), table).drop("flag")


@query(f"SELECT * FROM ({VESSELS}) ORDER BY last_seen DESC, mmsi LIMIT 100")
def v5_get_vessels(spark: SparkSession, d: str) -> DataFrame:
    return V.get_vessels(v4_vessels_upserted(spark, d), 100)


@query(f"WITH {VPOS} SELECT event_id, mmsi, lat, lon FROM vpos WHERE timestamp >= (SELECT max(timestamp) FROM vpos) - 600 ORDER BY timestamp DESC, event_id DESC LIMIT 1000")
def v6_vessel_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = _vessel_positions(spark, d).withColumn("id", F.col("event_id"))
    return P.recent(rows, 10, 1000).select("event_id", "mmsi", "lat", "lon")


@query(f"WITH {VPOS}, t AS (SELECT * FROM (SELECT *, max(timestamp) OVER (PARTITION BY mmsi) AS top FROM vpos) WHERE timestamp = top) SELECT event_id, mmsi, lat, lon FROM t ORDER BY timestamp DESC, mmsi LIMIT 200")
def v7_latest_vessel_positions(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_vessel_positions(_vessel_positions(spark, d), 200).select("event_id", "mmsi", "lat", "lon")


@query(f"WITH {VPOS} SELECT event_id, mmsi FROM vpos WHERE (lat BETWEEN -60 AND -20 AND lon BETWEEN -150 AND -100) OR (lat BETWEEN 40 AND 50 AND lon BETWEEN -60 AND -30)")
def v8_bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    return V.in_boxes(_vessel_positions(spark, d), [(-60, -150, -20, -100), (40, -60, 50, -30)]).select("event_id", "mmsi")


@query(f"SELECT floor((1704067200.0::DOUBLE + event_id * 0.25::DOUBLE) / 60) * 60.0::DOUBLE AS bucket, count(*) FILTER (pos) AS positions, count(*) FILTER (sta) AS statics, count(*) FILTER (NOT pos AND NOT sta) AS dropped FROM (SELECT *, event_id % 5 = 0 AND event_id % 25 <> 0 AS sta, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 23 <> 0 AND {LAT} BETWEEN -90 AND 90 AND {LON} BETWEEN -180 AND 180 AS pos FROM events) GROUP BY 1")
def a18_ais_ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.ingest_stats(V.parse_ais(_documents(spark, d)), 60)


@query(f"{FX}, n AS (SELECT icao, timestamp AS t0, lat, lon, id, lead(timestamp) OVER w AS t1, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, altitude_ft AS a, lead(altitude_ft) OVER w AS a1, heading_deg AS h, lead(heading_deg) OVER w AS h1 FROM positions WINDOW w AS (PARTITION BY icao ORDER BY timestamp, id)), g AS (SELECT s + k * 20.0::DOUBLE AS t FROM (SELECT min(timestamp) AS s, unnest(range(0, CAST(ceil((max(timestamp) - min(timestamp) + 300) / 20) AS BIGINT))) AS k FROM positions)) "
       ", m AS (SELECT *, CASE WHEN t1 - t0 <= 300 THEN (t - t0) / (t1 - t0) ELSE 0 END AS f FROM n JOIN g ON t >= t0 AND t < coalesce(t1, 1e18) AND t < CASE WHEN t1 - t0 <= 300 THEN t1 ELSE t0 + 300 END) "
       "SELECT icao, t, round(CASE WHEN t1 - t0 <= 300 THEN lat + (t - t0) / (t1 - t0) * (lat1 - lat) ELSE lat END, 6) AS lat, round(CASE WHEN t1 - t0 <= 300 THEN lon + (t - t0) / (t1 - t0) * (lon1 - lon) ELSE lon END, 6) AS lon, CAST(round(a + f * (coalesce(a1, a) - a)) AS INT) AS altitude_ft, round(fmod(h + f * (fmod(coalesce(h1, h) - h + 540, 360) - 180) + 360, 360), 6) AS heading_deg FROM m")  # fmt: skip
def i1_interpolate_at(spark: SparkSession, d: str) -> DataFrame:
    span = X.positions(spark, d).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    rows = S.interpolate_at(X.positions(spark, d), 20.0, span["first"], span["last"] + 300)
    return rows.select("icao", "t", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "altitude_ft", F.round("heading_deg", 6).alias("heading_deg"))


@query(f"{FX} SELECT icao, id, step, round(lat + speed_kts * (5.0::DOUBLE / 60) * step / 4 / 60 * cos(radians(heading_deg)), 6) AS lat, round(lon + speed_kts * (5.0::DOUBLE / 60) * step / 4 / 60 * sin(radians(heading_deg)) / cos(radians(lat)), 6) AS lon FROM positions, (SELECT CAST(unnest([1, 2, 3, 4]) AS INT) AS step) WHERE speed_kts >= 30")
def i2_dead_reckon(spark: SparkSession, d: str) -> DataFrame:
    rows = S.dead_reckon(X.positions(spark, d), 5.0)
    return rows.select("icao", "id", "step", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


KM = haversine_sql("plat", "plon", "lat", "lon", 6371.0)


@query(f"{FX}, p AS (SELECT *, floor(coalesce(altitude_ft, 0) / 5000) AS band, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(floor(coalesce(altitude_ft, 0) / 5000)) OVER w AS pband FROM positions WINDOW w AS (PARTITION BY icao ORDER BY timestamp, id)), "
       f"f AS (SELECT *, plat IS NULL OR {KM} > 50 AS far FROM p), c AS (SELECT *, NOT far AND pband <> band AS change FROM f), s AS (SELECT *, sum(CASE WHEN far OR change THEN 1 ELSE 0 END) OVER (PARTITION BY icao ORDER BY timestamp, id) AS segment FROM c), "
       "x AS (SELECT icao, id, CAST(segment AS BIGINT) AS segment FROM s UNION ALL SELECT icao, id, CAST(segment - 1 AS BIGINT) FROM s WHERE change) SELECT icao, id, segment FROM (SELECT *, count(*) OVER (PARTITION BY icao, segment) AS n FROM x) WHERE n > 1")  # fmt: skip
def i3_trail_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.trail_segments(X.positions(spark, d)).select("icao", "id", "segment")


@query(f"{FX}, n AS (SELECT icao, lat, lon, row_number() OVER w AS k, lead(lat) OVER w AS lat0, lead(lon) OVER w AS lon0 FROM positions WHERE icao IN (SELECT icao FROM aircraft WHERE last_seen < (SELECT now FROM clock) - 2) WINDOW w AS (PARTITION BY icao ORDER BY timestamp DESC, id DESC)), "
       "r AS (SELECT icao, degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) AS d FROM n WHERE k = 1 AND lat0 IS NOT NULL) SELECT icao, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) AS heading_deg FROM r")  # fmt: skip
def i4_derived_heading(spark: SparkSession, d: str) -> DataFrame:
    rows = X.aircraft(spark, d)
    now = rows.agg(F.max("last_seen")).first()[0]
    live = rows.filter(F.col("last_seen") >= now - 2)
    return S.derived_heading(X.positions(spark, d), live).select("icao", F.round("heading_deg", 4).alias("heading_deg"))


@query(f"{FX} SELECT {COLS} FROM positions WHERE timestamp <= (SELECT (min(timestamp) + max(timestamp)) / 2 FROM positions)")
def i5_trail_up_to(spark: SparkSession, d: str) -> DataFrame:
    rows = X.positions(spark, d)
    return S.trail_up_to(rows, rows.agg((F.min("timestamp") + F.max("timestamp")) / 2).first()[0])


def _now(spark: SparkSession, d: str) -> float:
    return X.positions(spark, d).agg(F.max("timestamp")).first()[0]


@query(f"{FX} SELECT {COLS} FROM positions WHERE timestamp >= (SELECT now FROM clock) - 0.2 * 3600")
def m1_prune(spark: SparkSession, d: str) -> DataFrame:
    return M.prune(X.positions(spark, d), 0.2, _now(spark, d))


THIN = "SELECT max(id) AS id FROM positions WHERE timestamp < (SELECT now FROM clock) - 0.1 * 3600 {0} GROUP BY icao, floor(timestamp / 30) UNION ALL SELECT id FROM positions WHERE timestamp >= (SELECT now FROM clock) - 0.1 * 3600"


@query(f"{FX} {THIN.format('')}")
def m2_downsample(spark: SparkSession, d: str) -> DataFrame:
    return M.downsample(X.positions(spark, d), 0.1, 30, _now(spark, d)).select("id")


@query(f"{FX} {THIN.format('AND timestamp >= (SELECT now FROM clock) - 0.5 * 3600')}")
def m3_tiered_retention(spark: SparkSession, d: str) -> DataFrame:
    return M.tiered_retention(X.positions(spark, d), _now(spark, d), 0.5, 0.1, 30).select("id")


@query(f"{FX} SELECT icao FROM aircraft WHERE last_seen < (SELECT now FROM clock) - 1 AND icao NOT IN (SELECT icao FROM positions WHERE NOT regexp_matches(icao, '[08]$'))")
def m4_phantoms(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that end in 0 or 8 never say where they are; all others' positions are looked at."""
    rows = X.positions(spark, d).withColumn("lat", F.when(~F.col("icao").rlike("[08]$"), F.col("lat")))
    return M.phantoms(X.aircraft(spark, d), rows.filter("lat IS NOT NULL"), 1 / 3600, _now(spark, d)).select("icao")


@query(f"{FX} SELECT {COLS}, CAST(NULL AS DOUBLE) AS anomaly_score FROM positions")
def m5_add_missing_column(spark: SparkSession, d: str) -> DataFrame:
    return M.add_missing_column(X.positions(spark, d), "anomaly_score", "double")


@query(f"{FX} SELECT icao, lat, lon, altitude_ft, CASE WHEN speed_kts IS NULL THEN NULL ELSE printf('%.1f', speed_kts) END AS speed_kts, printf('%.1f', heading_deg) AS heading_deg, vertical_rate_fpm, timestamp FROM positions")
def k1_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return K.csv_rows(X.positions(spark, d))


#: Aircraft as exports see them; documents are cut into small parts here, so that every size of table has joints.
CRAFT = "SELECT icao, CASE WHEN icao < 'A8' THEN concat('N', substr(icao, 2)) END AS registration, CASE WHEN icao > 'A4' THEN 'A & <B>' END AS country, is_military, first_seen, last_seen FROM {aircraft}"
SMALL_PARTS = 16
RANKED = f"{FX}, craft AS ({CRAFT.format(aircraft='aircraft')}), ranked AS (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY timestamp DESC, id DESC) AS k, least(1000, count(*) OVER (PARTITION BY icao)) AS n FROM positions)"


def _craft(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CRAFT.replace("{aircraft}", "{t}"), t=X.aircraft(spark, d))


def _joined(parts: DataFrame, text: str, *keys: str) -> DataFrame:
    """Each document as its parts say, of 1,000 positions at most."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", text))), lambda x: x[text]), "")
    return parts.groupBy(*keys).agg(whole.alias("text"))


@query(f"{RANKED} SELECT icao, registration, country, is_military, first_seen, last_seen, CAST(k - 1 AS INT) AS place, lat, lon, altitude_ft, speed_kts, heading_deg, vertical_rate_fpm, timestamp FROM ranked JOIN craft USING (icao) WHERE k <= 1000")
def k3_nested_json(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every position, read back from the joined documents."""
    rows = _joined(K.nested_json(_craft(spark, d), X.positions(spark, d), rows=SMALL_PARTS), "json", "icao")
    point = "lat: DOUBLE, lon: DOUBLE, altitude_ft: INT, speed_kts: DOUBLE, heading_deg: DOUBLE, vertical_rate_fpm: INT, timestamp: DOUBLE"
    doc = F.from_json("text", f"icao STRING, registration STRING, country STRING, is_military BOOLEAN, first_seen DOUBLE, last_seen DOUBLE, positions ARRAY<STRUCT<{point}>>", {"mode": "FAILFAST"})
    rows = rows.select(doc.alias("doc")).select("doc.*")
    return rows.select("icao", "registration", "country", "is_military", "first_seen", "last_seen", F.posexplode("positions").alias("place", "p")).select("*", "p.*").drop("p")


@query(f"{RANKED} SELECT icao, concat(coalesce(registration, icao), CASE WHEN country IS NULL THEN '' ELSE ' (A &amp; &lt;B&gt;)' END) AS name, CAST(n - k AS INT) AS place, lon, lat, CAST(round_even(coalesce(altitude_ft, 0) * 0.3048::DOUBLE, 0) AS BIGINT) AS metres FROM ranked JOIN craft USING (icao) WHERE k <= 1000")
def k4_kml(spark: SparkSession, d: str) -> DataFrame:
    """Every point of every placemark; a placemark that isn't whole has no points."""
    rows = _joined(K.kml_fragments(X.positions(spark, d), _craft(spark, d), rows=SMALL_PARTS), "fragment", "icao")
    form = "^<Placemark><name>([^<]*)</name><styleUrl>#flightTrack</styleUrl><LineString><altitudeMode>absolute</altitudeMode><tessellate>1</tessellate><coordinates>([-+.0-9E, ]*)</coordinates></LineString></Placemark>$"
    part = lambda k: F.regexp_extract("text", form, k)
    points = rows.select("icao", part(1).alias("name"), F.posexplode(F.split(part(2), " ")).alias("place", "p"))
    value = lambda k, kind, to: F.split("p", ",")[k].cast(kind).alias(to)
    return points.select("icao", "name", "place", value(0, "double", "lon"), value(1, "double", "lat"), value(2, "long", "metres"))


@query(f"{RANKED} SELECT icao, 'Point' AS kind, 0 AS place, lon, lat, CAST(NULL AS BIGINT) AS n, is_military, speed_kts FROM ranked JOIN craft USING (icao) WHERE k = 1 "
       "UNION ALL SELECT icao, 'LineString', CAST(n - k AS INT), lon, lat, n, is_military, NULL FROM ranked JOIN craft USING (icao) WHERE k <= 1000 AND n > 1")  # fmt: skip
def k5_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Every point of every feature, read back from the joined documents."""
    rows = _joined(K.geojson_fragments(X.positions(spark, d), _craft(spark, d), rows=SMALL_PARTS), "feature", "icao", "kind")
    form = "type STRING, geometry STRUCT<type: STRING, coordinates: {0}>, properties STRUCT<icao: STRING, is_military: BOOLEAN, speed_kts: DOUBLE, position_count: BIGINT>"
    read = lambda kind, shape: rows.filter(F.col("kind") == kind).select(F.from_json("text", form.format(shape), {"mode": "FAILFAST"}).alias("f"))
    about = ["f.properties.icao", F.col("f.geometry.type").alias("kind")]
    end = [F.col("c")[0].alias("lon"), F.col("c")[1].alias("lat"), F.col("f.properties.position_count").alias("n"), "f.properties.is_military", "f.properties.speed_kts"]
    points = read("Point", "ARRAY<DOUBLE>").select("f", F.lit(0).alias("place"), F.col("f.geometry.coordinates").alias("c")).select(*about, "place", *end)
    lines = read("LineString", "ARRAY<ARRAY<DOUBLE>>").select("f", F.posexplode("f.geometry.coordinates").alias("place", "c")).select(*about, "place", *end)
    return points.unionByName(lines)


@query(f"{FX} SELECT 'adsb' AS layer, CAST('2024-01-01' AS DATE) + CAST(floor((timestamp - 1704067200) / 86400) AS INT) AS dt, icao, lat, speed_kts FROM positions")
def k6_raw_ndjson(spark: SparkSession, d: str) -> DataFrame:
    rows = K.raw_envelopes(X.positions(spark, d), "adsb", "receiver")
    p = F.from_json("value", "payload STRUCT<icao: STRING, speed_kts: DOUBLE>, geom STRUCT<lat: DOUBLE>")
    return rows.withColumn("p", p).select("layer", "dt", "p.payload.icao", "p.geom.lat", "p.payload.speed_kts")


@query("SELECT o_orderkey, CAST('1970-01-01' AS DATE) + CAST(floor((o_orderkey * 86399 - 1000000000) / 86400) AS INT) AS day FROM orders")
def k7_civil_date(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select("o_orderkey", K.civil_date((F.col("o_orderkey") * 86399 - 1_000_000_000).cast("double")).alias("day"))


LINES = "CASE event_id % 6 WHEN 0 THEN '# note' WHEN 1 THEN concat('  ', {h}, ' ') WHEN 2 THEN concat('*', {h}, ';') WHEN 3 THEN '' WHEN 4 THEN concat({h}, ';', event_id, '.5') ELSE concat('*', {h}) END"


@query("WITH f AS (SELECT event_id AS seq, printf('%014X', CAST(event_id * 7919 AS BIGINT)) AS hex FROM events) SELECT seq, hex, CASE WHEN seq % 6 = 4 THEN seq + 0.5 ELSE NULL END::DOUBLE AS timestamp FROM f WHERE seq % 6 IN (1, 2, 4)")
def s1_frame_lines(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    h = "lower(lpad(hex(event_id * 7919), 14, '0'))"
    lines = e.select(F.col("event_id").alias("seq"), F.expr(LINES.format(h=h)).alias("value"))
    return readers.frame_lines(lines).select("seq", "hex", "timestamp")


@query("WITH f AS (SELECT event_id AS seq, user_id AS k, CASE WHEN event_id % 10 = 4 THEN CAST(event_id AS DOUBLE) ELSE NULL END AS t FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS r, count(t) OVER (PARTITION BY k ORDER BY seq) AS g FROM f), "
       "b AS (SELECT *, max(t) OVER (PARTITION BY k, g) AS base, min(CASE WHEN t IS NOT NULL THEN r END) OVER (PARTITION BY k, g) AS first_r FROM n) SELECT seq, round(coalesce(base, 0) + (r - coalesce(first_r, 0)) * 0.1::DOUBLE, 6) AS timestamp FROM b")  # fmt: skip
def s2_synthetic_time(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), "user_id", F.expr("CASE WHEN event_id % 10 = 4 THEN CAST(event_id AS DOUBLE) END").alias("timestamp"))
    return readers.with_synthetic_time(e, 0.1, "user_id").select("seq", F.round("timestamp", 6).alias("timestamp"))


@query("WITH b AS (SELECT user_id, event_id // 50 AS batch, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY ALL) SELECT concat('rx', user_id) AS receiver, i - 1 AS i, printf('%014X', CAST(ids[i] AS BIGINT)) AS hex, round(CASE WHEN ids[i] % 2 = 0 THEN ids[i] * 1.0::DOUBLE ELSE batch + (i - 1) * 0.001::DOUBLE END, 6) AS timestamp FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM b) WHERE len(ids) <= 5000")
def s3_frame_batches(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    f = F.struct(F.lower(F.lpad(F.hex("event_id"), 14, "0")).alias("hex"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("double")).alias("timestamp"), F.lit(None).cast("double").alias("signal_level"))
    packed = e.groupBy("user_id", F.expr("event_id div 50").alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", f.alias("f")))), lambda x: x["f"]).alias("frames"))
    batches = packed.select(F.concat(F.lit("rx"), F.col("user_id").cast("string")).alias("receiver"), "frames", F.col("batch").cast("double").alias("timestamp"))
    rows = readers.explode_batches(batches)[0]
    return rows.select("receiver", "i", "hex", F.round("timestamp", 6).alias("timestamp"))


@query("SELECT printf('%06X', CAST(user_id AS BIGINT)) AS icao, CASE WHEN max(event_id) % 4 = 0 THEN NULL ELSE concat('T', max(event_id) % 9) END AS type_name FROM events GROUP BY user_id")
def s7_aircraft_types(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    name = F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit("T"), (F.col("event_id") % 9).cast("string")))
    rows = e.select(F.lower(F.lpad(F.hex("user_id"), 6, "0")).alias("icao"), *(F.lit("").alias(c) for c in ("registration", "type_code")), name.alias("type_name"), *(F.lit(" ").alias(c) for c in ("operator", "category")), F.col("event_id").alias("seq"))
    return readers.aircraft_types(rows).select("icao", "type_name")
