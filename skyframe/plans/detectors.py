"""Queries: enrichment joins and event detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata as R
from ..functions.geo import haversine_sql
from ..operators import detectors as D
from ..operators import enrichment as N
from . import fixtures as X
from .base import query

FX = X.FX
LABEL = "coalesce(callsign, icao)"
EV = "icao, '{0}' AS event_type, {1} AS description, lat, lon, altitude_ft, timestamp, id"
BLOCKS_CTE = R.values_sql("blocks", "f, l, country", [(int(a, 16), int(b, 16), c) for a, b, c in R.rows(R.COUNTRY_BLOCKS, 3)])
AIRLINES_CTE = R.values_sql("airlines", "prefix, operator", [tuple(r) for r in R.rows(R.AIRLINES, 2)])
MILITARY = "(icao BETWEEN 'ADF7C8' AND 'AFFFFF' OR coalesce(regexp_matches(upper(trim(callsign)), '^(" + "|".join(R.MILITARY_CALLSIGNS) + ")'), false))"
NEAR = f"near AS (SELECT id, code AS airport, nm AS airport_nm FROM (SELECT s.id, a.code, {haversine_sql('s.lat', 's.lon', 'a.lat', 'a.lon')} AS nm, row_number() OVER (PARTITION BY s.id ORDER BY nm, a.code) AS rn FROM states s, airports a WHERE nm < MAXNM) WHERE rn = 1)"


@query(f"{FX}, {BLOCKS_CTE}, a AS (SELECT DISTINCT icao, CAST('0x' || icao AS BIGINT) AS n FROM states) SELECT icao, country FROM a LEFT JOIN blocks ON n BETWEEN f AND l")
def n1_lookup_country(spark: SparkSession, d: str) -> DataFrame:
    return N.lookup_country(X.aircraft(spark, d).select("icao"), R.country_blocks(spark))


@query(f"WITH {BLOCKS_CTE}, u AS (SELECT o_orderkey, printf('%06X', CAST((o_orderkey * 104729) % 16777216 AS BIGINT)) AS icao, (o_orderkey * 104729) % 16777216 AS n FROM orders) SELECT o_orderkey, icao, country FROM u LEFT JOIN blocks ON n BETWEEN f AND l")
def j7_country_range_join(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", N.icao_text((F.col("o_orderkey") * 104729) % 16777216).alias("icao"))
    return N.lookup_country(keys, R.country_blocks(spark))


@query(f"{FX} SELECT id, icao, callsign, {MILITARY} AS military FROM states")
def n2_is_military(spark: SparkSession, d: str) -> DataFrame:
    return X.states(spark, d).select("id", "icao", "callsign", N.is_military(F.col("icao"), F.col("callsign")).alias("military"))


@query(f"{FX}, {AIRLINES_CTE} SELECT id, callsign, operator FROM states LEFT JOIN airlines ON length(callsign) >= 3 AND upper(substr(callsign, 1, 3)) = prefix")
def n4_lookup_operator(spark: SparkSession, d: str) -> DataFrame:
    return N.lookup_operator(X.states(spark, d).select("id", "callsign"), R.airlines(spark))


N_NUMBER_SQL = """
WITH L AS (SELECT 'ABCDEFGHJKLMNPQRSTUVWXYZ' AS s), u AS (SELECT DISTINCT 10485761 + (o_orderkey * 7919) % 915399 AS n FROM orders),
a AS (SELECT n, n - 10485761 AS o, o // 101711 AS d1, o % 101711 AS r1, (r1 - 1) // 10111 AS d2, (r1 - 1) % 10111 AS r2, (r2 - 1) // 951 AS d3, (r2 - 1) % 951 AS r3, (r3 - 1) // 35 AS d4, (r3 - 1) % 35 AS r4 FROM u),
sfx AS (SELECT i, CASE WHEN i % 25 = 0 THEN substr(s, CAST(i // 25 + 1 AS BIGINT), 1) ELSE substr(s, CAST(i // 25 + 1 AS BIGINT), 1) || substr(s, CAST(i % 25 AS BIGINT), 1) END AS t FROM L, (SELECT unnest(range(0, 600)) AS i))
SELECT printf('%06X', n) AS icao, 'N' || (d1 + 1) || CASE WHEN r1 = 0 THEN '' WHEN r1 - 1 >= 101110 THEN (SELECT t FROM sfx WHERE i = r1 - 1 - 101110)
 ELSE d2 || CASE WHEN r2 = 0 THEN '' WHEN r2 - 1 >= 9510 THEN (SELECT t FROM sfx WHERE i = r2 - 1 - 9510)
 ELSE d3 || CASE WHEN r3 = 0 THEN '' WHEN r3 - 1 >= 350 THEN (SELECT t FROM sfx WHERE i = r3 - 1 - 350)
 ELSE d4 || CASE WHEN r4 = 0 THEN '' WHEN r4 - 1 < 10 THEN '' || (r4 - 1) ELSE substr((SELECT s FROM L), CAST(r4 - 11 + 1 AS BIGINT), 1) END END END END AS registration FROM a
"""


@query(N_NUMBER_SQL)
def n3_n_number(spark: SparkSession, d: str) -> DataFrame:
    number = F.lit(10485761) + (F.col("o_orderkey") * 7919) % 915399
    keys = spark.read.parquet(f"{d}/orders.parquet").select(N.icao_text(number).alias("icao")).distinct()
    return keys.select("icao", N.n_number(F.col("icao")).alias("registration"))


@query(f"{FX} SELECT id, CASE WHEN {MILITARY} THEN 'military' WHEN length(callsign) >= 3 AND substr(callsign, 1, 3) IN ({', '.join(repr(c) for c in R.CARGO)}) THEN 'cargo' WHEN speed_kts > 250 THEN 'jet' WHEN speed_kts < 80 AND altitude_ft < 3000 THEN 'helicopter' "
       "WHEN speed_kts BETWEEN 80 AND 180 AND altitude_ft > 15000 THEN 'turboprop' WHEN speed_kts BETWEEN 80 AND 180 THEN 'prop' WHEN speed_kts > 180 AND speed_kts <= 250 THEN 'turboprop' WHEN altitude_ft > 30000 THEN 'jet' WHEN altitude_ft < 5000 THEN 'prop' ELSE 'unknown' END AS category FROM states")  # fmt: skip
def n5_classify(spark: SparkSession, d: str) -> DataFrame:
    flag = N.is_military(F.col("icao"), F.col("callsign"))
    return X.states(spark, d).select("id", N.classify_from_profile(F.col("speed_kts"), F.col("altitude_ft"), flag, F.col("callsign")).alias("category"))


@query(f"{FX}, {X.AIRPORTS_CTE}, {NEAR.replace('MAXNM', '30')} SELECT id, airport, round(airport_nm, 4) AS airport_nm FROM near")
def n6_nearest_airport(spark: SparkSession, d: str) -> DataFrame:
    rows = N.near_airports(X.positions(spark, d), X.airports(spark), 30.0)
    return rows.select("id", "airport", F.round("airport_nm", 4).alias("airport_nm"))


@query(f"{FX}, {X.AIRPORTS_CTE}, {NEAR.replace('MAXNM', '30')} SELECT s.id, airport, CASE WHEN airport IS NULL THEN NULL WHEN airport_nm < 15 AND altitude_ft < 10000 AND vertical_rate_fpm < -200 THEN printf('Approaching %s (%.0fnm)', airport, airport_nm) WHEN airport_nm < 15 AND altitude_ft < 10000 AND vertical_rate_fpm > 200 THEN printf('Departing %s (%.0fnm)', airport, airport_nm) WHEN airport_nm < 5 THEN printf('Near %s (%.1fnm)', airport, airport_nm) ELSE printf('Overflying %s (%.0fnm)', airport, airport_nm) END AS phase FROM states s LEFT JOIN near USING (id)")
def n7_flight_phase(spark: SparkSession, d: str) -> DataFrame:
    return N.flight_phase(X.positions(spark, d), X.airports(spark)).select("id", "airport", "phase")


@query(f"{FX}, {X.FENCES_CTE} SELECT id, name AS fence, round({haversine_sql('f.lat', 'f.lon', 's.lat', 's.lon')}, 4) AS fence_nm FROM states s, fences f WHERE {haversine_sql('f.lat', 'f.lon', 's.lat', 's.lon')} <= radius_nm")
def j11_inside_fences(spark: SparkSession, d: str) -> DataFrame:
    return N.inside_fences(X.positions(spark, d), X.fences(spark)).select("id", "fence", F.round("fence_nm", 4).alias("fence_nm"))


def _ev(kind: str, text: str) -> str:
    return EV.format(kind, text)


MIL = _ev("military_detected", f"'Military aircraft detected: ' || {LABEL}")
EMG = _ev("emergency_squawk", f"'Squawk ' || squawk || ': ' || CASE squawk WHEN '7500' THEN 'Hijack' WHEN '7600' THEN 'Radio failure' ELSE 'Emergency' END || ' - ' || {LABEL}")
RAP = _ev("rapid_descent", f"'Rapid descent ' || vertical_rate_fpm || ' ft/min - ' || {LABEL} || ' at ' || coalesce(CAST(altitude_ft AS VARCHAR), '?') || ' ft'")
LOW = _ev("low_altitude", f"'Low altitude ' || altitude_ft || ' ft - ' || {LABEL}")


@query(f"{FX} SELECT {MIL} FROM states WHERE {MILITARY}")
def x1_military_detected(spark: SparkSession, d: str) -> DataFrame:
    return D.military(X.states(spark, d))


@query(f"{FX} SELECT {EMG} FROM states WHERE squawk IN ('7500', '7600', '7700')")
def x2_emergency_squawk(spark: SparkSession, d: str) -> DataFrame:
    return D.emergency(X.states(spark, d))


@query(f"{FX} SELECT {RAP} FROM states WHERE vertical_rate_fpm < -5000")
def x3_rapid_descent(spark: SparkSession, d: str) -> DataFrame:
    return D.rapid_descent(X.states(spark, d))


@query(f"{FX} SELECT {LOW} FROM states WHERE altitude_ft > 0 AND altitude_ft < 500")
def x4_low_altitude(spark: SparkSession, d: str) -> DataFrame:
    return D.low_altitude(X.states(spark, d))


HIST = ("o AS (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY id) AS k FROM states), "
        "h AS (SELECT o.id, o.icao, o.callsign, o.lat, o.lon, o.altitude_ft, o.timestamp, o.k, p.k AS pk, p.timestamp AS pt, p.heading_deg AS ph, p.altitude_ft AS pa FROM o JOIN o p ON o.icao = p.icao AND p.k BETWEEN o.k - 119 AND o.k)")  # fmt: skip
TURN = ("t AS (SELECT *, lag(ph) OVER (PARTITION BY id ORDER BY pk) AS qh FROM h WHERE pt >= timestamp - 300), "
        "c AS (SELECT id, icao, callsign, lat, lon, altitude_ft, timestamp, count(*) AS n, sum(least(abs(ph - qh) % 360, 360 - abs(ph - qh) % 360)) AS turned FROM t GROUP BY ALL)")  # fmt: skip


@query(f"{FX}, {HIST}, {TURN} SELECT icao, 'circling' AS event_type, 'Circling detected: ' || {LABEL} || printf(' - %.0f deg heading change', turned) AS description, lat, lon, altitude_ft, timestamp, id FROM c WHERE n >= 4 AND turned >= 360")
def x5_circling(spark: SparkSession, d: str) -> DataFrame:
    return D.circling(D.with_frames(X.states(spark, d)))


HOLD = ("r AS (SELECT * FROM h WHERE pt >= timestamp - 120), al AS (SELECT id, min(k) AS k, count(pa) AS na, max(pa) - min(pa) AS spread, CAST(floor(sum(pa) / count(pa)) AS BIGINT) AS mean, count(ph) AS nh FROM r GROUP BY id), "
        "b AS (SELECT id, CAST(floor(ph / 10) % 36 AS INT) AS bin, count(*) AS n FROM r GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, bin) AS rn FROM b), "
        "two AS (SELECT x.id, x.n AS n1, y.n AS n2, abs(x.bin - y.bin) AS sep FROM rk x JOIN rk y ON x.id = y.id AND x.rn = 1 AND y.rn = 2)")  # fmt: skip


@query(f"{FX}, wide AS (SELECT * REPLACE (CAST((id // 6) % 2 * 180 AS DOUBLE) AS heading_deg, CAST(3000 + id % 300 AS INT) AS altitude_ft) FROM states), {HIST.replace('FROM states', 'FROM wide')}, {HOLD} "
       f"SELECT o.icao, 'holding_pattern' AS event_type, 'Holding pattern: ' || {LABEL} || ' - stable at ' || mean || ' ft, reciprocal headings' AS description, lat, lon, altitude_ft, timestamp, o.id FROM o JOIN al USING (id) JOIN two USING (id) WHERE o.k >= 8 AND na >= 4 AND spread <= 500 AND nh >= 8 AND n1 >= 2 AND n2 >= 2 AND abs(CASE WHEN sep > 18 THEN 36 - sep ELSE sep END - 18) <= 3")  # fmt: skip
def x6_holding_pattern(spark: SparkSession, d: str) -> DataFrame:
    steady = X.states(spark, d).withColumns({"heading_deg": F.expr("CAST((id div 6) % 2 * 180 AS DOUBLE)"), "altitude_ft": F.expr("CAST(3000 + id % 300 AS INT)")})
    return D.holding(D.with_frames(steady))


@query(f"{FX}, {X.AIRPORTS_CTE}, {NEAR.replace('MAXNM', '15')} SELECT {_ev('unusual_altitude', f'''concat('Unusual altitude: ', {LABEL}, ' at ', altitude_ft, printf(' ft, %.0f kts, far from airports', speed_kts))''')} FROM states WHERE speed_kts > 200 AND altitude_ft > 0 AND altitude_ft < 3000 AND id NOT IN (SELECT id FROM near)")
def x7_unusual_altitude(spark: SparkSession, d: str) -> DataFrame:
    return D.unusual_altitude(X.states(spark, d), X.airports(spark))


SESSIONS = "g AS (SELECT id, icao, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY icao ORDER BY id) > 60 THEN 1 ELSE 0 END AS new FROM states), sessions AS (SELECT id, CAST(sum(new) OVER (PARTITION BY icao ORDER BY id) AS BIGINT) AS session FROM g)"


@query(f"{FX}, {SESSIONS} SELECT * FROM sessions")
def t8_contact_sessions(spark: SparkSession, d: str) -> DataFrame:
    return D.contact_sessions(X.states(spark, d)).select("id", "session")


@query(f"{FX}, {SESSIONS}, {X.FENCES_CTE}, inside AS (SELECT s.id, s.icao, f.name AS fence FROM states s, fences f WHERE {haversine_sql('f.lat', 'f.lon', 's.lat', 's.lon')} <= radius_nm) SELECT icao, fence, session, min(id) AS id FROM inside JOIN sessions USING (id) GROUP BY icao, fence, session")
def x8_geofence_entry(spark: SparkSession, d: str) -> DataFrame:
    states = X.states(spark, d)
    sessions = D.contact_sessions(states)
    rows = D.dedup_events(D.geofence_entry(states, X.fences(spark)), sessions, ("icao", "event_type", "fence"))
    return rows.join(sessions.select("id", "session"), "id").select("icao", "fence", "session", "id")


PAIRS = (
    "tick_last AS (SELECT CAST(floor(timestamp / 10) AS BIGINT) AS tick, icao, max(id) AS id FROM states GROUP BY 1, 2), "
    "tick_held AS (SELECT l.*, s.lat, s.lon, s.altitude_ft AS alt, least(CAST(floor((s.timestamp + 60) / 10) AS BIGINT) - 1, coalesce(lead(tick) OVER (PARTITION BY l.icao ORDER BY tick) - 1, 9e15::BIGINT), (SELECT max(tick) FROM tick_last)) AS until FROM tick_last l JOIN states s USING (id)), "
    "tick_state AS (SELECT * EXCLUDE (tick, until), unnest(range(tick, greatest(tick, until) + 1)) AS tick FROM tick_held), "
    f"pairs AS (SELECT a.tick, a.icao AS a_icao, b.icao AS b_icao, a.id AS a_id, b.id AS b_id, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS nm FROM tick_state a JOIN tick_state b ON a.tick = b.tick AND a.icao < b.icao WHERE {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 5 AND coalesce(abs(a.alt - b.alt), 0) <= 1000)"
)
CLOSE = "close AS (SELECT a_icao AS icao, b_icao AS other, min_by(a_id, tick) AS id FROM pairs JOIN sessions x ON x.id = a_id JOIN sessions y ON y.id = b_id GROUP BY a_icao, b_icao, x.session, y.session)"


@query(f"{FX}, {SESSIONS}, {PAIRS}, {CLOSE} SELECT icao, other, id FROM close")
def x9_proximity_events(spark: SparkSession, d: str) -> DataFrame:
    states = X.states(spark, d)
    return D.proximity_events(D.proximity(states), D.contact_sessions(states)).select("icao", "other", "id")


@query(f"{FX}, {PAIRS} SELECT tick, a_icao, b_icao, round(nm, 4) AS nm FROM pairs")
def x9_proximity(spark: SparkSession, d: str) -> DataFrame:
    return D.proximity(X.states(spark, d)).select("tick", "a_icao", "b_icao", F.round("nm", 4).alias("nm"))


@query(f"{FX}, {SESSIONS}, e AS (SELECT icao, id, 'emergency_squawk' AS event_type FROM states WHERE squawk <> '1200' UNION ALL SELECT icao, id, 'rapid_descent' FROM states WHERE vertical_rate_fpm < -5000) SELECT icao, event_type, session, min(id) AS id FROM e JOIN sessions USING (id) GROUP BY ALL")
def x10_dedup_events(spark: SparkSession, d: str) -> DataFrame:
    states = X.states(spark, d)
    sessions = D.contact_sessions(states)
    rows = D.dedup_events(D.emergency(states).unionByName(D.rapid_descent(states)), sessions)
    return rows.join(sessions.select("id", "session"), "id").select("icao", "event_type", "session", "id")


ALL_EVENTS = (
    f"{FX}, {SESSIONS}, {X.FENCES_CTE}, {X.AIRPORTS_CTE}, {HIST}, {TURN}, {HOLD}, {NEAR.replace('MAXNM', '15')}, e AS (SELECT icao, id, 'military_detected' AS event_type, NULL AS fence FROM states WHERE {MILITARY} "
    "UNION ALL SELECT icao, id, 'emergency_squawk', NULL FROM states WHERE squawk <> '1200' UNION ALL SELECT icao, id, 'rapid_descent', NULL FROM states WHERE vertical_rate_fpm < -5000 "
    "UNION ALL SELECT icao, id, 'low_altitude', NULL FROM states WHERE altitude_ft > 0 AND altitude_ft < 500 UNION ALL SELECT icao, id, 'circling', NULL FROM c WHERE n >= 4 AND turned >= 360 "
    "UNION ALL SELECT o.icao, o.id, 'holding_pattern', NULL FROM o JOIN al USING (id) JOIN two USING (id) WHERE o.k >= 8 AND na >= 4 AND spread <= 500 AND nh >= 8 AND n1 >= 2 AND n2 >= 2 AND abs(CASE WHEN sep > 18 THEN 36 - sep ELSE sep END - 18) <= 3 "
    "UNION ALL SELECT icao, id, 'unusual_altitude', NULL FROM states WHERE speed_kts > 200 AND altitude_ft > 0 AND altitude_ft < 3000 AND id NOT IN (SELECT id FROM near) "
    f"UNION ALL SELECT s.icao, s.id, 'geofence_entry', f.name FROM states s, fences f WHERE {haversine_sql('f.lat', 'f.lon', 's.lat', 's.lon')} <= radius_nm) "
    f", {PAIRS}, {CLOSE} SELECT icao, event_type, fence, min(id) AS id FROM e JOIN sessions USING (id) GROUP BY icao, event_type, fence, session UNION ALL SELECT icao, 'proximity', NULL, id FROM close"
)


@query(ALL_EVENTS)
def x11_detect_all(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_all(X.states(spark, d), X.fences(spark), X.airports(spark)).select("icao", "event_type", "fence", "id")


@query(f"{FX}, ty AS (SELECT DISTINCT icao, 'type ' || substr(icao, 1, 2) AS type_name FROM states WHERE icao > 'A5') SELECT id, description || CASE WHEN type_name IS NULL THEN '' ELSE ' (' || type_name || ')' END AS description FROM flight_events LEFT JOIN ty USING (icao)")
def x13_enrich_description(spark: SparkSession, d: str) -> DataFrame:
    types = X.aircraft(spark, d).filter("icao > 'A5'").select("icao", F.concat(F.lit("type "), F.substring("icao", 1, 2)).alias("type_name"))
    return D.enrich_description(X.flight_events(spark, d), types).select("id", "description")
