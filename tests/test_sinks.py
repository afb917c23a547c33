"""Exports: every aircraft's document and whole documents against plain Python, at any size of part; writers read back."""

import glob
import json
import xml.etree.ElementTree as ET
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyframe.operators import aggregates, numbering, sinks
from skyframe.plans import fixtures

NS = "{http://www.opengis.net/kml/2.2}"
CRAFT = "icao string, registration string, country string, is_military boolean, first_seen double, last_seen double"


@pytest.fixture(scope="module")
def hot(spark):
    """An aircraft with most of the rows, one with a few, one with one, one without; times that tie."""
    icao = "CASE WHEN id < 700 THEN 'A' WHEN id < 705 THEN 'B' ELSE 'C' END AS icao"
    rows = spark.range(706).selectExpr(
        "id", icao, "CAST(id * 7919 % 706 div 2 AS DOUBLE) AS timestamp", "id / 10 AS lat", "-id / 10 AS lon", "CASE WHEN id % 3 > 0 THEN CAST(id AS INT) END AS altitude_ft",
        "CASE WHEN id % 5 > 0 THEN CAST(id AS DOUBLE) END AS speed_kts", "CAST(id % 360 AS DOUBLE) AS heading_deg", "CAST(id % 7 AS INT) AS vertical_rate_fpm",
    ).repartition(3)
    craft = [(c, None if c == "B" else "R&<" + c, None if c == "C" else "US", c == "A", 1.0, float(t)) for c, t in zip("ABCD", (5, 9, 9, 1))]
    return rows, spark.createDataFrame(craft, CRAFT)


def tracks(positions):
    out = defaultdict(list)
    for x in sorted(positions.collect(), key=lambda x: (x.timestamp, x.id)):
        out[x.icao].append(x)
    return out


def joined(lines):
    return "\n".join(x.value for x in sorted(lines.collect(), key=lambda x: x["at"]))


def point(x):
    return {k: x[k] for k in sinks.POINT}


def expected_json(positions, aircraft, newest):
    track = tracks(positions)
    craft = sorted(aircraft.collect(), key=lambda a: (-a.last_seen, a.icao))
    return [{**{k: a[k] for k in sinks.CRAFT}, "positions": [point(x) for x in track[a.icao][::-1][:newest]]} for a in craft]


@pytest.mark.parametrize("newest", [None, 50])
@pytest.mark.parametrize("rows", [1, 16, 1024])
def test_whole_documents(hot, newest, rows):
    positions, aircraft = hot
    track = tracks(positions)
    own = {k: v[-newest:] if newest else v for k, v in track.items()}
    stats = aggregates.stats({"aircraft": aircraft, "positions": positions}, "positions", 400.0)
    doc = json.loads(joined(sinks.json_document(aircraft, positions, stats, newest, rows)))
    assert doc["aircraft"] == expected_json(positions, aircraft, newest)
    assert doc["stats"] == {"aircraft": 4, "positions": 706, "feed_age_seconds": 48.0}

    root = ET.fromstring(joined(sinks.kml_document(positions, aircraft, newest, rows)))
    marks = root.findall(f"{NS}Document/{NS}Placemark")
    assert [m.find(f"{NS}name").text for m in marks] == ["B (US)", "R&<C", "R&<A (US)"]
    assert root.find(f"{NS}Document/{NS}Style").get("id") == "flightTrack"
    for c, m in zip("BCA", marks):
        line = [tuple(map(float, p.split(","))) for p in m.find(f"{NS}LineString/{NS}coordinates").text.split()]
        assert line == [(x.lon, x.lat, float(f"{(x.altitude_ft or 0) * 0.3048:.0f}")) for x in own[c]]

    doc = json.loads(joined(sinks.geojson_document(positions, aircraft, newest, rows)))
    assert doc["type"] == "FeatureCollection"
    kinds = [(f["properties"]["icao"], f["geometry"]["type"]) for f in doc["features"]]
    assert kinds == [("B", "Point"), ("B", "LineString"), ("C", "Point"), ("A", "Point"), ("A", "LineString")]
    for f in doc["features"]:
        c, kind = f["properties"]["icao"], f["geometry"]["type"]
        chain, last = [[x.lon, x.lat] for x in own[c]], track[c][-1]
        assert f["geometry"]["coordinates"] == (chain[-1] if kind == "Point" else chain)
        about = {"altitude_ft": last.altitude_ft, "speed_kts": last.speed_kts, "heading_deg": last.heading_deg, "feature_type": "position"}
        assert f["properties"].items() >= (about if kind == "Point" else {"feature_type": "track", "position_count": len(chain)}).items()


def test_nothing_to_export(hot):
    positions, aircraft = (df.limit(0) for df in hot)
    assert json.loads(joined(sinks.json_document(aircraft, positions))) == {"aircraft": [], "stats": {}}
    assert json.loads(joined(sinks.geojson_document(positions, aircraft)))["features"] == []
    assert not ET.fromstring(joined(sinks.kml_document(positions, aircraft))).findall(f".//{NS}Placemark")


def test_parts_are_bounded(hot):
    parts = sinks.geojson_fragments(hot[0], hot[1], newest=None, rows=16)
    n = {(x.icao, x.kind): x["count"] for x in parts.groupBy("icao", "kind").count().collect()}
    assert n["A", "LineString"] == 44 and n["B", "LineString"] == 1 and parts.agg(F.max(F.length("feature"))).first()[0] < 600


def test_every_aircraft_of_a_larger_table(spark):
    """All 1,500 documents, in parts of 16 positions, are what plain Python makes of the rows."""
    positions = fixtures.positions(spark, "/root/testdata/sf0.1")
    aircraft = fixtures.aircraft(spark, "/root/testdata/sf0.1").selectExpr("icao", "CAST(NULL AS STRING) AS registration", "'X' AS country", "is_military", "first_seen", "last_seen")
    texts = defaultdict(list)
    for x in sinks.nested_json(aircraft, positions, newest=None, rows=16).collect():
        texts[x.icao].append((x.part, x.json))
    want = {a["icao"]: a for a in expected_json(positions, aircraft, None)}
    assert len(want) == 1500 and {k: json.loads("".join(t for _, t in sorted(v))) for k, v in texts.items()} == want


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_places_are_exact(spark, keys):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 9 > 0 THEN concat('k', id % 20) END AS k", "CAST(id * 7919 % 3000 AS INT) AS v").repartition(5)
    got = numbering.placed(rows, keys, [F.col("v").desc()]).collect()
    groups = defaultdict(list)
    for x in got:
        groups[x.k if keys else 0].append(x)
    assert sum(map(len, groups.values())) == 3000
    for g in groups.values():
        g.sort(key=lambda x: -x.v)
        assert [x.place for x in g] == list(range(len(g))) and {x.total for x in g} == {len(g)}


def test_writers(spark, hot, tmp_path):
    positions, aircraft = hot
    read = lambda name: "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/{name}/part-*")))
    sinks.write_document(sinks.geojson_document(positions, aircraft, newest=None, rows=16), f"{tmp_path}/geo")
    assert len(json.loads(read("geo"))["features"]) == 5
    sinks.export_json(positions, f"{tmp_path}/flat")
    assert spark.read.json(f"{tmp_path}/flat").count() == 706
    sinks.export_csv(positions, f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True)
    assert back.columns == list(sinks.CSV) and back.count() == 706
    assert {x.speed_kts for x in back.filter("icao = 'B'").collect()} == {None if i % 5 == 0 else f"{i}.0" for i in range(700, 705)}
    for _ in range(2):
        sinks.write_raw_ndjson(sinks.raw_envelopes(positions, "adsb", "receiver"), f"{tmp_path}/raw")
    raw = spark.read.text(f"{tmp_path}/raw")
    assert raw.count() == 1412 and {str(x.dt) for x in raw.select("dt").distinct().collect()} == {"1970-01-01"}
    assert json.loads(raw.filter("value LIKE '%\"icao\":\"C\"%'").first().value)["payload"]["altitude_ft"] is None
