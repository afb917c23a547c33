"""Readers on files, table jobs on their files, and the plain streaming forms against batch aggregates."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from skyframe.operators import aggregates, maintenance, track
from skyframe.operators.positions import latest_per_key
from skyframe.sources import readers
from skyframe.streaming import jobs


@pytest.mark.parametrize("block", ["64", "1000", "128m"])
def test_capture_files_in_blocks(spark, tmp_path, block):
    """Blocks smaller than a line, of some lines, and of the whole file give the same numbers: those of the lines."""
    want = {}
    for name, n in (("a.txt", 400), ("b.txt", 7), ("c.txt", 0)):
        lines = ["# note" if k % 5 == 0 else "" if k % 7 == 0 else f"*{k:014X};" if k % 2 else f" {k:028x} " for k in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + ("\r\n" if n == 7 else ""))
        want |= {(name, k): f"{k:014X}" if k % 2 else f"{k:028X}" for k in range(n) if k % 5 and k % 7}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = {(x.file.rsplit("/", 1)[1], x.seq): x.hex for x in readers.read_frame_text(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_documents_and_reference_files(spark, tmp_path):
    (tmp_path / "batch.json").write_text(json.dumps({"receiver": "r", "frames": [{"hex": "8d00000000000f"}, {"hex": "02", "timestamp": 9.5}], "timestamp": 5.0}) + "\n" + json.dumps({"receiver": "big", "frames": [{"hex": "00"}] * 5001, "timestamp": 1.0}))
    frames, rejected = readers.explode_batches(readers.read_frame_batches(spark, f"{tmp_path}/batch.json"))
    assert sorted((x.i, x.hex, x.timestamp) for x in frames.collect()) == [(0, "8D00000000000F", 5.0), (1, "02", 9.5)]
    assert [x.receiver for x in rejected.collect()] == ["big"]
    (tmp_path / "beats.json").write_text('{"receiver": "r", "lat": 1.5, "frames_captured": 7}\n{"receiver": "s", "uptime_sec": 3}')
    assert {x.receiver: (x.lat, x.frames_captured, x.uptime_sec) for x in readers.read_heartbeats(spark, f"{tmp_path}/beats.json").collect()} == {"r": (1.5, 7, None), "s": (None, None, 3)}
    (tmp_path / "ais.json").write_text('{"MessageType": "X"}\n{"a": 1}')
    assert readers.read_ais(spark, f"{tmp_path}/ais.json").count() == 2
    (tmp_path / "airports.csv").write_text("icao,name,lat,lon,elevation_ft,type\nKAVL,A,35.4,-82.5,2165,large_airport\nKX,B,1,2,,small_airport\nKY,C,bad,2,1,small_airport\nKZ,short\nKW,D,3,4,5,heliport\n")
    got = {x.code: (x.lat, x.lon, x.elevation_ft, x.kind) for x in readers.read_airports(spark, f"{tmp_path}/airports.csv").collect()}
    assert got == {"KAVL": (35.4, -82.5, 2165, "major"), "KX": (1.0, 2.0, 0, "small"), "KW": (3.0, 4.0, 5, None)}


def test_table_with_a_later_column(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/positions/a")
    spark.range(2).withColumn("anomaly_score", F.lit(0.5)).write.parquet(f"{tmp_path}/positions/b")
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{tmp_path}/positions")
    assert rows.count() == 5 and rows.filter("anomaly_score IS NULL").count() == 3
    spark.range(4).write.parquet(f"{tmp_path}/vessels")
    assert readers.load_table(spark, str(tmp_path), "vessels").count() == 4


def test_compacted_files_cover_spans(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'HOT' ELSE concat('I', id % 50) END AS icao", "CAST(id * 7919 % 6000 AS DOUBLE) * 43 AS timestamp")
    maintenance.compact(rows.repartition(5), f"{tmp_path}/t", rows_per_file=700)
    back = spark.read.parquet(f"{tmp_path}/t").withColumn("f", F.input_file_name())
    spans = back.groupBy("dt", "f").agg(F.min(F.struct("icao", -F.col("timestamp"))).alias("lo"), F.max(F.struct("icao", -F.col("timestamp"))).alias("hi"), F.count("*").alias("n")).orderBy("dt", "lo").collect()
    assert back.count() == 6000 and len(spans) > 6 and max(s.n for s in spans) <= 700
    assert all(a.dt != b.dt or tuple(a.hi) < tuple(b.lo) for a, b in zip(spans, spans[1:]))


def test_phantoms_go_from_all_tables(spark):
    craft = spark.createDataFrame([("A", 0.0), ("B", 0.0), ("C", 9e9)], "icao string, last_seen double")
    gone = maintenance.phantoms(craft, spark.createDataFrame([("A", 1.0)], "icao string, lat double"), 1.0, 9e9)
    left = maintenance.prune_phantoms({"aircraft": craft, "events": spark.createDataFrame([("B",), ("C",), ("B",)], "icao string")}, gone)
    assert sorted(x.icao for x in left["aircraft"].collect()) == ["A", "C"] and [x.icao for x in left["events"].collect()] == ["C"]
    assert [x.icao for x in track.stale_keys(craft, 61.0).collect()] == ["A", "B"] and [x.icao for x in track.active(craft, 60.0).collect()] == ["C", "A", "B"]


def test_windowed_streams_equal_batch(streaming, spark, tmp_path):
    rows = spark.range(900).selectExpr("id AS seq", "concat('I', id % 7) AS icao", "1000 + CAST(id div 3 + id div 300 * 100 AS DOUBLE) AS timestamp", "id / 9 AS lat", "-id / 9 AS lon", "CAST(id AS INT) AS altitude_ft").cache()
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def through(df, name):
        df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    want = {(x.icao, x.bucket): (x.sample_count, round(x.lat, 6)) for x in aggregates.rollup(rows.withColumns({c: F.lit(None).cast("double") for c in ("speed_kts", "heading_deg", "vertical_rate_fpm")}), 30).collect()}
    got = {(x.icao, x.t): (x.sample_count, round(x.lat, 6)) for x in through(jobs.rollup(source(), "30 seconds", "5 seconds").withColumn("t", F.unix_timestamp("window.start").cast("double")), "rollup").collect()}
    newest = rows.agg(F.max("timestamp")).first()[0]
    assert got == {k: v for k, v in want.items() if k[1] + 30 <= newest - 5}  # what is past the watermark
    got = {(x.icao, x.messages) for x in through(jobs.contact_sessions(source(), "60 seconds", "5 seconds"), "sessions").collect()}
    per = rows.groupBy("icao", F.expr("seq div 300").alias("s")).count().collect()
    assert got == {(x.icao, x["count"]) for x in per if x.s < 2} and len(per) == 21

    jobs.start(source(), jobs.snapshot_writer(f"{tmp_path}/snap"), f"{tmp_path}/c-snap", None).awaitTermination()
    assert glob.glob(f"{tmp_path}/snap/batch=*")
    snap = spark.read.parquet(f"{tmp_path}/snap")
    assert {(x.icao, x.seq) for x in snap.collect()} == {(x.icao, x.seq) for x in latest_per_key(rows, ["icao"], ("seq",)).collect()}
