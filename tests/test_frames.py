"""Published frames, hand-made tracks, and the streaming fold against the batch fold."""

import time

import pytest
from pyspark.sql import functions as F

from skyframe.functions import cpr, modes
from skyframe.operators import anomaly, detectors, enrichment, series, track
from skyframe.sources import readers
from skyframe.streaming import jobs

FRAMES = ["8D4840D6202CC371C32CE0576098", "8D406B902015A678D4D220AA4BDA", "8D40621D58C382D690C8AC2863A7", "8D40621D58C386435CC412692AD6", "8D485020994409940838175B284F", "8D4840D6202CC371C32CE0576099"]


def frames(spark, hexes, step=1.0):
    return spark.createDataFrame([("r", i, h, i * step) for i, h in enumerate(hexes)], "receiver string, seq long, hex string, timestamp double")


def test_published_frames(spark):
    got = {r.seq: r for r in modes.decode_messages(modes.parse_frames(frames(spark, FRAMES))).collect()}
    assert got[0].icao == "4840D6" and got[0].callsign == "KLM1023 " and got[1].callsign == "EZY85MH "
    assert (got[2].altitude_ft, got[2].cpr_odd, got[2].cpr_lat, got[2].cpr_lon) == (38000, False, 93000, 51372)
    assert (got[3].altitude_ft, got[3].cpr_odd, got[3].cpr_lat, got[3].cpr_lon) == (38000, True, 74158, 50194)
    assert tuple(got[4].velocity) == (159.2, 182.88, -832, "ground")
    assert got[5].corrected and got[5].callsign == "KLM1023 "
    wrong = modes.parse_frames(frames(spark, ["8D4840D6202CC371C32CE0576000"])).collect()[0]
    assert not wrong.crc_ok


def test_position_pairs(spark):
    def pair(t_even, t_odd):
        return spark.range(1).select(cpr.decode_global(*(F.lit(x) for x in (93000, 51372, 74158, 50194, t_even, t_odd))).alias("p")).first().p

    assert pair(1.0, 0.0).lat == pytest.approx(52.2572, abs=1e-4) and pair(1.0, 0.0).lon == pytest.approx(3.9194, abs=1e-4)
    assert pair(11.0, 0.0) is None
    local = spark.range(1).select(cpr.decode_local(F.lit(93000), F.lit(51372), F.lit(False), F.lit(52.25), F.lit(3.92)).alias("p")).first().p
    assert local.lat == pytest.approx(52.2572, abs=1e-4)
    zones = spark.range(1).select(*(cpr.zones_at(F.lit(x)) for x in (0.0, 87.0, -87.0, 90.0))).first()
    assert list(zones) == [59, 1, 1, 1]


def test_fold_uses_the_last_fix_and_stream_equals_batch(spark, tmp_path):
    even, odd = (False, 93000, 51372), (True, 74158, 50194)
    # the pair gives a fix; an even report alone much later is resolved against that fix
    rows = [("r", "40621D", k, t, "position", *m) for k, (t, m) in enumerate([(0.0, odd), (1.0, even), (30.0, even)])]
    rows.append(("q", "40621D", 3, 0.0, "position", *even))
    table = spark.createDataFrame(rows, "receiver string, icao string, seq long, timestamp double, msg_type string, cpr_odd boolean, cpr_lat long, cpr_lon long")
    batch = {r.seq: r for r in track.resolve_positions(table).collect()}
    assert set(batch) == {1, 2} and batch[2].lat == pytest.approx(52.2572, abs=1e-3) and batch[1].stored and batch[2].stored
    assert track.resolve_positions(table, (52.2, 3.9)).count() == 4

    for k, r in enumerate(rows):  # one file and so one micro-batch for each row
        spark.createDataFrame([r], table.schema).coalesce(1).write.parquet(str(tmp_path / f"in/f{k}"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = jobs.resolve_positions(stream).writeStream.format("memory").queryName("fixes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    # a query with timeouts runs batches without data too, and so never counts as done
    for _ in range(240):
        if len(query.recentProgress) and sum(p["numInputRows"] for p in query.recentProgress) >= len(rows):
            break
        time.sleep(0.5)
    query.stop()
    got = {r.seq: tuple(r) for r in spark.sql("SELECT * FROM fixes").collect()}
    assert got == {k: tuple(v) for k, v in batch.items()}


def test_frame_lines(spark):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(["# x", "", f"*{FRAMES[0].lower()};", f" {FRAMES[1]} ", f"*{FRAMES[1]}", "8D48", f"{FRAMES[2]};12.5"])], "seq long, value string")
    got = [(r.seq, r.hex, r.timestamp) for r in readers.frame_lines(lines).orderBy("seq").collect()]
    assert got == [(2, FRAMES[0], None), (3, FRAMES[1], None), (6, FRAMES[2], 12.5)]


def test_registrations(spark):
    rows = spark.createDataFrame([("A00001",), ("A00002",), ("ADF7C8",), ("A00724",), ("zz",)], "icao string")
    assert [r[0] for r in rows.select(enrichment.n_number(F.col("icao"))).collect()][:3] == ["N1", "N10", None]


def test_circling_and_stuck(spark):
    rows = [(k, "A1", 35.0, -83.0, 3000, 150.0, float(k * 10 % 360), 0, 1000 + k * 7.5, None) for k in range(40)]
    s = spark.createDataFrame(rows, "id long, icao string, lat double, lon double, altitude_ft int, speed_kts double, heading_deg double, vertical_rate_fpm int, timestamp double, callsign string")
    assert detectors.circling(detectors.with_frames(s)).count() > 0
    far = s.filter("id IN (0, 39)")
    assert anomaly.score_positions(far).filter("id = 39").first().flags == ["stuck_position"]


def test_proximity_plan_is_an_equi_join(spark):
    rows = [(k, f"A{k % 7}", 35.0 + k % 5 / 100, -83.0, 3000, float(k), None) for k in range(60)]
    s = spark.createDataFrame(rows, "id long, icao string, lat double, lon double, altitude_ft int, timestamp double, callsign string")
    pairs = detectors.proximity(s)
    assert pairs.count() > 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_segments_need_two_points(spark):
    rows = [(0, "A", 35.0, -83.0, 100, 0.0), (1, "A", 35.1, -83.0, 200, 1.0), (2, "A", 36.5, -83.0, 200, 2.0)]
    p = spark.createDataFrame(rows, "id long, icao string, lat double, lon double, altitude_ft int, timestamp double")
    assert sorted(r.id for r in series.trail_segments(p).collect()) == [0, 1]
