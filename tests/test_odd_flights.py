"""Flights at the edges of what frames can carry: queries on hand-made events, compared with their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skyframe.functions import modes
from skyframe.plans import registry


def check(spark, tmp_path, events, names):
    """Rows (event_id, user_id, value) as the table of events: each query returns what its SQL returns."""
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'").fetchall()
    for name in names:
        df = registry.queries()[name](spark, str(tmp_path))
        columns = ", ".join(df.columns)
        want = c.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want)), name


#: Latitude 35.229, 0.4 m north of a zone's edge: its even report is rounded to the other side.
EDGE = [(1747, 0, 10.0), (3747, 0, 20.0), (5747, 0, 30.0)]


@pytest.mark.parametrize("name", ["c4_pair_reports", "t1_resolve_positions", "t1_position_updates", "t1_live_positions", "t10_counters", "a16_ingest_report"])
def test_pairs_at_the_edge_of_a_zone(spark, tmp_path, name):
    check(spark, tmp_path, EDGE, [name])


#: Values that make altitudes of 50,400 (with 18 feet that no code carries), 70,200 and 50,175 feet.
HIGH = [(1, 3, 560.21), (2, 4, 780.0), (3, 5, 557.5), (4, 3, 100.0), (5, 4, 780.0), (6, 5, 557.5)]


@pytest.mark.parametrize("name", ["d12_position_altitude", "d19_surveillance_altitude", "k8_sightings_table", "t3_latest_state", "t3_running_state", "d26_decode_summary"])
def test_altitudes_above_steps_of_25_feet(spark, tmp_path, name):
    check(spark, tmp_path, HIGH, [name])


def test_codes_of_high_altitudes(spark):
    feet = F.col("id") * 100
    rows = spark.range(308, 1268).select(feet.cast("int").alias("feet"), modes.hundreds_13(feet).alias("code"))
    got = rows.select("feet", "code", modes.altitude_13(F.col("code")).alias("back")).collect()
    assert all(r.back == r.feet for r in got) and len({r.code for r in got}) == 960
    # neighbours differ in one bit: the standard's code is a Gray code
    assert all(bin(a.code ^ b.code).count("1") == 1 for a, b in zip(got, got[1:]))
    # without D bits as before; without a hundred no altitude
    low = spark.range(1).select(modes.altitude_13(F.lit(0x1000).cast("long")), modes.altitude_13(F.lit(0x0001).cast("long"))).first()
    assert tuple(low) == (-1100, None)
