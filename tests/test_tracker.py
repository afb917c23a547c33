"""The live tracker gives what the batch operators give, in whatever micro-batches the frames come."""

import time

import pytest
from pyspark.sql import functions as F

from skyframe.functions import modes, refdata
from skyframe.operators import streams as C
from skyframe.operators import track as T
from skyframe.streaming import tracker

SCHEMA = "receiver string, seq long, hex string, timestamp double"
PLACES = [("r0", 36.0, -81.5), ("r1", 35.2, -82.0), ("r2", None, None)]


@pytest.fixture(scope="module")
def frames(spark, encoded):
    """Aircraft fall silent and come back; addresses in clear are rare for some."""
    rows = [r for r in encoded if not (r[2].startswith("8D") and r[1] // 7 % 4 > 0) and r[1] // 7 % 20 < 16]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def stream(spark, frames, tmp_path, batches, run):
    """Rows of ``run`` over the frames in so many files, each shuffled, one a micro-batch."""
    seqs = sorted(x.seq for x in frames.select("seq").collect())
    edges = [seqs[len(seqs) * k // batches] for k in range(1, batches)]
    for lo, hi in zip([-1, *edges], [*edges, 1 << 60]):
        frames.filter((F.col("seq") > lo) & (F.col("seq") <= hi)).orderBy(F.hash("seq")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.05)  # files are taken by time of modification
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = run(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def rows(df, *columns):
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("batches", [5])
def test_address_check_equals_batch(streaming, spark, frames, tmp_path, batches):
    got = stream(spark, frames, tmp_path, batches, lambda f: tracker.check_addresses(modes.parse_frames(f, validate_icao=False)))
    want, all_ = modes.parse_frames(frames), modes.parse_frames(frames, validate_icao=False)
    assert rows(got, *want.columns) == rows(want, *want.columns) and want.count() < all_.count()


@pytest.mark.parametrize("batches", [1, 6])
def test_four_streams_equal_batch(streaming, spark, frames, tmp_path, batches):
    places = spark.createDataFrame(PLACES, "receiver string, lat double, lon double")
    tagged = stream(spark, frames, tmp_path, batches, lambda f: tracker.track(f, places=places)).cache()
    messages = modes.decode_messages(modes.parse_frames(frames)).cache()
    blocks = refdata.country_blocks(spark)
    capture = F.expr("CAST(substring(receiver, 2) AS BIGINT)")
    got = C.split_changes(tagged, blocks, capture)
    want = C.change_streams(messages, blocks, capture, places=places, silence=60.0)
    for name in want:
        assert {*got[name].columns} == {*want[name].columns}, name
        assert rows(got[name], *want[name].columns) == rows(want[name], *want[name].columns), name
    again = want["new_aircraft"].groupBy("receiver", "icao").count().filter("count > 1").count()
    assert again > 5 and want["position_updates"].count() > 100

    contacts = T.contacts(messages)
    state = T.running_state(contacts, (*T.KEY, "contact"))
    columns = ("receiver", "icao", "contact", "seq", "callsign", "squawk", "altitude_ft", "speed_kts", "heading_deg", "vertical_rate_fpm", "is_military", "message_count")
    assert rows(tagged.filter("kind = 'message'"), *columns) == rows(state.withColumn("is_military", F.coalesce("is_military", F.lit(False))), *columns)
    ends = contacts.groupBy("receiver", "icao", "contact").agg(F.max_by("timestamp", "seq").alias("timestamp"))
    told, every = rows(tagged.filter("kind = 'contact_end'"), "receiver", "icao", "contact", "timestamp"), rows(ends, "receiver", "icao", "contact", "timestamp")
    assert {*told} <= {*every} and len({*told}) == len(told) and len(told) >= len(every) - ends.select("receiver", "icao").distinct().count()


def test_receivers_at_different_places(spark):
    """One position report alone is resolved near its own receiver, and not at all where that has no place."""
    even = "8D40621D58C382D690C8AC2863A7"
    far = [("near", 52.25, 3.92), ("wide", 40.0, 3.92), ("none", None, None)]
    m = modes.decode_messages(modes.parse_frames(spark.createDataFrame([(r, k, even, 1.0) for k, (r, *_) in enumerate(far)], SCHEMA)))
    got = {x.receiver: (x.lat, x.lon) for x in T.resolve_positions(m, places=spark.createDataFrame(far, "receiver string, lat double, lon double")).collect()}
    assert set(got) == {"near", "wide"} and abs(got["near"][0] - 52.2572) < 1e-4 and abs(got["near"][1] - 3.9194) < 1e-4
    assert abs(got["wide"][0] - 40.0) <= 3 and got["wide"] != got["near"]


def test_no_local_fix_across_a_silence(spark):
    """A fix from before a silence is no reference after it: the report alone isn't resolved any more."""
    pair = ["8D40621D58C386435CC412692AD6", "8D40621D58C382D690C8AC2863A7"]
    m = lambda t: modes.decode_messages(modes.parse_frames(spark.createDataFrame([("r", 0, pair[0], 1.0), ("r", 1, pair[1], 2.0), ("r", 2, pair[1], t)], SCHEMA)))
    key = (*T.KEY, "contact")
    seqs = lambda t, silence: {x.seq for x in T.resolve_positions(T.contacts(m(t), silence), key=key).collect()}
    assert seqs(40.0, 60.0) == {1, 2} and seqs(62.5, 60.0) == {1} and seqs(62.0, 60.0) == {1, 2}
    assert [x.contact for x in T.new_aircraft(T.contacts(m(62.5)), key).orderBy("contact").collect()] == [0, 2]
