"""Frames streamed into tables give what one batch over the same frames gives."""

import time

from pyspark.sql import functions as F

from skyframe.functions import modes, refdata
from skyframe.operators import streams
from skyframe.streaming import jobs

#: Published frames of three aircraft: identification, positions, a velocity.
FRAMES = ["8D4840D6202CC371C32CE0576098", "8D40621D58C382D690C8AC2863A7", "8D485020994409940838175B284F", "8D40621D58C386435CC412692AD6", "8D40621D58C382D690C8AC2863A7", "8D4840D6202CC371C32CE0576098"]


def _rows(tables):
    return {t: sorted(map(str, (x.asDict(True) for x in tables[t].select(*sorted(tables[t].columns)).collect()))) for t in jobs.TABLES}


def test_streamed_tables_equal_the_batch_and_retries_count_once(spark, tmp_path):
    rows = [("r", i, h, 100.0 + i) for i, h in enumerate(FRAMES)]
    schema = "receiver string, seq long, hex string, timestamp double"
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by time of modification
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    blocks, out = refdata.country_blocks(spark), f"{tmp_path}/tables"
    write = jobs.table_writer(out, blocks)
    assert jobs.read_tables(spark, out) == {}
    jobs.start(jobs.decode(source), write, f"{tmp_path}/checkpoint", None).awaitTermination()

    messages = modes.decode_messages(modes.parse_frames(spark.createDataFrame(rows, schema), validate_icao=False))
    whole = streams.apply_change_streams(streams.change_streams(messages, blocks))
    got = _rows(jobs.read_tables(spark, out))
    assert got == _rows(whole) and len(got["aircraft"]) == 3 and sum("'message_count': 2" in x for x in got["sightings"]) == 1
    assert jobs._complete(spark, out) == [1, 2]  # the version before stays, older ones are gone

    last = messages.filter(F.col("seq") >= 4)
    write(last, 2)  # the same batch again
    assert _rows(jobs.read_tables(spark, out)) == got
    write(last.limit(0), 3)  # an empty batch changes nothing
    assert _rows(jobs.read_tables(spark, out)) == got
