"""Detectors on a stream tell what the batch form tells of single aircraft."""

import time

import pytest
from pyspark.sql import functions as F

from skyframe.operators import detectors as D
from skyframe.plans import fixtures as X
from skyframe.streaming import detect


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_batch(streaming, spark, tmp_path, batches):
    rows = X.states(spark, "/root/testdata/sf0.001").withColumn("timestamp", (F.col("timestamp") - 1704067200) * 8 + 1000)
    # one aircraft flies to and fro at a steady height, some headings and heights are missing
    steady = F.col("icao") == rows.agg(F.min("icao")).first()[0]
    rows = rows.withColumns({
        "heading_deg": F.when(steady, F.expr("CAST((id div 60) % 2 * 180 AS DOUBLE)")).when(F.col("id") % 7 > 0, F.col("heading_deg")),
        "altitude_ft": F.when(steady, F.expr("CAST(3000 + id % 300 AS INT)")).otherwise(F.col("altitude_ft")),
        "timestamp": F.when(steady, F.round(F.col("timestamp") / 8, 3)).otherwise(F.col("timestamp")),
    }).cache()
    steps = sorted(x.timestamp for x in rows.select("timestamp").collect())
    edges = [steps[len(steps) * k // batches] for k in range(1, batches)]
    for lo, hi in zip([-1.0, *edges], [*edges, 1e18]):
        rows.filter((F.col("timestamp") > lo) & (F.col("timestamp") <= hi)).orderBy(F.hash("id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.05)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events = detect.detect(source, X.fences(spark), X.airports(spark))
    events.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    text = lambda df: sorted(str(tuple(r)) for r in df.select("icao", "event_type", "description", "lat", "lon", "altitude_ft", "timestamp", "id", "fence").collect())
    want = D.detect_all(rows, X.fences(spark), X.airports(spark)).filter("event_type <> 'proximity'")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert text(got) == text(want)
    assert got.select("event_type").distinct().count() == 8
