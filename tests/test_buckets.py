"""Bucketed tables: what a batch writes, retries, readers, and the live path from frames to tables."""

import os
import time

from pyspark.sql import functions as F

from skyframe.functions import modes, refdata
from skyframe.operators import streams as C
from skyframe.streaming import buckets, jobs, tracker


def total(old, new):
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy("k").agg(F.sum("v").alias("v"))


def put(spark, root, token, pairs, extra=()):
    df = lambda rows: spark.createDataFrame(rows, "k string, v long")
    return buckets.merge(spark, root, token, {"sums": (df(pairs), "k", total)}, {"log": df(list(extra))}, 16)


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{root}/data") for f in fs if f.endswith(".parquet")}


def test_merge(spark, tmp_path):
    root = str(tmp_path)
    assert buckets.read(spark, root) == {}
    assert len(put(spark, root, "q:0", [(f"k{i}", 1) for i in range(200)], [("a", 1)])["sums"]) == 16
    first, reader = files(root), buckets.read(spark, root)
    hit = put(spark, root, "q:1", [("k3", 5), ("new", 7)], [("b", 2)])["sums"]
    written = files(root) - first
    assert len(hit) <= 2 and len([f for f in written if "/sums/" in f]) == len(hit)  # only the buckets of the batch
    assert reader["sums"].agg(F.sum("v")).first()[0] == 200 and reader["log"].count() == 1  # who reads on sees one version
    want = {f"k{i}": 1 for i in range(200)} | {"k3": 6, "new": 7}
    rows = lambda: {x.k: x.v for x in buckets.read(spark, root)["sums"].collect()}
    assert rows() == want and put(spark, root, "q:1", [("k3", 5)]) == {} and rows() == want  # a repeated batch
    (tmp_path / "data/sums/version=2/bucket=0").mkdir(parents=True)  # a batch that stopped before its manifest
    (tmp_path / "data/log/version=2").mkdir(parents=True)
    assert rows() == want and buckets.read(spark, root)["log"].count() == 2
    put(spark, root, "other:0", [("k3", 1)])  # another query, whose batches count from 0 again
    put(spark, root, "other:1", [])
    put(spark, root, "other:2", [(f"k{i}", 1) for i in range(200)])
    assert rows() == {**{f"k{i}": 2 for i in range(200)}, "k3": 8, "new": 7}
    for k in range(3, 6):
        put(spark, root, f"other:{k}", [(f"k{i}", 0) for i in range(200)] + [("new", 0)])
    assert len([f for f in files(root) if "/sums/" in f]) <= 32 and len(os.listdir(f"{root}/manifests")) <= 6 and rows()["k3"] == 8


def test_live_tables_equal_batch(streaming, spark, encoded, tmp_path):
    frames = spark.createDataFrame([r for r in encoded if r[1] < 2800], "receiver string, seq long, hex string, timestamp double").cache()
    for lo in range(0, 2800, 700):
        frames.filter((F.col("seq") >= lo) & (F.col("seq") < lo + 700)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.05)
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    blocks, capture, root = refdata.country_blocks(spark), F.expr("CAST(substring(receiver, 2) AS BIGINT)"), f"{tmp_path}/tables"
    jobs.start(tracker.track(source), jobs.live_writer(root, blocks, capture, 8), f"{tmp_path}/c", None).awaitTermination()
    messages = modes.decode_messages(modes.parse_frames(frames)).cache()
    want, got = C.apply_change_streams(C.change_streams(messages, blocks, capture, silence=60.0)), buckets.read(spark, root)
    text = lambda df, cs: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*cs).collect())
    for t in ("aircraft", "sightings", "positions"):
        assert text(got[t], sorted(want[t].columns)) == text(want[t], sorted(want[t].columns)), t
    assert got["contact_ends"].count() > 0 and want["aircraft"].count() > 10
