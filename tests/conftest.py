import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def encoded(spark):
    """Frames of the smallest tables, encoded once: (receiver, seq, hex, timestamp), over about half an hour."""
    from pyspark.sql import functions as F

    from skyframe.plans import frames

    rows = frames.frames(spark, "/root/testdata/sf0.001").withColumn("timestamp", F.round((F.col("timestamp") - 1704067200) * 8 + 1000, 3))
    return [tuple(r[c] for c in ("receiver", "seq", "hex", "timestamp")) for r in rows.collect()]


@pytest.fixture
def streaming(spark):
    """The session with the state store that several state variables need, and few partitions: each is a worker a batch."""
    from skyframe.streaming import tracker

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(*next(iter(tracker.STATE_STORE.items())))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
