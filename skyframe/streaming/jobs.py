"""Structured Streaming forms: the position fold, merged tables, windowed rollups, contact sessions, snapshot sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import modes
from ..operators import aggregates as A
from ..operators import streams as S
from ..operators.aggregates import event_time
from ..operators.positions import latest_per_key
from ..operators.track import Fold, fold_rows, with_places
from . import buckets as B

_STATE = ", ".join(f"{n} double" for n in Fold.__dataclass_fields__)
SILENCE_MS = 60_000
#: What ``table_writer`` keeps, in the order in which it is written.
TABLES = ("aircraft", "sightings")


def resolve_positions(messages: DataFrame, receiver: tuple[float, float] | None = None, min_interval: float = 2.0, timeout_ms: int = SILENCE_MS) -> DataFrame:
    """The streaming form of the position fold: the same fold, its state kept per key and dropped after a silence.

    Rows of a key are taken in the order of ``seq`` inside a micro-batch; late rows are not reordered across batches.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fold = Fold(*state.get) if state.exists else Fold()
        parts = list(batches)
        rows = pd.concat(parts).sort_values("seq") if parts else pd.DataFrame(columns=["seq", "cpr_odd", "cpr_lat", "cpr_lon", "timestamp", "ref_lat", "ref_lon"])
        out = fold_rows(fold, rows, min_interval)
        state.update(fold.state())
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(*key, *r) for r in out], columns=["receiver", "icao", "seq", "lat", "lon", "stored"])

    rows = messages.filter("msg_type = 'position'").select("receiver", "icao", "seq", "timestamp", "cpr_odd", "cpr_lat", "cpr_lon")
    return with_places(rows, receiver).groupBy("receiver", "icao").applyInPandasWithState(
        run, "receiver string, icao string, seq long, lat double, lon double, stored boolean", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def decode(frames: DataFrame) -> DataFrame:
    """Streaming frames to messages. Addresses from the parity are not checked here: that needs the order of all frames."""
    return modes.decode_messages(modes.parse_frames(frames, validate_icao=False))


def rollup(positions: DataFrame, window: str, late: str = "1 hour") -> DataFrame:
    """Tumbling means per aircraft; rows later than ``late`` are dropped, a window is emitted once it is past that."""
    rows = positions.withColumn("ts", event_time()).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "icao").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("altitude_ft").cast("int").alias("altitude_ft"), F.count("*").alias("sample_count")
    )


def contact_sessions(positions: DataFrame, gap: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    rows = positions.withColumn("ts", event_time()).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "icao").agg(F.count("*").alias("messages"))


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = 2) -> StreamingQuery:
    """Runs ``write(batch, batch_id)`` for each micro-batch; with ``seconds`` None, once over all there is."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def snapshot_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes the latest position of each aircraft in a batch to a folder of the batch's own, so that a retry overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_key(batch, ["icao"], ("seq",)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Versions under a folder of which all tables are written; the last of ``TABLES`` is written last."""
    file = spark._jvm.org.apache.hadoop.fs.Path
    folder = file(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if fs.exists(file(f"{path}/version={v}/{TABLES[-1]}/_SUCCESS")))


def read_tables(spark: SparkSession, path: str, before: int | None = None) -> dict[str, DataFrame]:
    """The newest complete version of the tables (of those before one); nothing if there is none."""
    versions = [v for v in _complete(spark, path) if before is None or v < before]
    return {t: spark.read.parquet(f"{path}/version={versions[-1]}/{t}") for t in TABLES} if versions else {}


def table_writer(path: str, blocks: DataFrame, capture: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Merges a batch of messages with the aircraft and sightings so far, as a new version of both tables.

    A batch starts from the version before its own number and overwrites its own, so that a retry counts nothing twice.
    The version before stays for readers, older ones go. A version holds one row per aircraft, and per aircraft and
    capture: what is rewritten grows with those, not with the messages. Values are carried between batches by the tables,
    hence inside one capture only. Positions are the fold's (``resolve_positions``), in a query of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        streams = S.change_streams(rows, blocks, capture)
        tables = S.apply_change_streams(streams, read_tables(spark, path, batch_id))
        for t in TABLES:
            tables[t].write.mode("overwrite").parquet(f"{path}/version={batch_id}/{t}")
        rows.unpersist()
        for v in [v for v in _complete(spark, path) if v < batch_id][:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def live_writer(path: str, blocks: DataFrame, capture: Column | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Writes batches of the live tracker's tagged rows (``tracker.track``) into the tables aircraft, sightings, positions and
    contact_ends of a bucketed store (``buckets.read``): upserts rewrite the buckets they touch, the others are appended.

    The tracker carries an aircraft's values between batches, so nothing is lost at their edges. A repeated batch changes
    nothing; batches are told apart by the query's own id too, so that a new checkpoint, whose batches count from 0 again, goes on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        streams = S.split_changes(rows, blocks, capture)
        changes = {
            "aircraft": (S.arrivals(streams), "icao", S.merged_aircraft),
            "sightings": (streams["sighting_updates"], "icao", lambda old, new: A.upsert_sightings(new, old)),
        }
        ends = rows.filter("kind = 'contact_end'").select("receiver", "icao", "contact", "timestamp", "message_count")
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        B.merge(spark, path, f"{query}:{batch_id}", changes, {"positions": streams["position_updates"], "contact_ends": ends}, buckets)
        rows.unpersist()

    return write
