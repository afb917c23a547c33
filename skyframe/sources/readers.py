"""Readers of captured frames, ingest batches, heartbeats, AIS documents and reference files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.numbering import placed
from ..operators.positions import latest_per_key

BATCH = "receiver STRING, lat DOUBLE, lon DOUBLE, frames ARRAY<STRUCT<hex: STRING, timestamp: DOUBLE, signal_level: DOUBLE>>, timestamp DOUBLE"
HEARTBEAT = "receiver STRING, lat DOUBLE, lon DOUBLE, frames_captured BIGINT, frames_sent BIGINT, uptime_sec BIGINT, received_at DOUBLE"
AIRPORT = "icao STRING, name STRING, lat DOUBLE, lon DOUBLE, elevation_ft INT, type STRING"
MOST_FRAMES = 5000


def frame_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with ``hex`` (upper case) and ``timestamp`` where they are frames: HEX, *HEX; or HEX;time. Others go."""
    text = F.trim(column)
    plain = F.regexp_extract(text, r"^([0-9A-Fa-f]{28}|[0-9A-Fa-f]{14})(?:;([0-9]+(?:\.[0-9]+)?))?$", 1)
    star = F.regexp_extract(text, r"^\*([0-9A-Fa-f]{28}|[0-9A-Fa-f]{14});$", 1)
    time = F.regexp_extract(text, r"^[0-9A-Fa-f]+;([0-9]+(?:\.[0-9]+)?)$", 1)
    rows = lines.withColumns({"hex": F.upper(F.when(plain != "", plain).otherwise(star)), "timestamp": F.when(time != "", time.cast("double"))})
    return rows.filter("hex <> ''")


def read_frame_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, hex, timestamp) of capture files; seq is the line's place in its file, from 0, lines that are no frames counted.

    Files are read in blocks by many tasks. A block knows where it begins and its lines come in order, so lines are numbered by (file,
    beginning of the block, order), without gaps, by counts per range (``numbering.placed``); no task sees a whole file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = placed(lines, ["file"], [F.col("block"), F.col("at")], "seq", "lines")
    return frame_lines(rows).select("file", "seq", "hex", "timestamp")


def with_synthetic_time(frames: DataFrame, step: float = 0.001, key: str | None = None, start: float = 0.0) -> DataFrame:
    """Gives lines without a time the last given time plus so many steps. Times run on from line to line, so a ``key``'s lines
    are one task's; name the file or the receiver, or else the whole table is one."""
    by = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    w = by.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumns({"__n": F.row_number().over(by.orderBy("seq")), "__base": F.last("timestamp", ignorenulls=True).over(w)})
    at = F.last(F.when(F.col("timestamp").isNotNull(), F.col("__n")), ignorenulls=True).over(w)
    time = F.coalesce("__base", F.lit(start)) + (F.col("__n") - F.coalesce(at, F.lit(0))) * step
    return rows.withColumn("timestamp", time).drop("__n", "__base")


def explode_batches(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, rejected batches) of ingest documents; a frame's time is its own or the batch's plus a step for its place."""
    small = F.size("frames") <= MOST_FRAMES
    each = batches.filter(small).select("receiver", F.col("timestamp").alias("base"), F.posexplode("frames").alias("i", "f"))
    time = F.coalesce(F.col("f.timestamp"), F.col("base") + F.col("i") * 0.001)
    return each.select("receiver", F.col("i").cast("long").alias("i"), F.upper("f.hex").alias("hex"), time.alias("timestamp"), "f.signal_level"), batches.filter(~small)


def read_frame_batches(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(BATCH).json(path)


def read_heartbeats(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(HEARTBEAT).json(path)


def read_ais(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path)


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Airports with a place; elevation 0 if missing, sizes as major, medium or small."""
    rows = spark.read.csv(path, schema=AIRPORT, header=True, mode="DROPMALFORMED").filter("lat IS NOT NULL AND lon IS NOT NULL")
    kind = F.when(F.col("type") == "large_airport", "major").when(F.col("type") == "medium_airport", "medium").when(F.col("type") == "small_airport", "small")
    return rows.select(F.col("icao").alias("code"), "name", "lat", "lon", F.coalesce("elevation_ft", F.lit(0)).alias("elevation_ft"), kind.alias("kind"))


def aircraft_types(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Registry keyed by upper-case address; the last row of a key wins, blanks are null."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    clean = rows.select(F.upper(F.trim("icao")).alias("icao"), *(blank(c) for c in ("registration", "type_code", "type_name", "operator", "category")), order)
    return latest_per_key(clean, ["icao"], (order,)).drop(order)


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
