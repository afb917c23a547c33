"""Change streams of the tracker, and the tables they are applied to.

A receiver's messages give four streams: new aircraft, aircraft updates, sighting updates and position updates.
Positions are appended; aircraft and sightings are merged with the table so far, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refdata import MILITARY_FIRST, MILITARY_LAST
from . import aggregates as A
from . import anomaly as G
from . import enrichment as N
from . import track as T


def _keyed(messages: DataFrame, silence: float | None) -> tuple[DataFrame, tuple[str, ...]]:
    """Messages and the key of what is remembered: forever, as over a capture file, or until a silence, as on the air."""
    return (messages, T.KEY) if silence is None else (T.contacts(messages, silence), (*T.KEY, "contact"))


def position_updates(
    messages: DataFrame, receiver: tuple[float, float] | None = None, min_interval: float = 2.0, places: DataFrame | None = None, silence: float | None = None
) -> DataFrame:
    """Stored positions with the state at that moment and the rules' anomaly score.

    Every resolved position is the next one's predecessor for the score, whether it is stored or not.
    """
    messages, key = _keyed(messages, silence)
    fixes = T.resolve_positions(messages, receiver, min_interval, places, key)
    state = T.running_state(messages, key).select(*key, "seq", "timestamp", "altitude_ft", "speed_kts", "heading_deg", "vertical_rate_fpm")
    rows = G.score_positions(fixes.join(state, [*key, "seq"]), "seq", key)
    return rows.filter("stored").withColumnRenamed("rule_score", "anomaly_score").drop("stored", "flags")


SIGHTING = ("icao", "capture_id", "seq", "callsign", "squawk", "altitude_ft", "timestamp")


def change_streams(
    messages: DataFrame, blocks: DataFrame, capture: Column | None = None, receiver: tuple[float, float] | None = None, min_interval: float = 2.0,
    places: DataFrame | None = None, silence: float | None = None,
) -> dict[str, DataFrame]:
    """new_aircraft, aircraft_updates, sighting_updates, position_updates; every row has the ``seq`` of its message.

    ``places`` says where each receiver stands; with ``silence`` an aircraft not heard of for so long is forgotten.
    """
    moved = position_updates(messages, receiver, min_interval, places, silence)
    messages, key = _keyed(messages, silence)
    sightings = T.running_state(messages, key).withColumn("capture_id", F.lit(None).cast("long") if capture is None else capture)
    return {
        "new_aircraft": N.lookup_country(T.new_aircraft(messages, key), blocks),
        "aircraft_updates": messages.select("icao", "seq", "timestamp"),
        "sighting_updates": sightings.select(*SIGHTING),
        "position_updates": moved,
    }


def split_changes(tagged: DataFrame, blocks: DataFrame, capture: Column | None = None) -> dict[str, DataFrame]:
    """The same four streams from the tagged rows of the live tracker (``streaming.tracker``), of one batch or of all."""
    rows = tagged.withColumn("capture_id", F.lit(None).cast("long") if capture is None else capture)
    of = lambda kind: rows.filter(F.col("kind") == kind)
    key = (*T.KEY, "contact")
    first = of("new_aircraft").select(*key, F.col("timestamp").alias("first_seen"), "seq")
    first = first.withColumns({"registration": N.n_number(F.col("icao")), "is_military": F.col("icao").between(MILITARY_FIRST, MILITARY_LAST)})
    state = ("timestamp", "altitude_ft", "speed_kts", "heading_deg", "vertical_rate_fpm")
    return {
        "new_aircraft": N.lookup_country(first, blocks),
        "aircraft_updates": of("message").select("icao", "seq", "timestamp"),
        "sighting_updates": of("message").select(*SIGHTING),
        "position_updates": of("position").select(*key, "seq", "lat", "lon", *state, "anomaly_score"),
    }


def arrivals(streams: dict[str, DataFrame]) -> DataFrame:
    """What the streams say of aircraft, as rows for ``aggregates.upsert_aircraft``."""
    updates = streams["aircraft_updates"].groupBy("icao").agg(F.min_by("timestamp", "seq").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("seq").alias("seq"))
    blank = {"registration": F.lit(None).cast("string"), "country": F.lit(None).cast("string"), "is_military": F.lit(False)}
    columns = ["icao", *blank, "first_seen", "last_seen", "seq"]
    return streams["new_aircraft"].withColumn("last_seen", F.col("first_seen")).select(columns).unionByName(updates.withColumns(blank).select(columns))


def merged_aircraft(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return A.upsert_aircraft(new.drop("seq").limit(0) if old is None else old, new)


def apply_change_streams(streams: dict[str, DataFrame], tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables aircraft, sightings and positions after the streams; those that are missing so far count as empty."""
    tables, moved = tables or {}, streams["position_updates"]
    return {
        "aircraft": merged_aircraft(tables.get("aircraft"), arrivals(streams)),
        "sightings": A.upsert_sightings(streams["sighting_updates"], tables.get("sightings")),
        "positions": tables["positions"].unionByName(moved) if "positions" in tables else moved,
    }


def merge_receivers(parts: list[DataFrame], authenticated: DataFrame) -> DataFrame:
    """Outputs of several receivers' trackers as one; a receiver_id known from authentication beats the tracker's own."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    known = authenticated.select("receiver", F.col("receiver_id").alias("__known"))
    return rows.join(known, "receiver", "left").withColumn("receiver_id", F.coalesce("__known", "receiver_id")).drop("__known")


def ingest_report(accepted: DataFrame, messages: DataFrame, streams: dict[str, DataFrame], batch: Column) -> DataFrame:
    """Per batch of frames: accepted frames, decoded messages, positions and new aircraft; ``batch`` is made from ``seq``."""
    parts = {"accepted": accepted, "decoded": messages, "positions": streams["position_updates"], "new_aircraft": streams["new_aircraft"]}
    rows = [df.groupBy(batch.alias("batch")).agg(F.count("*").alias("n")).withColumn("what", F.lit(k)) for k, df in parts.items()]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return every.groupBy("batch").agg(*(F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in parts))
