"""Tracks: what each aircraft's messages say so far, in arrival order.

Most of a state is the last value that isn't null, so it is a window. Only positions need a fold, because a report
may be resolved against the last resolved one: rows are dealt by key, sorted inside the partition, and folded as they
stream through a task, which holds the state of one key and never a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cpr
from ..functions.refdata import MILITARY_FIRST, MILITARY_LAST
from . import enrichment as N

KEY = ("receiver", "icao")
#: Seconds after which an aircraft that isn't heard of is forgotten, where contacts end.
SILENCE = 60.0


def _zones(lat: float) -> int:
    if abs(lat) >= 87:
        return 1
    a = 1 - math.cos(math.pi / (2 * cpr.ZONES))
    x = 1 - a / math.cos(math.radians(abs(lat))) ** 2
    return max(1, math.floor(2 * math.pi / math.acos(max(-1.0, x))))


def _wrap(lat: float, lon: float) -> tuple[float, float]:
    return round(lat - 360 if lat > 90 else lat, 6), round(lon - 360 if lon >= 180 else lon, 6)


@dataclass
class Fold:
    """State of one aircraft's position reports: the latest even and odd report, the last fix, the last stored time."""

    even_lat: float = math.nan
    even_lon: float = math.nan
    even_t: float = math.nan
    odd_lat: float = math.nan
    odd_lon: float = math.nan
    odd_t: float = math.nan
    lat: float = math.nan
    lon: float = math.nan
    stored_t: float = math.nan

    def _pair(self) -> tuple[float, float] | None:
        if not abs(self.even_t - self.odd_t) <= cpr.MAX_PAIR_AGE:
            return None
        ye, xe, yo, xo = (v / cpr.SCALE for v in (self.even_lat, self.even_lon, self.odd_lat, self.odd_lon))
        j = math.floor(59 * ye - 60 * yo + 0.5)
        lats = [360 / 60 * (j % 60 + ye), 360 / 59 * (j % 59 + yo)]
        lats = [v - 360 if v >= 270 else v for v in lats]
        if _zones(lats[0]) != _zones(lats[1]):
            return None
        odd = self.even_t < self.odd_t
        zones = _zones(lats[odd])
        count = max(zones - odd, 1)
        m = math.floor(xe * (zones - 1) - xo * zones + 0.5)
        return _wrap(lats[odd], 360 / count * (m % count + (xo if odd else xe)))

    def _near(self, ref: tuple[float, float]) -> tuple[float, float]:
        odd = not self.even_t > self.odd_t if not math.isnan(self.odd_t) else False
        y, x = ((self.odd_lat, self.odd_lon) if odd else (self.even_lat, self.even_lon))
        y, x, dlat = y / cpr.SCALE, x / cpr.SCALE, 360 / (60 - odd)
        lat = dlat * (math.floor(ref[0] / dlat) + math.floor(ref[0] % dlat / dlat - y + 0.5) + y)
        dlon = 360 / max(_zones(lat) - odd, 1)
        return _wrap(lat, dlon * (math.floor(ref[1] / dlon) + math.floor(ref[1] % dlon / dlon - x + 0.5) + x))

    def report(self, odd: bool, y: float, x: float, t: float, receiver: tuple[float, float] | None, min_interval: float) -> tuple[float, float, bool] | None:
        """Takes one report; (lat, lon, whether it is stored) if it can be resolved."""
        if odd:
            self.odd_lat, self.odd_lon, self.odd_t = y, x, t
        else:
            self.even_lat, self.even_lon, self.even_t = y, x, t
        fix = self._pair()
        if fix is None:
            ref = receiver or (None if math.isnan(self.lat) else (self.lat, self.lon))
            fix = self._near(ref) if ref else None
        if fix is None:
            return None
        self.lat, self.lon = fix
        stored = math.isnan(self.stored_t) or t - self.stored_t >= min_interval
        if stored:
            self.stored_t = t
        return (*fix, stored)

    def state(self) -> tuple[float, ...]:
        return astuple(self)


def fold_rows(fold: Fold, rows: pd.DataFrame, min_interval: float) -> list[tuple]:
    """(seq, lat, lon, stored) of the reports of one key that resolve, in order of arrival."""
    out = []
    for seq, odd, y, x, t, *ref in zip(rows["seq"], rows["cpr_odd"], rows["cpr_lat"], rows["cpr_lon"], rows["timestamp"], rows["ref_lat"], rows["ref_lon"]):
        place = None if pd.isna(ref[0]) or pd.isna(ref[1]) else (float(ref[0]), float(ref[1]))
        if (fix := fold.report(bool(odd), float(y), float(x), float(t), place, min_interval)) is not None:
            out.append((seq, *fix))
    return out


def contacts(messages: DataFrame, silence: float = SILENCE) -> DataFrame:
    """Adds ``contact``, the ``seq`` of its first message: an aircraft that a receiver hears again after a longer silence begins a new one."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    first = F.coalesce(F.col("timestamp") - F.lag("timestamp").over(w) > silence, F.lit(True))
    rows = messages.withColumn("__first", F.when(first, F.col("seq")))
    return rows.withColumn("contact", F.last("__first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__first")


def with_places(messages: DataFrame, receiver: tuple[float, float] | None = None, places: DataFrame | None = None) -> DataFrame:
    """Adds ``ref_lat`` and ``ref_lon``: where the receiver stands by ``places`` (receiver, lat, lon), else one place for all, else null."""
    one = [F.lit(x).cast("double") for x in receiver or (None, None)]
    if places is None:
        return messages.withColumns({"ref_lat": one[0], "ref_lon": one[1]})
    # a row a receiver: Spark broadcasts it as long as it is small
    known = places.filter("lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["receiver"]).select("receiver", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    rows = messages.join(known, "receiver", "left")
    return rows.withColumns({"ref_lat": F.coalesce("ref_lat", one[0]), "ref_lon": F.coalesce("ref_lon", one[1])})


def resolve_positions(
    messages: DataFrame, receiver: tuple[float, float] | None = None, min_interval: float = 2.0, places: DataFrame | None = None, key: Sequence[str] = KEY
) -> DataFrame:
    """(key, seq, lat, lon, stored) of the position messages that resolve, exactly as they arrive.

    With ``contact`` (see ``contacts``) in the key, nothing of an aircraft outlasts a silence.
    """
    rows = messages.filter("msg_type = 'position'").select(*key, "seq", "timestamp", "cpr_odd", "cpr_lat", "cpr_lon")
    dealt = with_places(rows, receiver, places).repartition(*KEY).sortWithinPartitions(*key, "seq")
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, fold = None, Fold()
        for b in batches:
            parts = []
            for own, group in b.groupby(list(key), sort=False, dropna=False):
                if own != held:
                    held, fold = own, Fold()
                parts += [(*own, *r) for r in fold_rows(fold, group, min_interval)]
            yield pd.DataFrame(parts, columns=[*key, "seq", "lat", "lon", "stored"])

    return dealt.mapInPandas(run, f"{fields}, seq long, lat double, lon double, stored boolean")


def pair_reports(messages: DataFrame, receiver: tuple[float, float] | None = None, places: DataFrame | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Position messages with ``position``: from the latest even and odd report, else near the receiver, else near the
    aircraft's own last fix. The last makes it recursive, so that it is the fold of ``resolve_positions``."""
    rows = messages.filter("msg_type = 'position'")
    fixes = resolve_positions(messages, receiver, places=places, key=key).select(*key, "seq", F.struct("lat", "lon").alias("position"))
    return rows.join(fixes, [*key, "seq"], "left")


def running_state(messages: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every message with the state after it: last known callsign, squawk, altitude, speed, heading, vertical rate,
    whether the aircraft was ever seen as military, and how many messages came."""
    w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    named = F.when(F.trim("callsign") != "", F.trim("callsign"))
    military = N.is_military(F.col("icao"), F.col("callsign"))
    return messages.select(
        *key, "seq", "timestamp", "msg_type", last(named).alias("callsign"), last(F.col("squawk")).alias("squawk"), last(F.col("altitude_ft")).alias("altitude_ft"),
        last(F.col("velocity.speed_kts")).alias("speed_kts"), last(F.col("velocity.heading_deg")).alias("heading_deg"),
        last(F.col("velocity.vertical_rate_fpm")).alias("vertical_rate_fpm"), F.max(military).over(w).alias("is_military"), F.count("*").over(w).alias("message_count"),
    )


def latest_state(messages: DataFrame) -> DataFrame:
    """The state after the last message of each key, by partial aggregates instead of windows."""
    newest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    named = F.when(F.trim("callsign") != "", F.trim("callsign"))
    return messages.groupBy(*KEY).agg(
        newest(named).alias("callsign"), newest(F.col("squawk")).alias("squawk"), newest(F.col("altitude_ft")).alias("altitude_ft"),
        newest(F.col("velocity.speed_kts")).alias("speed_kts"), newest(F.col("velocity.heading_deg")).alias("heading_deg"),
        newest(F.col("velocity.vertical_rate_fpm")).alias("vertical_rate_fpm"), F.bool_or(N.is_military(F.col("icao"), F.col("callsign"))).alias("is_military"),
        F.count("*").alias("message_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )


def new_aircraft(messages: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """First message of each key, with registration and the block's military flag; with ``contact`` in the key an aircraft
    that comes back is new again."""
    first = messages.groupBy(*key).agg(F.min_by("timestamp", "seq").alias("first_seen"), F.min("seq").alias("seq"))
    flag = F.col("icao").between(MILITARY_FIRST, MILITARY_LAST)
    return first.withColumns({"registration": N.n_number(F.col("icao")), "is_military": flag})


def latest_comm_b(messages: DataFrame) -> DataFrame:
    """Last payload of each register, each on its own."""
    rows = messages.filter("comm_b IS NOT NULL")
    slot = lambda k: F.max_by(F.col(f"comm_b.{k}"), F.when(F.col(f"comm_b.{k}").isNotNull(), F.col("seq"))).alias(k)
    return rows.groupBy(*KEY).agg(slot("bds40"), slot("bds50"), slot("bds60"), F.max("timestamp").alias("last_comm_b_seen"))


def downsample_on_write(positions: DataFrame, min_interval: float, key: str = "icao", order: str = "id") -> DataFrame:
    """The rows a writer keeps: the first, and each at least ``min_interval`` after the last kept one.

    Greedy choice depends on the choice before, so rows are folded as they stream, sorted inside their partition.
    """
    dealt = positions.repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = None, math.nan
        for b in batches:
            keep = []
            for k, t in zip(b[key], b["timestamp"]):
                if k != held:
                    held, last = k, math.nan
                keep.append(not t - last < min_interval)
                if keep[-1]:
                    last = t
            yield b[keep]

    return dealt.mapInPandas(run, positions.schema)


def histories(positions: DataFrame, n: int = 120) -> DataFrame:
    """Adds ``history``, the last n entries of the aircraft up to each row."""
    w = Window.partitionBy("icao").orderBy("id").rowsBetween(1 - n, 0)
    return positions.withColumn("history", F.collect_list(F.struct("timestamp", "lat", "lon", "altitude_ft", "heading_deg")).over(w))


def active(states: DataFrame, now: float, silence: float = 60.0) -> DataFrame:
    """States heard from within the silence, newest first; the others are stale."""
    return states.filter(F.lit(now) - F.col("last_seen") <= silence).orderBy(F.col("last_seen").desc(), "icao")


def stale_keys(states: DataFrame, now: float, silence: float = 60.0) -> DataFrame:
    return states.filter(F.lit(now) - F.col("last_seen") > silence).select("icao")


def counters(frames: DataFrame, messages: DataFrame, resolved: DataFrame) -> DataFrame:
    """(receiver, total, valid, positions, skipped)."""
    total = frames.groupBy("receiver").agg(F.count("*").alias("total"))
    valid = messages.groupBy("receiver").agg(F.count("*").alias("valid"))
    fixes = resolved.groupBy("receiver").agg(F.count("*").alias("positions"), F.count_if(~F.col("stored")).alias("skipped"))
    return total.join(valid, "receiver", "left").join(fixes, "receiver", "left").na.fill(0)


def decode_summary(messages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Per aircraft of one capture the last values, place and number of messages, most first; with ``blocks`` its country too.

    Unlike in a track, a velocity message overwrites with its nulls, and so does an altitude reply; places come from pairs of reports alone.
    """
    newest = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    kind, known = F.col("msg_type"), lambda c: F.col(c).isNotNull()
    v = kind == "velocity"
    w = Window.partitionBy("icao").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    report = F.struct("cpr_lat", "cpr_lon", "timestamp")
    last = {n: F.last(F.when((kind == "position") & (F.col("cpr_odd") == F.lit(odd)), report), ignorenulls=True).over(w) for n, odd in (("even", False), ("odd", True))}
    rows = messages.select("icao", "seq", "msg_type", "callsign", "squawk", "altitude_ft", "velocity", F.struct(*(c.alias(n) for n, c in last.items())).alias("pair"))
    # as a lambda the formula stays outside the generated code, which it would make too large
    at = lambda p: cpr.decode_global(p["even"]["cpr_lat"], p["even"]["cpr_lon"], p["odd"]["cpr_lat"], p["odd"]["cpr_lon"], p["even"]["timestamp"], p["odd"]["timestamp"])
    both = (kind == "position") & known("pair.even") & known("pair.odd")
    rows = rows.withColumn("at", F.get(F.transform(F.when(both, F.array("pair")), at), F.lit(0)))
    rows = rows.groupBy("icao").agg(
        newest(F.trim("callsign"), known("callsign")).alias("callsign"), newest(F.col("squawk"), known("squawk")).alias("squawk"),
        newest(F.col("altitude_ft"), (kind == "altitude") | known("altitude_ft")).alias("altitude_ft"), newest(F.col("velocity.speed_kts"), v).alias("speed_kts"),
        newest(F.col("velocity.heading_deg"), v).alias("heading_deg"), newest(F.col("velocity.vertical_rate_fpm"), v).alias("vertical_rate_fpm"), F.count("*").alias("messages"),
        newest(F.col("at"), known("at")).alias("at"),
    )
    rows = rows.select("*", "at.lat", "at.lon").drop("at")
    rows = rows if blocks is None else N.lookup_country(rows, blocks)
    return rows.orderBy(F.col("messages").desc(), "icao")


def decode_totals(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """(frames, decoded, aircraft): one row about a capture: parsed frames, those with a message, and how many aircraft sent them."""
    told = messages.agg(F.count("*").alias("decoded"), F.count_distinct("icao").alias("aircraft"))
    return frames.agg(F.count("*").alias("frames")).crossJoin(told)  # one row each
