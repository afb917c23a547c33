"""The live tracker: one stateful operator from frames to the tracker's change streams, and the address check alone.

State is kept per receiver and aircraft in several variables: when the address was last heard in clear, the position
fold (latest even and odd report, last fix, last stored time), the last position for the anomaly rules, the last known values, and
counters. An event-time timer ends a contact once nothing was heard for ``silence`` seconds: then all variables go, and an
aircraft that comes back is new. A message that comes after such a silence but before the timer has fired ends the contact
just so. Rows of a key are taken in the order of ``seq`` inside a micro-batch; batches are taken as they come.

The batch form of the same rules is windows and one fold over contacts (``operators.track``, ``operators.streams``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import modes
from ..operators import enrichment as N
from ..operators.aggregates import event_time
from ..operators.track import KEY, SILENCE, Fold, with_places

TTL = 60.0
#: Provider of the state store that several state variables need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_FOLD = ", ".join(f"{n} double" for n in Fold.__dataclass_fields__)
#: What is remembered of the messages: last known values.
_VALUES = ("callsign", "squawk", "altitude_ft", "speed_kts", "heading_deg", "vertical_rate_fpm", "is_military")
_STATE = "callsign string, squawk string, altitude_ft int, speed_kts double, heading_deg double, vertical_rate_fpm int, is_military boolean, first_seen double, last_seen double"
TAGGED = (
    "kind string, receiver string, icao string, contact long, seq long, timestamp double, callsign string, squawk string, altitude_ft int, speed_kts double, "
    "heading_deg double, vertical_rate_fpm int, is_military boolean, lat double, lon double, anomaly_score double, message_count long"
)


def _value(x: Any) -> Any:
    return None if x is None or x is pd.NA or x != x else x


def _whole(x: Any) -> int | None:
    return None if _value(x) is None else int(x)


def _after(t: float) -> int:
    """The first millisecond after a time."""
    return math.floor(t * 1000) + 1


def _miles(a: tuple[float, float], b: tuple[float, float]) -> float:
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 3440.065 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def rule_score(now: tuple[float, float, float, int | None], before: tuple | None, speed: float | None, rate: int | None) -> float:
    """The anomaly rules of ``operators.anomaly`` for one position (time, lat, lon, altitude) and the one before."""
    score = (1.0 if speed is not None and speed > 750 else 0.0) + (1.0 if rate is not None and abs(rate) > 12000 else 0.0)
    if before is None:
        return score
    dt = now[0] - before[0]
    if dt <= 0:
        return score + 0.5
    miles = _miles(before[1:3], now[1:3])
    score += 2.0 if miles / (dt / 3600) > 1500 else 0.0
    if now[3] is not None and before[3] is not None and abs((now[3] - before[3]) / dt * 60) > 20000:
        score += 1.0
    return score + (0.5 if miles < 0.001 and dt > 30 and (speed or 0.0) > 100 else 0.0)


class Contact:
    """What a receiver knows of an aircraft; ``take`` gives the tagged rows of one frame."""

    def __init__(self, address: float | None = None, fold: Fold | None = None, before: tuple | None = None, state: dict | None = None, count: int = 0, contact: int = -1):
        self.address, self.fold, self.before, self.state, self.count, self.contact = address, fold or Fold(), before, state, count, contact

    def known(self, explicit: bool, t: float, ttl: float) -> bool:
        """Whether a frame's address is to be believed: it stands in clear, or did within the last ``ttl`` seconds."""
        if explicit:
            self.address = t
        return explicit or self.address is not None and t - self.address <= ttl

    def tagged(self, kind: str, seq: int, t: float, lat: float | None = None, lon: float | None = None, score: float | None = None) -> tuple:
        s = self.state
        return (kind, self.contact, seq, t, *(s[k] for k in _VALUES), lat, lon, score, self.count)

    def take(self, r: Any, ttl: float, silence: float, min_interval: float) -> list[tuple]:
        t = float(r.timestamp)
        if not self.known(bool(r.explicit), t, ttl) or _value(r.msg_type) is None:
            return []
        out = []
        if self.state is not None and t - self.state["last_seen"] > silence:
            out.append(self.ended())
            self.__dict__ |= Contact(self.address).__dict__
        if self.state is None:
            self.contact = int(r.seq)
            self.state = dict.fromkeys(_VALUES) | {"is_military": False, "first_seen": t, "last_seen": t}
            out.append(self.tagged("new_aircraft", r.seq, t))
        s, told = self.state, (r.callsign, r.squawk, _whole(r.altitude_ft), r.speed_kts, r.heading_deg, _whole(r.vertical_rate_fpm))
        s.update({k: _value(v) for k, v in zip(_VALUES, told) if _value(v) is not None})
        s["is_military"] |= bool(r.military)
        s["last_seen"] = t
        self.count += 1
        if r.msg_type == "position":
            place = None if _value(r.ref_lat) is None or _value(r.ref_lon) is None else (r.ref_lat, r.ref_lon)
            fix = self.fold.report(bool(r.cpr_odd), float(r.cpr_lat), float(r.cpr_lon), t, place, min_interval)
            if fix is not None:
                here = (t, fix[0], fix[1], s["altitude_ft"])
                if fix[2]:
                    out.append(self.tagged("position", r.seq, t, fix[0], fix[1], rule_score(here, self.before, s["speed_kts"], s["vertical_rate_fpm"])))
                self.before = here
        out.append(self.tagged("message", r.seq, t))
        return out

    def ended(self) -> tuple:
        return self.tagged("contact_end", -1, self.state["last_seen"])


class Tracker(StatefulProcessor):
    """The stateful form of ``Contact``."""

    def __init__(self, ttl: float, silence: float, min_interval: float):
        self.ttl, self.silence, self.min_interval = ttl, silence, min_interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.address = handle.getValueState("address", "seen double")
        self.fold = handle.getValueState("fold", _FOLD)
        self.before = handle.getValueState("before", "t double, lat double, lon double, altitude_ft int")
        self.state = handle.getValueState("state", _STATE)
        self.counters = handle.getValueState("counters", "messages long, contact long")

    def _load(self) -> Contact:
        get = lambda v: v.get() if v.exists() else None
        address, fold, before, state, counters = map(get, (self.address, self.fold, self.before, self.state, self.counters))
        kept = None if state is None else {k: _value(v) for k, v in zip((*_VALUES, "first_seen", "last_seen"), state)}
        number = lambda x: math.nan if x is None else x
        parts = Fold(*map(number, fold)) if fold else None, tuple(map(_value, before)) if before else None, kept
        return Contact(address[0] if address else None, *parts, *(map(int, counters) if counters else ()))

    def _save(self, c: Contact) -> None:
        """Writes what is known and clears what isn't; a timer for each of the two that can run out."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if c.address is None:
            self.address.clear()
        else:
            self.address.update((float(c.address),))
            self.handle.registerTimer(_after(c.address + self.ttl))
        if c.state is None:
            for v in (self.fold, self.before, self.state, self.counters):
                v.clear()
            return
        self.handle.registerTimer(_after(c.state["last_seen"] + self.silence))
        self.fold.update(tuple(map(float, c.fold.state())))
        self.before.update(c.before) if c.before else self.before.clear()
        s, real = c.state, lambda x: None if x is None else float(x)
        self.state.update((s["callsign"], s["squawk"], s["altitude_ft"], real(s["speed_kts"]), real(s["heading_deg"]), s["vertical_rate_fpm"], bool(s["is_military"]), float(s["first_seen"]), float(s["last_seen"])))
        self.counters.update((c.count, c.contact))

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split(" ")[0] for f in TAGGED.split(", ")]
        df = pd.DataFrame([(r[0], *key, *r[1:]) for r in rows], columns=names)
        return df.astype({"altitude_ft": "Int32", "vertical_rate_fpm": "Int32", "is_military": "boolean"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        c, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            out += c.take(r, self.ttl, self.silence, self.min_interval)
        if c.address is not None or c.state is not None:  # addresses that nobody vouches for leave nothing
            self._save(c)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        c, now = self._load(), expiredTimerInfo.getExpiryTimeInMs() / 1000
        out = []
        if c.address is not None and now > c.address + self.ttl:
            c.address = None
        if c.state is not None and now > c.state["last_seen"] + self.silence:
            out.append(c.ended())
            c = Contact(c.address)
        self._save(c)
        if out:
            yield self._rows(key, out)


def frame_facts(frames: DataFrame, receiver: tuple[float, float] | None = None, places: DataFrame | None = None) -> DataFrame:
    """What the tracker reads of each frame that is valid by itself: one row a frame, decoded by column expressions."""
    rows = modes.decode_messages(modes.parse_frames(frames, validate_icao=False), every=True)
    facts = rows.select(
        *KEY, "seq", "timestamp", F.col("df").isin(*modes.EXPLICIT).alias("explicit"), "msg_type", F.when(F.trim("callsign") != "", F.trim("callsign")).alias("callsign"), "squawk", "altitude_ft",
        "velocity.speed_kts", "velocity.heading_deg", "velocity.vertical_rate_fpm", "cpr_odd", "cpr_lat", "cpr_lon", F.coalesce(N.is_military(F.col("icao"), F.col("callsign")), F.lit(False)).alias("military"),
    )
    return with_places(facts, receiver, places)


def track(
    frames: DataFrame, receiver: tuple[float, float] | None = None, places: DataFrame | None = None, ttl: float = TTL, silence: float = SILENCE, min_interval: float = 2.0, late: str = "10 seconds"
) -> DataFrame:
    """A stream of frames (receiver, seq, hex, timestamp) to tagged rows (``TAGGED``): new_aircraft, message, position, contact_end.

    Frames later than ``late`` behind the newest are dropped. Needs the state store of ``STATE_STORE``.
    """
    rows = frame_facts(frames, receiver, places).withColumn("ts", event_time()).withWatermark("ts", late)
    return rows.groupBy(*KEY).transformWithStateInPandas(Tracker(ttl, silence, min_interval), TAGGED, "append", "eventTime")


class AddressCheck(StatefulProcessor):
    """Lets frames through whose address stands in clear, or did at the same receiver within the last ``ttl`` seconds."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.address = handle, handle.getValueState("address", "seen double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        c = Contact(self.address.get()[0] if self.address.exists() else None)
        frames = pd.concat(list(rows)).sort_values("seq")
        passed = [c.known(bool(e), float(t), self.ttl) for e, t in zip(frames.pop("explicit"), frames["timestamp"])]
        if c.address is not None:
            self.address.update((c.address,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(_after(c.address + self.ttl))
        yield frames[passed].drop(columns="ts")

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.address.clear()
        return iter(())


def check_addresses(parsed: DataFrame, ttl: float = TTL, late: str = "10 seconds") -> DataFrame:
    """The streaming form of the check in ``modes.parse_frames``: parsed frames (made without it) whose address is known.

    An address is forgotten by an event-time timer ``ttl`` seconds after it was last in clear, so that state is bounded by
    the aircraft on the air; frames that only claim an address leave no state.
    """
    rows = parsed.withColumn("explicit", F.col("df").isin(*modes.EXPLICIT) & F.col("crc_ok")).withColumn("ts", event_time()).withWatermark("ts", late)
    return rows.groupBy(*KEY).transformWithStateInPandas(AddressCheck(ttl), parsed.schema, "append", "eventTime")
