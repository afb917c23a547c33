"""Detectors on a stream of states: what a row tells by itself is decoded by column expressions and joins with the
reference tables; a stateful operator per aircraft adds the rules on its track and tells each event once a contact.

State per aircraft: the last ``HISTORY`` points as a list, the events told so far as a map from kind and fence, and when it
was last heard. All of it goes when the contact ends, by an event-time timer or by a row that comes after the silence,
but the points: the frames of the rules reach over a silence, as in the batch form, so they go with a later timer.
Close pairs (``operators.detectors.proximity``) need all aircraft of a tick together and have no streaming form here.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import detectors as D
from ..operators import enrichment as N
from ..operators.aggregates import event_time
from .tracker import _after, _value, _whole

EVENTS = "icao string, event_type string, description string, lat double, lon double, altitude_ft int, timestamp double, id long, fence string"
#: Seconds that the rules on a track look back.
TURNING, HOLDING = 300.0, 120.0


def circling(points: list[tuple], now: float, label: str) -> str | None:
    """The description if the headings of the last ``TURNING`` seconds turn by a full circle, in millionths of a degree."""
    heads = [h for t, h, _ in points if t >= now - TURNING and h is not None]
    if len(heads) < 4:
        return None
    turned = sum(round(min(abs(b - a) % 360, 360 - abs(b - a) % 360) * 1_000_000) for a, b in pairwise(heads)) / 1_000_000
    return f"Circling detected: {label} - {turned:.0f} deg heading change" if turned >= 360 else None


def holding(points: list[tuple], count: int, now: float, label: str) -> str | None:
    recent = [p for p in points if p[0] >= now - HOLDING]
    alts, heads = [p[2] for p in recent if p[2] is not None], [p[1] for p in recent if p[1] is not None]
    if count < 8 or len(alts) < 4 or max(alts) - min(alts) > 500 or len(heads) < 8:
        return None
    top = sorted((-n, b) for b, n in Counter(int(h // 10) % 36 for h in heads).items())[:2]
    if len(top) < 2 or top[1][0] > -2:
        return None
    apart = abs(top[0][1] - top[1][1])
    if abs(min(apart, 36 - apart) - 18) > 3:
        return None
    return f"Holding pattern: {label} - stable at {int(sum(alts) / len(alts))} ft, reciprocal headings"


class Detector(StatefulProcessor):
    """Tells the events of one aircraft."""

    def __init__(self, silence: float):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "t double, heading double, altitude int")
        self.told = handle.getMapState("told", "event_type string, fence string", "id long")
        self.heard = handle.getValueState("heard", "t double, points long")

    def _end_contact(self) -> None:
        for key in list(self.told.keys()):
            self.told.removeKey(key)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        points = [(t, _value(h), _whole(a)) for t, h, a in self.points.get()] if self.points.exists() else []
        last, count = self.heard.get() if self.heard.exists() else (None, 0)
        told = {tuple(k) for k in self.told.keys()} if self.told.exists() else set()
        before, out = set(told), []
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            if last is not None and r.timestamp - last > self.silence:
                told, before = set(), set()
                self._end_contact()
            last, count = float(r.timestamp), count + 1
            points = [*points, (last, _value(r.heading_deg), _whole(r.altitude_ft))][-D.HISTORY :]
            label = _value(r.callsign) or key[0]
            found = [(e["event_type"], e["description"], e.get("fence")) for e in json.loads(r.facts)]
            found += [(k, text, None) for k, text in (("circling", circling(points, last, label)), ("holding_pattern", holding(points, count, last, label))) if text]
            for kind, text, fence in found:
                if (kind, fence or "") not in told:
                    told.add((kind, fence or ""))
                    out.append((key[0], kind, text, _value(r.lat), _value(r.lon), _whole(r.altitude_ft), last, r.id, fence))
        for kind in told - before:
            self.told.updateValue(kind, (0,))
        self.points.put(points)
        self.heard.update((last, count))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_after(last + self.silence))
        self.handle.registerTimer(_after(last + max(TURNING, HOLDING, self.silence)))
        if out:
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in EVENTS.split(", ")]).astype({"altitude_ft": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        self._end_contact()
        if self.heard.exists() and now > self.heard.get()[0] + max(TURNING, HOLDING, self.silence):
            self.points.clear()
            self.heard.clear()
        return iter(())


def detect(states: DataFrame, fences: DataFrame, airports: DataFrame, silence: float = D.SILENCE, late: str = "10 seconds") -> DataFrame:
    """A stream of states to ``EVENTS``: each kind (and fence) once in a contact. Needs the state store of ``tracker.STATE_STORE``."""
    rows = N.with_fences(N.with_airport(states, airports, 15.0), fences)
    rows = rows.select("id", "icao", "lat", "lon", "altitude_ft", "heading_deg", "timestamp", "callsign", F.to_json(D.facts()).alias("facts"))
    rows = rows.withColumn("ts", event_time()).withWatermark("ts", late)
    return rows.groupBy("icao").transformWithStateInPandas(Detector(silence), EVENTS, "append", "eventTime")
