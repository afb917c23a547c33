"""Events: rules on single states, on windows of a track, and on pairs of aircraft."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells
from ..functions.geo import haversine_expr
from ..functions.refdata import EMERGENCIES
from . import enrichment as N

EVENT = ("icao", "event_type", "description", "lat", "lon", "altitude_ft", "timestamp", "id")
SILENCE = 60.0
HISTORY = 120
#: Points of one microsecond that are still told apart.
TIES = 1024


def label() -> Column:
    return F.coalesce("callsign", "icao")


def _events(rows: DataFrame, kind: str, description: Column) -> DataFrame:
    return rows.select("icao", F.lit(kind).alias("event_type"), description.alias("description"), "lat", "lon", "altitude_ft", "timestamp", "id")


def contact_sessions(positions: DataFrame, gap: float = SILENCE) -> DataFrame:
    """Adds ``session``: an aircraft that returns after a silence longer than the gap begins a new one."""
    w = Window.partitionBy("icao").orderBy("id")
    new = F.when(F.col("timestamp") - F.lag("timestamp").over(w) > gap, 1).otherwise(0)
    rows = positions.withColumn("__new", new)
    return rows.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _military() -> tuple[Column, Column]:
    return N.is_military(F.col("icao"), F.col("callsign")), F.concat(F.lit("Military aircraft detected: "), label())


def _emergency() -> tuple[Column, Column]:
    meaning = F.create_map(*(F.lit(x) for kv in EMERGENCIES.items() for x in kv))
    return F.col("squawk").isin(*EMERGENCIES), F.concat(F.lit("Squawk "), "squawk", F.lit(": "), F.try_element_at(meaning, F.col("squawk")), F.lit(" - "), label())


def _rapid_descent(below: int) -> tuple[Column, Column]:
    altitude = F.coalesce(F.col("altitude_ft").cast("string"), F.lit("?"))
    text = F.concat(F.lit("Rapid descent "), F.col("vertical_rate_fpm").cast("string"), F.lit(" ft/min - "), label(), F.lit(" at "), altitude, F.lit(" ft"))
    return F.col("vertical_rate_fpm") < below, text


def _low_altitude(below: int) -> tuple[Column, Column]:
    text = F.concat(F.lit("Low altitude "), F.col("altitude_ft").cast("string"), F.lit(" ft - "), label())
    return (F.col("altitude_ft") > 0) & (F.col("altitude_ft") < below), text


def military(states: DataFrame) -> DataFrame:
    return _of(states, "military_detected", _military())


def emergency(states: DataFrame) -> DataFrame:
    return _of(states, "emergency_squawk", _emergency())


def rapid_descent(states: DataFrame, below: int = -5000) -> DataFrame:
    return _of(states, "rapid_descent", _rapid_descent(below))


def low_altitude(states: DataFrame, below: int = 500) -> DataFrame:
    return _of(states, "low_altitude", _low_altitude(below))


def with_frames(states: DataFrame, turning: float = 300.0, holding_for: float = 120.0) -> DataFrame:
    """Adds ``session`` and ``__f``, sums over the last points of the aircraft up to each row: over those of the last
    ``turning`` and ``holding_for`` seconds, but over the newest ``HISTORY`` at most.

    Two windows over one shuffle, no lists: turns are running sums, of which a frame's is the difference to its first
    heading; directions are counted in 36 bins of seven bits, nine to a number. A frame in time holds at most as many points as
    fit the bins, or the frame of the newest points is taken instead. Times of an aircraft are taken to rise with ``id``; points
    of one microsecond follow one another within it. Turns are exact to a millionth of a degree.
    """
    w = "PARTITION BY icao ORDER BY id"
    sofar = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = states.selectExpr(
        "*", f"lag(timestamp) OVER ({w}) AS __lag", f"last(heading_deg, true) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS __before", f"row_number() OVER ({w}) AS __k",
        f"count(heading_deg) OVER {sofar} AS __heads", "CAST(floor(heading_deg / 10) % 36 AS INT) AS __bin",
    ).selectExpr(
        "*", "if(__lag IS NOT NULL AND timestamp - __lag > {0}D, 1L, 0L) AS __new".format(SILENCE),
        "coalesce(CAST(round(least(abs(heading_deg - __before) % 360, 360 - abs(heading_deg - __before) % 360) * 1000000) AS BIGINT), 0L) AS __turn",
    ).selectExpr(
        "*", f"sum(__new) OVER {sofar} AS session", f"sum(__turn) OVER {sofar} AS __all", f"last(if(__lag IS NULL OR timestamp <> __lag, __k, NULL), true) OVER {sofar} AS __tie",
    ).selectExpr("*", f"CAST(timestamp * 1000000 AS BIGINT) * {TIES} + least({TIES - 1}, __k - __tie) AS __at")

    parts = {"turned": "min(if(heading_deg IS NULL, NULL, __all))", "heads": "min(if(heading_deg IS NULL, NULL, __heads))", "first": "min(__k)"}
    parts |= {"alts": "count(altitude_ft)", "top": "max(altitude_ft)", "low": "min(altitude_ft)", "sum": "sum(altitude_ft)"}
    parts |= {f"bins{j}": f"try_sum(if(__bin div 9 = {j}, shiftleft(1L, __bin % 9 * 7), NULL))" for j in range(4)}
    # columns of their own, so that those that nobody asks for aren't computed
    over = lambda to, frame: [f"{e} OVER {frame} AS __{to}_{n}" for n, e in parts.items()]
    back = lambda seconds: f"(PARTITION BY icao ORDER BY __at RANGE BETWEEN {round(seconds * 1_000_000) * TIES + TIES - 1} PRECEDING AND CURRENT ROW)"
    rows = rows.selectExpr("*", *over("n", f"({w} ROWS BETWEEN {HISTORY - 1} PRECEDING AND CURRENT ROW)")).selectExpr("*", *over("t", back(turning)), *over("h", back(holding_for)))
    later = lambda to: "named_struct(" + ", ".join(f"'{n}', if(__k - __{to}_first < {HISTORY}, __{to}_{n}, __n_{n})" for n in parts) + ")"
    own = f"named_struct('all', __all, 'heads', __heads, 'k', __k, 't', {later('t')}, 'h', {later('h')}) AS __f"
    return rows.selectExpr(*(f"`{c}`" for c in states.columns), "session", own)


def _turned() -> Column:
    """Sum of the heading changes in the frame, each the short way round; null below four headings."""
    f = F.col("__f")
    return F.when(f["heads"] - f["t"]["heads"] + 1 >= 4, (f["all"] - f["t"]["turned"]) / 1_000_000)


def _circling(least: float) -> tuple[Column, Column]:
    text = F.concat(F.lit("Circling detected: "), label(), F.format_string(" - %.0f deg heading change", F.bround(_turned())))
    return _turned() >= least, text


def _holding() -> tuple[Column, Column]:
    """A steady height and two opposite headings, from the last two minutes."""
    steady = "__f.k >= 8 AND __f.h.alts >= 4 AND __f.h.top - __f.h.low <= 500 AND __f.heads - __f.h.heads + 1 >= 8"
    count = "CAST(shiftright(coalesce(array(__f.h.bins0, __f.h.bins1, __f.h.bins2, __f.h.bins3)[b div 9], 0L), b % 9 * 7) & 127 AS INT)"
    bins = f"slice(array_sort(transform(sequence(0, 35), b -> named_struct('n', -{count}, 'b', b))), 1, 2)"
    apart = "abs(x[0].b - x[1].b)"
    opposite = f"exists(array({bins}), x -> x[1].n <= -2 AND abs(if({apart} > 18, 36 - {apart}, {apart}) - 18) <= 3)"
    text = F.concat(F.lit("Holding pattern: "), label(), F.expr("concat(' - stable at ', CAST(__f.h.sum div __f.h.alts AS STRING), ' ft, reciprocal headings')"))
    return F.expr(f"if({steady}, {opposite}, false)"), text


def _unusual_altitude() -> tuple[Column, Column]:
    text = F.concat(F.lit("Unusual altitude: "), label(), F.lit(" at "), F.col("altitude_ft").cast("string"), F.format_string(" ft, %.0f kts, far from airports", F.col("speed_kts")))
    return (F.col("speed_kts") > 200) & (F.col("altitude_ft") > 0) & (F.col("altitude_ft") < 3000) & F.col("airport").isNull(), text


def _of(rows: DataFrame, kind: str, rule: tuple[Column, Column]) -> DataFrame:
    return _events(rows.filter(rule[0]), kind, rule[1])


def circling(framed: DataFrame, least: float = 360.0) -> DataFrame:
    """Events of rows of ``with_frames``."""
    return _of(framed, "circling", _circling(least))


def holding(framed: DataFrame) -> DataFrame:
    """Events of rows of ``with_frames``."""
    return _of(framed, "holding_pattern", _holding())


def unusual_altitude(states: DataFrame, airports: DataFrame, min_nm: float = 15.0) -> DataFrame:
    return _of(N.with_airport(states, airports, min_nm), "unusual_altitude", _unusual_altitude())


def _entered(fence: Column, nm: Column) -> Column:
    return F.concat(F.lit("Entered geofence '"), fence, F.lit("' - "), label(), F.format_string(" at %.1f nm", nm))


def geofence_entry(states: DataFrame, fences: DataFrame) -> DataFrame:
    """Events of aircraft inside a fence, with the fence's name; ``dedup_events`` with it in the key gives entries."""
    rows = N.inside_fences(states, fences)
    return rows.select("icao", F.lit("geofence_entry").alias("event_type"), _entered(F.col("fence"), F.col("fence_nm")).alias("description"), "lat", "lon", "altitude_ft", "timestamp", "id", "fence")


def proximity(states: DataFrame, tick: float = 10.0, max_nm: float = 5.0, max_ft: float = 1000.0, silence: float = 60.0) -> DataFrame:
    """Pairs (a, b, nm, tick) of aircraft closer than the limits at the same tick; unknown altitudes don't separate.

    At each tick an aircraft stands where it was last, as long as it isn't silent for more than ``silence`` seconds at
    the tick's end; so a state counts for a run of ticks. Runs meet in stretches of as many ticks as a silence lasts, so that a state is in
    two of them at most, and by cells as high as the radius and wider than it: of each two cells one looks into
    the other (the next in the row, and those of the row above), so that every pair meets once. The join is an equality on (stretch, row,
    column); distances are computed once for two states, and the ticks of a close pair are listed after that.
    """
    height, long = max_nm / cells.DEGREE_NM, max(1, math.ceil(silence / tick))
    fields = ("icao", "lat", "lon", "altitude_ft", "timestamp", "callsign", "id")
    at = f"CAST(floor(timestamp / {tick}D) AS BIGINT)"
    last = states.selectExpr(f"{at} AS tick", *fields).groupBy("tick", "icao").agg(F.expr(f"max_by(struct({', '.join(fields)}), id) AS s"))
    end = states.agg(F.expr(f"max({at})")).scalar()
    held = last.selectExpr("*", f"CAST(floor((s.timestamp + {silence}D) / {tick}D) AS BIGINT) - 1 AS __until", "lead(tick) OVER (PARTITION BY icao ORDER BY tick) - 1 AS __next").withColumn("__end", end)
    held = held.filter("s.lat IS NOT NULL AND s.lon IS NOT NULL").selectExpr("tick", "greatest(tick, least(__until, coalesce(__next, __until), __end)) AS to", "s", f"{cells.row('s.lat', height)} AS row")
    runs = held.selectExpr("*", f"{cells.column('s.lon', 'row', height)} AS col", f"{cells.columns('row', height)} AS n", f"explode(sequence(CAST(floor(tick / {long}) AS BIGINT), CAST(floor(to / {long}) AS BIGINT))) AS stretch")
    own = "named_struct('row', row, 'col', col, 'own', true)"
    beside = "if(n > 1, array(named_struct('row', row, 'col', pmod(col + 1, n), 'own', false)), array())"
    others = f"transform({cells.above('s.lon', 'row', height)}, c -> named_struct('row', c.row, 'col', c.col, 'own', false))"
    look = runs.selectExpr("stretch", "tick AS x_from", "to AS x_to", "s AS x", f"inline(concat(array({own}), {beside}, {others}))")
    seen = runs.selectExpr("stretch", "row", "col", "tick AS y_from", "to AS y_to", "s AS y")
    lo, hi = f"greatest(x_from, y_from, stretch * {long})", f"least(x_to, y_to, stretch * {long} + {long - 1})"
    once = f"if(own, x.icao < y.icao, x.icao <> y.icao) AND {lo} <= {hi} AND coalesce(abs(x.altitude_ft - y.altitude_ft), 0) <= {max_ft}D"
    met = look.join(seen, ["stretch", "row", "col"]).filter(once).selectExpr("*", f"{haversine_expr('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS nm").filter(f"nm <= {max_nm}D")
    pairs = met.selectExpr(f"explode(sequence({lo}, {hi})) AS tick", "nm", "if(x.icao < y.icao, x, y) AS a", "if(x.icao < y.icao, y, x) AS b")
    return pairs.selectExpr("tick", *(f"a.{c} AS a_{c}" for c in fields), *(f"b.{c} AS b_{c}" for c in fields if c != "timestamp"), "nm")


def proximity_events(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """The first tick of each pair, told once until either aircraft's contact session ends; with ``other``, the second one."""
    of = lambda s: sessions.select(F.col("id").alias(f"{s}_id"), F.col("session").alias(f"{s}_session"))
    rows = pairs.join(of("a"), "a_id").join(of("b"), "b_id")
    name = lambda s: F.coalesce(f"{s}_callsign", f"{s}_icao")
    text = F.concat(F.lit("Proximity alert: "), name("a"), F.lit(" and "), name("b"), F.format_string(" within %.1f nm", F.col("nm")))
    event = F.struct(
        F.col("a_icao").alias("icao"), F.lit("proximity").alias("event_type"), text.alias("description"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"),
        F.col("a_altitude_ft").alias("altitude_ft"), F.col("a_timestamp").alias("timestamp"), F.col("a_id").alias("id"), F.col("b_icao").alias("other"),
    )
    return rows.groupBy("a_icao", "b_icao", "a_session", "b_session").agg(F.min_by(event, "tick").alias("e")).select("e.*")


def dedup_events(events: DataFrame, sessions: DataFrame, keys: tuple[str, ...] = ("icao", "event_type")) -> DataFrame:
    """The first event of each key in each contact session of its aircraft."""
    rows = events.join(sessions.select("id", "session"), "id")
    first = rows.groupBy(*keys, "session").agg(F.min_by(F.struct(*events.columns), "id").alias("e"))
    return first.select("e.*")


def _kind(name: str, text: Column, fence: Column) -> Column:
    return F.struct(F.lit(name).alias("event_type"), text.alias("description"), fence.alias("fence"))


def _holding_rules(rules: dict[str, tuple[Column, Column]]) -> Column:
    """Array of (event_type, description, fence) of the rules that hold in a row, in their order."""
    return F.filter(F.array(*(F.when(test, _kind(k, text, F.lit(None).cast("string"))) for k, (test, text) in rules.items())), lambda e: e.isNotNull())


def facts() -> Column:
    """What one row with the columns of ``with_airport`` and ``with_fences`` tells by itself: an array of (event_type, description, fence)."""
    plain = {"military_detected": _military(), "emergency_squawk": _emergency(), "rapid_descent": _rapid_descent(-5000), "low_altitude": _low_altitude(500), "unusual_altitude": _unusual_altitude()}
    entered = F.transform("fences", lambda f: _kind("geofence_entry", _entered(f["fence"], f["fence_nm"]), f["fence"]))
    return F.concat(_holding_rules(plain), entered)


def single_events(framed: DataFrame) -> DataFrame:
    """All events of single aircraft, from rows of ``with_frames`` with the columns of ``with_airport`` and ``with_fences``:
    one row for each rule that holds, with ``fence`` and ``session``."""
    each = F.explode(F.concat(facts(), _holding_rules({"circling": _circling(360.0), "holding_pattern": _holding()}))).alias("e")
    return framed.select("icao", each, "lat", "lon", "altitude_ft", "timestamp", "id", "session").select(*(f"e.{c}" if c in ("event_type", "description") else c for c in EVENT), "e.fence", "session")


def detect_all(states: DataFrame, fences: DataFrame, airports: DataFrame) -> DataFrame:
    """All events: the first of each kind (and fence) in each contact session, and the first of each close pair.

    The rules on single aircraft take one pass: two joins that leave each row one row, windows over one shuffle by
    aircraft, and the first events of a session on the same partitions.
    """
    framed = with_frames(N.with_fences(N.with_airport(states, airports, 15.0), fences))
    first = single_events(framed).groupBy("icao", "event_type", "fence", "session").agg(F.min_by(F.struct("description", "lat", "lon", "altitude_ft", "timestamp", "id"), "id").alias("e"))
    rows = first.select("icao", "event_type", "e.description", "e.lat", "e.lon", "e.altitude_ft", "e.timestamp", "e.id", "fence")
    close = proximity_events(proximity(states), contact_sessions(states)).drop("other").withColumn("fence", F.lit(None).cast("string"))
    return rows.unionByName(close)


def enrich_description(events: DataFrame, types: DataFrame) -> DataFrame:
    """Appends the aircraft's type to the description where the registry knows it."""
    known = events.join(types.select("icao", "type_name"), "icao", "left")
    text = F.when(F.col("type_name").isNotNull(), F.concat("description", F.lit(" ("), "type_name", F.lit(")"))).otherwise(F.col("description"))
    return known.withColumn("description", text).drop("type_name")
