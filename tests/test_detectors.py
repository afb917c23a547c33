"""Grid joins, frames and pairs against plain Python, near poles, over the antimeridian and where frames overflow."""

import itertools
import math
import random
from collections import Counter, defaultdict

from skyframe.operators import detectors as D
from skyframe.operators import enrichment as N

STATES = "id long, icao string, lat double, lon double, altitude_ft int, speed_kts double, heading_deg double, vertical_rate_fpm int, timestamp double, callsign string, squawk string"


def nm(lat1, lon1, lat2, lon2):
    y1, x1, y2, x2 = map(math.radians, (lat1, lon1, lat2, lon2))
    a = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 3440.065 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def places(r, n):
    """Places anywhere, and many at the poles, the antimeridian and in one crowded spot."""
    kinds = [
        lambda: (math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)),
        lambda: (r.choice([-1, 1]) * (90 - r.expovariate(2)), r.uniform(-180, 180)),
        lambda: (r.uniform(-80, 80), r.choice([-180, 180, 179.99, -179.99]) + r.uniform(-0.01, 0.01)),
        lambda: (r.gauss(35, 0.3), r.gauss(-82, 0.3)),
    ]
    out = [kinds[k % 4]() for k in range(n)] + [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0)]
    return [(min(90.0, max(-90.0, y)), (x + 180) % 360 - 180) for y, x in out]


def test_nearest_airport_anywhere(spark):
    r = random.Random(1)
    airports = [(f"A{k:04}", f"name {k}", y, x) for k, (y, x) in enumerate(places(r, 1500))]
    points = [(k, y, x) for k, (y, x) in enumerate(places(r, 800))] + [(9000, None, 1.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double").repartition(3)
    table = spark.createDataFrame(airports, "code string, name string, lat double, lon double")
    for radius in (3.0, 30.0, 400.0):
        got = {x.id: (x.airport, x.airport_nm) for x in N.near_airports(df, table, radius).collect()}
        for k, y, x in points[:-1]:
            best = min((nm(y, x, a[2], a[3]), a[0]) for a in airports)
            assert (k in got) == (best[0] < radius) and (k not in got or abs(got[k][1] - best[0]) < 1e-6), (radius, k, y, x, best)
        assert 9000 not in got


def test_many_airports_meet_few_points_each(spark):
    """50,000 airports: a point is compared with those of its own cell only."""
    r = random.Random(2)
    table = spark.createDataFrame([(str(k), "", math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for k in range(50_000)], "code string, name string, lat double, lon double")
    spread = table.selectExpr(f"explode({N.cells.around('lat', 'lon', 0.25)}) AS c").groupBy("c").count()
    assert spread.agg({"count": "avg"}).first()[0] < 20 and spread.agg({"count": "max"}).first()[0] < 40
    df = spark.range(2000).selectExpr("id", "degrees(asin((id * 7919 % 2000) / 1000.0D - 1)) AS lat", "(id * 104729 % 36000) / 100.0D - 180 AS lon")
    plan = N.with_airport(df, table, 15.0)
    assert plan.count() == 2000 and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_fences_of_any_size(spark):
    r = random.Random(3)
    fences = [(f"f{k}", y, x, r.choice([0.5, 5.0, 60.0, 500.0])) for k, (y, x) in enumerate(places(r, 60))]
    points = [(k, y, x) for k, (y, x) in enumerate(places(r, 500))]
    got = N.inside_fences(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(fences, "name string, lat double, lon double, radius_nm double"))
    want = {(k, f[0]) for k, y, x in points for f in fences if nm(y, x, f[1], f[2]) <= f[3]}
    assert {(x.id, x.fence) for x in got.collect()} == want and len(want) > 100


def states(spark, rows):
    return spark.createDataFrame(rows, STATES).repartition(3)


def brute_frames(rows):
    """Rules on the last 120 points of 300 and 120 seconds, as lists."""
    circling, holding, track = {}, {}, defaultdict(list)
    for row in sorted(rows):
        track[row[1]].append(row)
        last = track[row[1]][-120:]
        heads = [p[6] for p in last if p[8] >= row[8] - 300 and p[6] is not None]
        turned = sum(min(abs(a - b) % 360, 360 - abs(a - b) % 360) for a, b in itertools.pairwise(heads))
        if len(heads) >= 4 and turned >= 360:
            circling[row[0]] = round(turned)
        recent = [p for p in last if p[8] >= row[8] - 120]
        alts, heads = [p[4] for p in recent if p[4] is not None], [p[6] for p in recent if p[6] is not None]
        if len(track[row[1]]) < 8 or len(alts) < 4 or max(alts) - min(alts) > 500 or len(heads) < 8:
            continue
        top = sorted(((-n, b) for b, n in Counter(int(h // 10) % 36 for h in heads).items()))[:2]
        if len(top) == 2 and top[1][0] <= -2:
            apart = abs(top[0][1] - top[1][1])
            if abs(min(apart, 36 - apart) - 18) <= 3:
                holding[row[0]] = int(sum(alts) / len(alts))
    return circling, holding


def test_frames_against_lists(spark):
    """Aircraft with dense points (more than 120 in a frame, more than 127 in a bin), sparse ones, null headings and heights, equal times, depths below zero."""
    r = random.Random(4)
    rows, k = [], 0
    for a, (gap, n) in enumerate([(0.2, 900), (1.0, 500), (9.0, 200), (40.0, 60), (0.0, 150), (2.0, 7), (0.1, 700)]):
        t, heading = 1000.0 * a, 0.0
        for j in range(n):
            k, t = k + 1, t + (gap * r.choice([0, 1, 2]))
            heading = heading if a == 6 else r.choice([90.0, 270.0]) if a in (0, 2) else (heading + r.choice([0.0, 3.5, 10.25, -2.0])) % 360
            rows.append((k, f"I{a}", 35.0, -82.0, None if r.random() < 0.1 else (-300 if a == 2 else 3000) + r.randint(0, 251), 100.0, None if r.random() < 0.15 else heading, 0, t, None, "1200"))
    circling, holding = brute_frames(rows)
    framed = D.with_frames(states(spark, rows))
    got = {x.id: x.description for x in D.circling(framed).collect()}
    assert {i: int(t.split(" - ")[1].split(" ")[0]) for i, t in got.items()} == circling and len(circling) > 300
    got = {x.id: int(x.description.split("stable at ")[1].split(" ")[0]) for x in D.holding(framed).collect()}
    assert got == holding and len(holding) > 300 and min(holding.values()) < 0
    plan = framed._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning(icao") == 1


def brute_pairs(rows):
    last = {}
    for x in rows:
        last[math.floor(x[8] / 10), x[1]] = max(last.get((math.floor(x[8] / 10), x[1]), x), x)
    end, by_tick, own = max(t for t, _ in last), defaultdict(list), defaultdict(list)
    for t, icao in sorted(last):
        own[icao].append(t)
    for icao, ticks in own.items():
        for t, after in itertools.zip_longest(ticks, ticks[1:]):
            x = last[t, icao]
            to = max(t, min(math.floor((x[8] + 60) / 10) - 1, math.inf if after is None else after - 1, end))
            for tick in range(t, to + 1):
                by_tick[tick].append(x)
    out = set()
    for tick, xs in by_tick.items():
        for a, b in itertools.combinations(sorted(xs, key=lambda x: x[1]), 2):
            if abs((a[4] or 0) - (b[4] or 0)) * (a[4] is not None and b[4] is not None) <= 1000 and nm(a[2], a[3], b[2], b[3]) <= 5:
                out.add((tick, a[1], b[1], a[0], b[0]))
    return out


def test_proximity_anywhere(spark):
    r = random.Random(5)
    spots, rows = places(r, 40), []
    for k in range(1500):
        y, x = r.choice(spots)
        y = min(90.0, max(-90.0, y + r.gauss(0, 0.03)))
        x = (x + r.gauss(0, 0.03) / max(0.01, math.cos(math.radians(y))) + 180) % 360 - 180
        rows.append((k, f"I{r.randint(0, 250)}", y, x, r.choice([None, 1000, 1500, 9000]), 100.0, 0.0, 0, -400.0 + k * 0.7, "C", "1200"))
    got = [(x.tick, x.a_icao, x.b_icao, x.a_id, x.b_id) for x in D.proximity(states(spark, rows)).collect()]
    assert len(got) == len({*got}) and {*got} == brute_pairs(rows) and len(got) > 500


def test_one_pass(spark):
    fences = spark.createDataFrame([("f", 35.0, -82.0, 10.0)], "name string, lat double, lon double, radius_nm double")
    airports = spark.createDataFrame([("KAVL", "A", 35.4, -82.5)], "code string, name string, lat double, lon double")
    rows = [(k, "ADF7C8", 35.0, -82.0, 400, 300.0, float(k * 100 % 360), -6000, k * 20.0, "RCH1", "7700") for k in range(10)] + [(20, "ADF7C8", 35.0, -82.0, 400, 300.0, 0.0, -6000, 400.0, "RCH1", "7700")]
    got = Counter(x.event_type for x in D.detect_all(states(spark, rows), fences, airports).collect())
    kinds = {"military_detected", "emergency_squawk", "rapid_descent", "low_altitude", "unusual_altitude", "geofence_entry"}
    assert got == {**dict.fromkeys(kinds, 2), "circling": 2}  # the later row begins a session, its frame still holds five of the points before
