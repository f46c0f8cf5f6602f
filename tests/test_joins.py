"""Join helpers against nested loops; half of all rows sit in one place and time."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolite.functions import spatial as sp
from tremolite.operators import aggregates as ag, joins as jn


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    n = 400
    hot = rng.random(n) < 0.5
    pdf = pd.DataFrame({"id": np.arange(n), "t": np.where(hot, rng.integers(1000, 1040, n), rng.integers(0, 5000, n)),
                        "lat": np.where(hot, 35 + rng.random(n), 26 + 20 * rng.random(n)), "lon": np.where(hot, 140 + rng.random(n), 128 + 20 * rng.random(n)),
                        "mag": np.round(3 + rng.exponential(0.5, n), 1)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("salt", [1, 3])
def test_range_join(points, closed, salt):
    pdf, df = points
    right = df.selectExpr("id AS rid", "t AS rt", "lat AS rlat", "lon AS rlon")
    got = {(r["id"], r["rid"]) for r in jn.range_join(df, right, time=("t", "rt", -100, 50), closed=closed, box=("lat", "lon", "rlat", "rlon", 1.5), salt=salt).select("id", "rid").collect()}
    want = set()
    for a in pdf.itertuples():
        for b in pdf.itertuples():
            d = b.t - a.t
            lo = d >= -100 if closed in ("both", "left") else d > -100
            hi = d <= 50 if closed in ("both", "right") else d < 50
            if lo and hi and abs(a.lat - b.lat) <= 1.5 and abs(a.lon - b.lon) <= 1.5:
                want.add((a.id, b.id))
    assert got == want


def test_exists_within_with_weight(points):
    pdf, df = points
    left = df.withColumn("need", df.mag - 0.5)
    got = {r["id"] for r in jn.exists_within(left, df.drop("id"), ["id"], time=("t", "t", -200, 0), closed="left", box=("lat", "lon", "lat", "lon", 1.5), weight=("need", "mag")).collect()}
    want = {a.id for a in pdf.itertuples() if ((pdf.t >= a.t - 200) & (pdf.t < a.t) & ((pdf.lat - a.lat).abs() <= 1.5) & ((pdf.lon - a.lon).abs() <= 1.5) & (pdf.mag >= a.mag - 0.5)).any()}
    assert got == want and 0 < len(want) < len(pdf)


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, points, strict):
    pdf, df = points
    left = df.selectExpr("id % 3 AS k", "t", "id")
    right = df.where("id % 2 = 0").selectExpr("id % 3 AS k", "t AS rt", "id AS rid")
    got = {r["id"]: r["rt"] for r in jn.asof_join(left, right, ["k"], "t", "rt", ["rid"], strict=strict).collect()}
    assert len(got) == len(pdf)
    ev = pdf[pdf.id % 2 == 0]
    for a in pdf.itertuples():
        m = ev[(ev.id % 3 == a.id % 3) & ((ev.t < a.t) if strict else (ev.t <= a.t))]
        assert got[a.id] == (m.t.max() if len(m) else None)


def test_nearest(points):
    pdf, df = points
    right = df.where("id < 60").selectExpr("id AS rid", "lat AS rlat", "lon AS rlon")
    got = {r["id"]: (r["rid"], r["distance"]) for r in jn.nearest_join(df, right, ["id"], ("lat", "lon"), ("rlat", "rlon"), "rid", 1.0, sp.degree_distance).collect()}
    r = pdf[pdf.id < 60]
    for a in pdf.itertuples():
        d = np.sqrt((r.lat - a.lat) ** 2 + ((r.lon - a.lon) * np.cos(np.radians(a.lat))) ** 2)
        if d.min() <= 1.0:
            assert got[a.id][1] == pytest.approx(d.min())
        else:
            assert a.id not in got


def test_sessions_across_chunks(spark):
    rows = [("s", t, 1.0) for t in (0, 60, 121, 86390, 86400, 86460, 200000)]
    got = ag.sessions(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", 60, "v").orderBy("t_start").collect()
    assert [(r["t_start"], r["t_end"], r["n"]) for r in got] == [(0, 60, 2), (121, 121, 1), (86390, 86460, 3), (200000, 200000, 1)]


def _nearest_k_case(spark, events, stations):
    return {(r["event_id"], r["rk"]): (r["sid"], r["km"]) for r in jn.nearest_k(
        spark.createDataFrame(events, "event_id long, lat double, lon double"), spark.createDataFrame(stations, "sid long, slat double, slon double"),
        ["event_id"], 5, 300.0, (3.0, 4.0), ("lat", "lon", "slat", "slon"), "sid").collect()}


def test_nearest_k_against_all_pairs(spark):
    """Crowds, copies of one position, empty sea, high latitudes and the limits of the box."""
    rng = random.Random(3)
    stations = [(i, 30 + rng.random() * 20, 130 + rng.random() * 20) for i in range(300)] + [(1000 + i, 35 + rng.random() / 200, 140 + rng.random() / 200) for i in range(300)]
    stations += [(2000 + i, 41.0, 141.0) for i in range(30)] + [(3000 + i, 84 + rng.random() * 5, 140 + rng.random() * 20) for i in range(60)]
    events = [(i, 28 + rng.random() * 24, 128 + rng.random() * 24) for i in range(150)] + [(200 + i, 35 + rng.random() / 100, 140 + rng.random() / 100) for i in range(40)]
    events += [(300 + i, 84 + rng.random() * 5.9, 140 + rng.random() * 20) for i in range(40)] + [(400, 41.0, 141.0), (401, 38.0, 141.0), (402, None, 140.0)]
    want = {}
    for e, la, lo in events:
        if la is None:
            continue
        near = []
        for sid, sa, so in stations:
            if abs(la - sa) <= 3 and abs(lo - so) <= 4:
                a = math.sin(math.radians(sa - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(sa)) * math.sin(math.radians(so - lo) / 2) ** 2
                near.append((2 * 6371.0 * math.asin(min(1.0, math.sqrt(a))), sid))
        for rk, (km, sid) in enumerate(sorted(x for x in near if x[0] <= 300)[:5], 1):
            want[(e, rk)] = (sid, pytest.approx(km, abs=1e-6))
    assert _nearest_k_case(spark, events, stations) == want


def test_nearest_k_does_not_meet_whole_crowds(spark):
    """40 events amid 4,000 stations: the station selection met all 160,000 pairs before it kept five of each."""
    rng = random.Random(4)
    stations = [(i, 35 + rng.random(), 140 + rng.random()) for i in range(4000)]
    events = [(i, 35 + rng.random(), 140 + rng.random()) for i in range(40)]
    met = spark.sparkContext.accumulator(0)

    @F.udf("boolean", useArrow=False)
    def seen(_):
        met.add(1)
        return True
    real = jn.sp.haversine_km
    jn.sp.haversine_km = lambda *x: F.when(seen(x[2]), real(*x))
    try:
        got = _nearest_k_case(spark, events, stations)
    finally:
        jn.sp.haversine_km = real
    assert len(got) == 200 and 0 < met.value < 160_000 / 2  # the plan may look at a pair twice
