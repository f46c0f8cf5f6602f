"""Epoch spectra against plain sums, and the radius join near the pole."""

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolite.operators import joins as jn
from tremolite.plans import epochs as ep, q_landing as ql

DAY = 86400


def test_radius_join_up_to_the_pole(spark):
    rng = np.random.default_rng(4)
    ev = pd.DataFrame({"event_id": np.arange(60), "lat": np.r_[26 + 20 * rng.random(50), [89.9, 89.0, -88.0, 60.0, 0.0, 89.99, 75.0, 80.0, -70.0, 85.0]], "lon": 128 + 20 * rng.random(60)})
    st = pd.DataFrame({"sid": np.arange(200), "slat": np.r_[26 + 20 * rng.random(150), 88 + 2 * rng.random(50)], "slon": 100 + 60 * rng.random(200)})
    got = {(r["event_id"], r["sid"]) for r in jn.within_km(spark.createDataFrame(ev), spark.createDataFrame(st), 150.0).collect()}
    want = {(e.event_id, s.sid) for e in ev.itertuples() for s in st.itertuples()
            if math.hypot((e.lat - s.slat) * 111.32, (e.lon - s.slon) * 111.32 * math.cos(math.radians(e.lat))) <= 150}
    assert got == want and any(e >= 50 for e, _ in want)


def test_radius_join_keeps_other_rows_cheap(spark):
    """One event next to the pole does not widen the reach of the others."""
    ev = spark.createDataFrame([(i, 30.0, 130.0 + i * 0.01) for i in range(100)] + [(100, 89.9, 130.0)], "event_id long, lat double, lon double")
    st = spark.createDataFrame([(i, 30.0, 100.0 + i * 0.06) for i in range(1000)], "sid long, slat double, slon double")
    near = jn.within_km(ev, st, 150.0)
    assert near.where("event_id = 100").count() == 0 and near.count() < 100 * 60


def power(x, fs=1 / 60.0):
    x = np.asarray(x) - np.mean(x)
    pad = 2 ** math.ceil(math.log2(len(x)))
    i = np.arange(len(x))
    ks = [k for k in range(pad // 2) if 0.001 <= k * fs / pad <= 0.1]
    return np.mean([abs(sum(x * np.exp(-2j * np.pi * k * i / pad))) ** 2 for k in ks]) / pad


def test_sides_order_and_limits(spark):
    rng = np.random.default_rng(8)
    rows = []
    for station, step in ((1, 600), (2, 7200)):  # the second record is too thin for 30 samples a side
        for t in range(0, 30 * DAY, step):
            rows.append((station, t, float(rng.normal(100, 5)), float(rng.normal(20, 2)) if t // step % 5 else None))
    rows += [(1, None, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "station long, t long, h double, z double").orderBy(F.rand(3))
    pairs = spark.createDataFrame([(1, 1, 10 * DAY + 16 * 3600), (2, 2, 10 * DAY), (3, 1, 0), (4, 9, 10 * DAY)], "event_id long, station long, t long")
    out = {(r["event_id"], r["station"]): r for r in ep.epoch_spectra(pairs, ep.night_days(s)).collect()}
    night = [(t, h, z) for st, t, h, z in rows if st == 1 and t is not None and z is not None and 15 <= t % DAY // 3600 <= 21]
    at = 10 * DAY + 16 * 3600
    pre, post = [r for r in night if at - 7 * DAY <= r[0] < at], [r for r in night if at < r[0] <= at + 7 * DAY]
    assert min(len(pre), len(post)) >= 60
    assert set(out) == {(1, 1)}
    r = out[(1, 1)]
    assert (r["n_pre"], r["n_post"]) == (len(pre), len(post))
    for side, part in (("pre", pre), ("post", post)):
        z, h = [x[2] for x in part[:60]], [x[1] for x in part[:60]]
        assert r[f"{side}_power_z"] == pytest.approx(power(z), rel=1e-9)
        assert r[f"{side}_polarization"] == pytest.approx(power(z) / power(h), rel=1e-9)
        assert r[f"{side}_fractal_dim"] is not None
    assert r["power_ratio"] == pytest.approx(power([x[2] for x in pre[:60]]) / power([x[2] for x in post[:60]]), rel=1e-9)


def test_empty_inputs(spark):
    s = spark.createDataFrame([], "station long, t long, h double, z double")
    pairs = spark.createDataFrame([(1, 1, 0)], "event_id long, station long, t long")
    assert ep.epoch_spectra(pairs, ep.night_days(s)).count() == 0
    assert ep.summary(ep.epoch_spectra(pairs.where("false"), ep.night_days(s)), ["station"]).count() == 0


def test_sides_that_begin_alike_are_transformed_once(spark, monkeypatch):
    """Events of one day gap begin and end their sides at the same samples: a dense record meets them once, not once per event."""
    seen, real = spark.sparkContext.accumulator(0), ep.spec.ulf_features

    def counted(fs):
        inner = real(fs).func

        @F.pandas_udf("power_z double, power_h double, polarization double, fractal_dim double")
        def run(z: pd.Series, h: pd.Series) -> pd.DataFrame:
            seen.add(len(z))
            return inner(z, h)
        return run
    monkeypatch.setattr(ep.spec, "ulf_features", counted)
    s = spark.range(30 * 480).select(F.lit(1).alias("station"), (F.col("id") * 180).alias("t"), F.sin("id").alias("z"), F.cos("id").alias("h"))
    pairs = spark.range(200).select(F.col("id").alias("event_id"), F.lit(1).alias("station"), (10 * DAY + F.col("id") * 100).alias("t"))
    out = ep.epoch_spectra(pairs, ep.night_days(s)).collect()
    assert len(out) == 200 and len({tuple(r)[2:] for r in out}) == 1 and out[0]["n_pre"] == out[0]["n_post"] == 7 * 140
    assert seen.value <= 16  # two arrays of two sides; 800 when each pair is transformed by itself


def plain_dimension(x, strides=10):
    lengths = []
    for k in range(1, strides + 1):
        steps = [(len(x) - 1 - o) // k for o in range(k)]
        lengths.append(np.mean([sum(abs(x[o + (i + 1) * k] - x[o + i * k]) for i in range(m)) * (len(x) - 1) / (k * m * k) for o, m in enumerate(steps)]))
    return np.polyfit(-np.log(np.arange(1, strides + 1)), np.log(lengths), 1)[0]


def observations(spark):
    """Two sites with 245 night samples a week whose character changes after the first 120 samples of a side, four events at the first."""
    rng = np.random.default_rng(12)
    rows = []
    for station in (1, 2):
        for t in range(0, 21 * DAY, 720):
            rows.append((station, t, int(rng.integers(0, 50) + t // DAY % 7 * 300), float(rng.normal(20, 2) + t // DAY % 7 * 30)))
    obs = spark.createDataFrame(rows, "station long, t long, flag int, value double")
    sites = spark.createDataFrame([(1, 30.0, 130.0), (2, 40.0, 140.0)], "sid long, slat double, slon double")
    events = [(1, 7 * DAY), (2, 10 * DAY + 16 * 3600), (3, 10 * DAY + 3600), (4, 14 * DAY)]
    quakes = spark.createDataFrame([(e, 30.0, 130.0, 5.0, t) for e, t in events], "event_id long, lat double, lon double, mag double, t long")
    want = {}
    for e, t in events:
        night = [(x[1], x[2], x[3]) for x in rows if x[0] == 1 and 15 <= x[1] % DAY // 3600 <= 21]
        first = rows[0][1]
        at = first + t % (max(x[1] for x in rows) - first + 1)
        want[e] = [[x for x in night if lo <= x[0] <= hi and x[0] != at] for lo, hi in ((at - 7 * DAY, at - 1), (at + 1, at + 7 * DAY))]
    return SimpleNamespace(station_obs=obs, stations=sites, quakes=quakes), want


def test_the_query_takes_whole_sides(spark):
    v, want = observations(spark)
    got = {r["event_id"]: r for r in ql.epochs(v).collect()}
    assert set(got) == set(want) and min(len(side) for sides in want.values() for side in sides) > 200
    for e, sides in want.items():
        for name, side in zip(("pre", "post"), sides):
            z, h = [x[1] for x in side], [x[2] for x in side]
            assert got[e][f"n_{name}"] == len(side)
            assert got[e][f"{name}_power_z"] == pytest.approx(power(z), rel=1e-9)
            assert got[e][f"{name}_polarization"] == pytest.approx(power(z) / power(h), rel=1e-9)
            assert got[e][f"{name}_fractal_dim"] == pytest.approx(plain_dimension(z), rel=1e-9)
            assert abs(power(z) / power(z[:60]) - 1) > 0.5  # the beginning alone says something else


def test_sides_dealt_to_many_tasks(spark, monkeypatch):
    """A page that goes to a part of its sides at a time gives the same rows."""
    v, want = observations(spark)
    whole = sorted(tuple(r) for r in ql.epochs(v).collect())
    monkeypatch.setattr(ep, "TOGETHER", 300)
    got = sorted(tuple(r) for r in ql.epochs(v).collect())
    assert len(got) == len(want) and all(a == pytest.approx(b, rel=1e-12) for a, b in zip(got, whole, strict=True))


def test_the_summary_averages_whole_sides(spark):
    v, want = observations(spark)
    got, = ql.a62c(v).collect()
    assert (got["station"], got["n_pairs"]) == (1, len(want))
    z = [[[x[1] for x in side] for side in sides] for sides in want.values()]
    ratios = [power(pre) / power(post) for pre, post in z]
    assert got["mean_ratio"] == pytest.approx(np.mean(ratios), abs=1e-5)
    assert got["share_15"] == pytest.approx(np.mean([r > 1.5 for r in ratios]), abs=1e-5)
    assert [got["pre_fractal_dim"], got["post_fractal_dim"]] == pytest.approx([np.mean([plain_dimension(sides[k]) for sides in z]) for k in (0, 1)], abs=1e-5)
