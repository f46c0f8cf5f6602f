"""Sums near targets from blocks against every pair, with small blocks and crowded cells."""

import numpy as np
import pandas as pd
import pytest

from tremolite.operators import blocks as bl

DAY = 86400


def catalogue(n, seed, whole=False):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 0.4
    pdf = pd.DataFrame({"event_id": np.arange(n), "t": (rng.random(n) * 400 * DAY).astype(int), "lat": np.where(hot, 36 + rng.normal(0, 0.3, n), 26 + 20 * rng.random(n)),
                        "lon": np.where(hot, 140 + rng.normal(0, 0.3, n), 128 + 20 * rng.random(n)), "mag": 3 + rng.exponential(0.6, n), "depth_km": rng.integers(0, 90, n).astype(float)})
    # hundredths put many differences exactly at the radius, up to rounding
    return pdf.assign(t=pdf.t // DAY * DAY, lat=(pdf.lat * 10).round() / 10 + 0.03, lon=(pdf.lon * 10).round() / 10 + 0.07) if whole else pdf


def near(row, e, days, radius):
    return e[(e.t < row.t) & (e.t >= row.t - days * DAY) & ((e.lat - row.lat).abs() <= radius) & ((e.lon - row.lon).abs() <= radius)]


@pytest.mark.parametrize("whole,block", [(False, 64), (True, 64), (True, 8192)])
def test_window_sums_equal_every_pair(spark, whole, block):
    e = catalogue(1500, 3, whole)
    t = e[e.mag >= 4].reset_index(drop=True)
    got = bl.window_sums(spark.createDataFrame(t[["event_id", "t", "lat", "lon"]]), spark.createDataFrame(e[["event_id", "t", "lat", "lon", "mag"]]), ["event_id"], [60, 7], 2.0, ["mag"], block)
    got = {r["event_id"]: r for r in got.collect()}
    for row in t.itertuples():
        wide = near(row, e, 60, 2.0)
        assert (row.event_id in got) == (len(wide) > 0)
        for days, one in ((7, near(row, e, 7, 2.0)), (60, wide)):
            if not len(wide):
                continue
            r = got[row.event_id]
            assert r[f"n{days}"] == len(one)
            if len(one):
                assert r[f"sum_mag{days}"] == pytest.approx(one.mag.sum(), rel=1e-12) and r[f"min_mag{days}"] == one.mag.min()
            else:
                assert r[f"sum_mag{days}"] is None and r[f"min_mag{days}"] is None


def test_stress_sums_equal_every_pair(spark):
    e = catalogue(1200, 5)
    t, s = e[e.mag >= 3.5].reset_index(drop=True), e[e.mag >= 4]
    got = {r["event_id"]: r for r in bl.stress_sums(spark.createDataFrame(t), spark.createDataFrame(s), ["event_id"], 300.0, 0.3, block=50).collect()}
    for row in t.itertuples():
        p = near(row, s, 0.3 * 365.25, 300.0 / 111.32)
        r3 = np.sqrt(((row.lon - p.lon) * 111320 * np.cos(np.radians(p.lat))) ** 2 + ((row.lat - p.lat) * 111320) ** 2 + ((row.depth_km - p.depth_km) * 1000) ** 2)
        kpa = np.where(r3 < 500, 0, 10 ** (1.5 * p.mag + 9.05) / (8 * np.pi * np.maximum(r3, 1) ** 3) / 1000).sum()
        assert (row.event_id in got) == (len(p) > 0)
        if len(p):
            assert got[row.event_id]["n_sources"] == len(p) and got[row.event_id]["kpa"] == pytest.approx(kpa, rel=1e-10, abs=1e-12)


def test_pairs_stay_inside_the_tasks(spark):
    """An event in a crowd costs its block a few rows; joins with a row per pair made a thousand times as many."""
    n = 3000
    e = spark.range(n).selectExpr("id AS event_id", "id * 60 AS t", "36.0 + (id % 97) / 1000 AS lat", "140.0 + (id % 89) / 1000 AS lon")
    met = bl._meetings(e, e, 30.0, 2.0, 1024)
    assert met.count() <= 600
    got = bl.window_sums(e, e, ["event_id"], [30], 2.0, block=1024)
    assert got.selectExpr("sum(n30)").first()[0] == n * (n - 1) // 2
