"""The threshold search against all pairs, and how many pairs it forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolite.operators import thresholds as th

DAY = 86400
TIME, BOX = ("t", "st", 100.0 * DAY), ("lat", "lon", "slat", "slon", 2.0)


def tables(n, targets, seed=3, coarse=False):
    """A third of all sources in one spot; `coarse` values bring many ties and many values on the edges of windows."""
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 1 / 3
    lat = np.where(hot, 36 + rng.normal(0, 0.3, n), 26 + 20 * rng.random(n))
    lon = np.where(hot, 140 + rng.normal(0, 0.3, n), 128 + 20 * rng.random(n))
    s = pd.DataFrame({"sid": np.arange(n), "st": rng.integers(0, 400 * DAY, n), "slat": np.round(lat, 2), "slon": np.round(lon, 2), "mag": np.round(3 + rng.exponential(0.43, n), 2)})
    if coarse:
        s = s.assign(st=(s.st // (25 * DAY)) * 25 * DAY, slat=s.slat.round(), slon=s.slon.round(), mag=s.mag.round())
    pick = rng.choice(n, targets, replace=False)
    t = s.loc[pick, ["sid", "st", "slat", "slon"]].set_axis(["id", "t", "lat", "lon"], axis=1).reset_index(drop=True)
    return t, s


def near(row, s):
    return s[(s.st >= row.t - 100 * DAY) & (s.st < row.t) & ((s.slat - row.lat).abs() <= 2) & ((s.slon - row.lon).abs() <= 2)]


def brute(t, s, k, rank):
    out = set()
    for row in t.itertuples():
        best = near(row, s[s[rank].notna()]).sort_values([rank, "sid"], ascending=[False, True]).head(k)
        out |= {(row.id, sid, i + 1) for i, sid in enumerate(best.sid)}
    return out


@pytest.mark.parametrize("rank,width", [("mag", 0.25), ("st", 5.0 * DAY)])
@pytest.mark.parametrize("coarse", [False, True])
def test_equals_all_pairs(spark, rank, width, coarse):
    t, s = tables(3000, 200, coarse=coarse)
    got = th.top_k_within(spark.createDataFrame(t), spark.createDataFrame(s), ["id"], 7, TIME, BOX, rank, width, ["sid"])
    assert {(r["id"], r["sid"], r["rk"]) for r in got.collect()} == brute(t, s, 7, rank)


@pytest.mark.parametrize("rank,width", [("mag", 0.25), ("st", 5.0 * DAY)])
def test_few_pairs_in_a_crowd(spark, rank, width):
    """Pairs formed follow k and the bins, not the crowd."""
    t, s = tables(30000, 300)
    pairs = sum(len(near(row, s)) for row in t.itertuples())
    formed = th.candidates(spark.createDataFrame(t), spark.createDataFrame(s), 5, TIME, BOX, rank, width).count()
    assert formed < pairs / 10, (formed, pairs)


def test_null_empty_and_short_windows(spark):
    t, s = tables(300, 40)
    s.loc[:49, "mag"] = np.nan
    src = spark.createDataFrame(s).withColumn("mag", F.when(~F.isnan("mag"), F.col("mag")))
    left = spark.createDataFrame(t)
    run = lambda a, b: {(r["id"], r["sid"], r["rk"]) for r in th.top_k_within(a, b, ["id"], 50, TIME, BOX, "mag", 0.25, ["sid"]).collect()}
    assert run(left, src) == brute(t, s, 50, "mag")
    assert run(left.where("false"), src) == set()
    assert run(left, src.where("false")) == set()
