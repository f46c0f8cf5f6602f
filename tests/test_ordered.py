"""Ordered operators against pandas on a series where one key holds most rows and values tie heavily."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolite.operators import expand as ex, ordered as od, windows as wn


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "key": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n)),
                        "t": rng.integers(0, 500, n), "v": np.round(rng.normal(0, 3, n), 1)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def sort(pdf):
    return pdf.sort_values(["key", "t", "id"]).reset_index(drop=True)


def test_slices_are_even(rows):
    _, df = rows
    cuts = od.split_points(df, "t", 16)
    sizes = [r["count"] for r in od.sliced(df, "t", cuts).groupBy(od.SLICE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 3000 / 16


def test_running_and_rank(rows):
    pdf, df = rows
    got = sort(od.running(df, ["key"], "t", {"s": F.col("v")}, ["id"], totals=True, maxes={"m": F.col("v")}).toPandas())
    want = sort(pdf)
    assert np.allclose(got.s, want.groupby("key").v.cumsum())
    assert np.allclose(got.m, want.groupby("key").v.cummax())
    assert np.allclose(got.s_total, want.groupby("key").v.transform("sum"))
    rank = sort(od.ranked(df, ["key"], "t", ["id"], "r", total="n").toPandas())
    assert (rank.r == want.groupby("key").cumcount() + 1).all()


def test_running_exclusive(rows):
    pdf, df = rows
    got = sort(od.running(df, ["key"], "t", {"s": F.col("v")}, ["id"], include_current=False).toPandas())
    want = sort(pdf)
    assert np.allclose(got.s, want.groupby("key").v.cumsum() - want.v)


def test_rolling_blocks_keep_frames_exact(rows):
    pdf, df = rows
    got = sort(od.rolling(df, ["key"], "t", ["id"], 10, 2, lambda f: {"a": F.avg("v").over(f(-10, -1)), "b": F.sum("v").over(f(0, 2))}, block=64).toPandas())
    want = sort(pdf)
    assert len(got) == len(pdf)
    a = want.groupby("key").v.transform(lambda s: s.shift(1).rolling(10, min_periods=1).mean())
    b = want.groupby("key").v.transform(lambda s: s[::-1].rolling(3, min_periods=1).sum()[::-1])
    assert np.allclose(got.a.astype(float), a, equal_nan=True) and np.allclose(got.b, b)


def test_lag_over_hot_key(rows):
    pdf, df = rows
    got = sort(od.neighbour_value(df, ["key"], "t", ["id"], 1, {"p": "id"}).toPandas())
    assert np.allclose(got.p.astype(float), sort(pdf).groupby("key").id.shift(1), equal_nan=True)


def test_exact_quantiles(rows):
    pdf, df = rows
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p999": 0.999}
    for keys in ([], ["key"]):
        got = od.exact_quantiles(df, keys, "v", probs).toPandas()
        for _, r in got.iterrows():
            part = pdf if not keys else pdf[pdf.key == r["key"]]
            assert r["n"] == len(part)
            for name, p in probs.items():
                assert r[name] == pytest.approx(np.quantile(part.v, p))


def test_carry_forward(rows):
    pdf, df = rows
    flag = df.withColumn("w", F.when(F.col("v") > 3, F.col("v")))
    got = sort(od.carry_forward(flag, ["key"], "t", ["id"], {"last": F.col("w")}, include_current=False).toPandas())
    want = sort(pdf)
    w = want.v.where(want.v > 3)
    assert np.allclose(got["last"].astype(float), w.groupby(want.key).transform(lambda s: s.ffill().shift(1)), equal_nan=True)


def test_average_rank(rows):
    pdf, df = rows
    got = wn.average_rank(df, [], "v", "r").toPandas().sort_values("id")
    assert np.allclose(got.r, pdf.sort_values("id").v.rank())


def test_systematic_sample(rows):
    pdf, df = rows
    got = sorted(r["id"] for r in ex.systematic_sample(df, "t", ["id"], 70).collect())
    order = pdf.sort_values(["t", "id"]).id.to_numpy()
    assert got == sorted(order[int(i * len(order) / 70)] for i in range(70))
    assert ex.systematic_sample(df, "t", ["id"], 10 ** 6).count() == len(pdf)


def test_empty_input(spark):
    df = spark.createDataFrame([], "key string, t long, id long, v double")
    assert od.running(df, ["key"], "t", {"s": F.col("v")}, ["id"]).count() == 0
    assert od.exact_quantiles(df, [], "v", {"p": 0.5}).first()["n"] in (None, 0)
