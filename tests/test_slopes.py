"""Medians of pairwise slopes by counting against the plain median."""

import numpy as np
import pytest

from tremolite.operators import resample as rs


def plain(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    i, j = np.triu_indices(len(x), 1)
    dx, dy = x[j] - x[i], y[j] - y[i]
    s = dy[dx != 0] / dx[dx != 0]
    return (float(np.median(s)) if len(s) else 0.0), len(s)


def test_many_points(spark, monkeypatch):
    monkeypatch.setattr(rs, "REMAINDER", 2000)
    rng = np.random.default_rng(1)
    groups = {"noise": (rng.normal(size=900), rng.standard_cauchy(900)), "ties": (rng.integers(0, 20, 800), rng.integers(0, 5, 800)), "line": (np.arange(700) % 350, 3.0 * (np.arange(700) % 350)),
              "flat": (rng.normal(size=600), np.full(600, 2.0)), "one x": (np.full(600, 1.0), rng.normal(size=600)), "odd": (rng.normal(size=603) * 1e6, rng.normal(size=603) * 1e-6),
              "few": ([1, 2, 3, 3], [1, 3, 2, 9]), "single": ([1.0], [2.0])}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in groups.items() for a, b in zip(x, y, strict=True)], "k string, px double, py double").repartition(6)
    got = {r["k"]: r for r in rs.theil_sen(df, ["k"], "px", "py").collect()}
    assert set(got) == set(groups)
    for k, (x, y) in groups.items():
        slope, n = plain(x, y)
        assert got[k]["n_pairs"] == n and got[k]["slope"] == pytest.approx(slope, rel=1e-9, abs=1e-12), k


def test_without_keys_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=2500), rng.normal(size=2500)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    monkeypatch.setattr(rs, "BLOCK", 300)
    r = rs.theil_sen(df, [], "x", "y").first()
    slope, n = plain(x, y)
    assert r["n_pairs"] == n and r["slope"] == pytest.approx(slope, rel=1e-12)


def test_a_hundred_thousand_points(spark):
    df = spark.range(100_000).selectExpr("id * 1.0 AS x", "2.5 * id + (hash(id) % 1000) AS y")
    r = rs.theil_sen(df, [], "x", "y").first()
    assert r["n_pairs"] == 100_000 * 99_999 // 2 and r["slope"] == pytest.approx(2.5, abs=1e-3)
