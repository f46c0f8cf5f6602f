"""Keyed permutations, importance and the fold vote, and the second level, against plain NumPy."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tremolite.plans import importance as im, models as md, stacking as st


@pytest.mark.parametrize("n", [1, 2, 7, 256, 1000])
def test_shuffled_is_a_permutation_per_key(spark, n):
    keys = 4
    df = spark.range(n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))))
    got = df.select("k", "id", im.shuffled(F.col("id"), F.lit(n).cast("long"), im.round_keys(F.col("k"))).alias("to")).toPandas()
    perms = []
    for _, g in got.groupby("k"):
        assert sorted(g["to"]) == list(range(n))
        perms.append(tuple(g.sort_values("id")["to"]))
    if n >= 256:
        assert len(set(perms)) == keys
        for p in perms:  # few fixed points, no trace of the old order
            assert sum(a == b for a, b in enumerate(p)) < 8 and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.2


def swap_or_not(n, key):
    def mix(x):
        for a, b in ((48271, 11), (69621, 7)):
            x = (x * a + b) % im.PRIME
            x = x * x % im.PRIME
        return x
    out = []
    for i in range(n):
        for k in range(1, im.ROUNDS + 1):
            x = key * im.ROUNDS + k
            mate = (mix(x) - i) % n
            if (max(i, mate) * mix(x + 1000003) + mix(x + 2000003)) % im.PRIME % 2 == 1:
                i = mate
        out.append(i)
    return out


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def sample(n=600, seed=1):
    rng = np.random.default_rng(seed)
    a, b, noise = rng.random(n), rng.random(n), rng.random(n)
    y = (rng.random(n) < 0.15 + 0.6 * a + 0.1 * b).astype("int32")
    return pd.DataFrame({"k": np.arange(n), "day": np.arange(n) * 1.0, "g": np.arange(n) % 3 == 0, "a": a, "b": b, "noise": noise, "y": y})


def test_importance_equals_numpy(spark):
    pdf = sample()
    score = lambda d: d.withColumn("_s", F.round(0.6 * F.col("a") + 0.3 * F.col("b") + 0.05, 6))
    got = im.permutation_importance(spark.createDataFrame(pdf), ["a", "b"], "y", score, "day", "k", keys=["g"], repeats=3)
    got = {(r["g"], r["feature"]): r for r in got.collect()}
    assert len(got) == 4
    for g, part in pdf.groupby("g"):
        y = part.y.to_numpy()
        f = lambda t: np.round(0.6 * t["a"] + 0.3 * t["b"] + 0.05, 6)
        loss = lambda s: -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))
        cols = {x: part[x].to_numpy() for x in ("a", "b")}
        base = f(cols)
        for j, x in enumerate(("a", "b")):
            aucs, losses = [], []
            for rep in range(3):
                to = swap_or_not(len(part), j * 3 + rep)
                moved = np.empty(len(part))
                moved[to] = cols[x]
                s = f({**cols, x: moved})
                aucs.append(auc(y, s))
                losses.append(loss(s))
            r = got[(g, x)]
            assert r["baseline"] == pytest.approx(auc(y, base)) and r["permuted"] == pytest.approx(np.mean(aucs)) and r["std"] == pytest.approx(np.std(aucs))
            assert r["importance_loss"] == pytest.approx(np.mean(losses) - loss(base)) and r["std_loss"] == pytest.approx(np.std(losses))


def test_vote_keeps_what_matters(spark):
    fit = lambda train: lambda d: d.withColumn("_s", F.round(0.8 * F.col("a") + 0.1 * F.col("b"), 6))
    got = {r["feature"]: r for r in im.stable_features(spark.createDataFrame(sample(2000)), ["a", "noise"], "y", fit, "day", "k", min_importance=0.02).collect()}
    assert got["a"]["folds"] == 3 and got["a"]["votes"] == 3 and got["a"]["stable"]
    assert got["noise"]["votes"] == 0 and not got["noise"]["stable"] and got["noise"]["mean_importance"] == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError):
        im.stable_features(spark.createDataFrame(sample(20)).limit(0), ["a"], "y", fit, "day", "k")


@pytest.mark.parametrize("seed", range(6))
def test_simplex_weights_beat_a_grid(seed):
    rng = np.random.default_rng(seed)
    k = 3
    x = rng.random((200, k)) @ (np.eye(k) + 0.8 * rng.random((k, k)))
    y = x @ rng.normal(0, 1, k)
    a, b = x.T @ x / 200, x.T @ y / 200
    w = st.on_simplex(a, b)
    value = lambda v: v @ a @ v / 2 - b @ v
    grid = [np.array([i, j, 40 - i - j]) / 40 for i, j in itertools.product(range(41), repeat=2) if i + j <= 40]
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and value(w) <= min(map(value, grid)) + 1e-9


def test_simplex_with_equal_and_constant_scores():
    x = np.array([[0.1, 0.1, 0.0], [0.9, 0.9, 0.0], [0.4, 0.4, 0.0]])
    w = st.on_simplex(x.T @ x / 3, x.T @ np.array([0.0, 1.0, 0.5]) / 3)
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and w[2] == pytest.approx(0, abs=1e-9)


def test_second_level_walk_forward(spark):
    pdf = sample(1500, seed=4)
    splits = [(0, 0.0, 500.0, 500.0, 1000.0), (1, 0.0, 1000.0, 1000.0, 1500.0)]
    df, scores = spark.createDataFrame(pdf), ["a", "b", "noise"]
    for r in st.fold_weights(df, scores, "y", "day", splits):
        train = pdf[pdf.day < splits[r["fold"]][2]]
        x, y = train[scores].to_numpy(), train.y.to_numpy()
        w = np.array(r["weights"])
        assert r["n_train"] == len(train) and r["n_pos"] == y.sum()
        assert w == pytest.approx(st.on_simplex(x.T @ x / len(x), x.T @ y / len(x)), abs=1e-6)
        assert r["blend"] == pytest.approx(np.mean((x @ w - y) ** 2)) and r["blend"] <= r["single"]
    for meta in ("isotonic", "weights"):
        p = st.walk_forward(df, scores, "y", "day", splits, meta).toPandas()
        assert len(p) == 1000 and p.prob.between(0, 1).all()
        for fold, g in p.groupby("fold"):
            assert auc(g.y.to_numpy(), g.prob.to_numpy()) > 0.55
    with pytest.raises(ValueError):
        st.walk_forward(df, scores, "y", "day", splits, "median")


def test_rows_are_sent_batch_wise_where_the_column_form_sends_them(spark):
    """The column form, an interpreted loop, was evaluated per row and permutation."""
    n = 500
    r = spark.range(n).selectExpr("id + 1 AS _rk", f"{n}L AS _n", "id * 0.5D AS a", "-id * 1.0D AS b", "'x' AS g")
    got = r.select("g", "_rk", "_n", "a", "b").mapInArrow(im._sent(["a", "b"], ["g"], 3), "g string, _draw long, _v double, _rk long")
    rows = spark.range(6).selectExpr("id AS _draw").crossJoin(r)
    to = im.shuffled(F.col("_rk") - 1, F.col("_n"), im.round_keys(F.col("_draw"))) + 1
    want = rows.select("g", "_draw", F.when(F.col("_draw") < 3, F.col("a")).otherwise(F.col("b")).alias("_v"), to.alias("_rk"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    s = sample(200).assign(_g="x")
    plan = im.permutation_importance(spark.createDataFrame(s), ["a"], "y", lambda d: d.withColumn("_s", F.lit(0.5)), "day", "k", repeats=2)
    assert "lambdafunction" not in plan._jdf.queryExecution().logical().toString()


def test_values_travel_packed_by_blocks(spark, monkeypatch):
    """Values moved as a row per row and draw through an equi join; blocks, keys, nulls and NaN must come out the same."""
    n, pairs = 1000, ["a", "b"]
    monkeypatch.setattr(im, "BLOCK", 64)
    monkeypatch.setattr(im, "HELD", 700)
    a = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN double('NaN') ELSE id * 1.0D END"
    r = spark.range(n).selectExpr("id % 3 AS g", "floor(id / 3) + 1 AS _rk", f"floor(({n - 1} - id % 3) / 3) + 1 AS _n", f"{a} AS a", "-id * 1.0D AS b")
    sent = [x for x in im._sent(pairs, ["g"], 2)(r.select("g", "_rk", "_n", "a", "b").toArrow().to_batches())]
    want = {}
    for b in sent:
        want.update({(x["g"], x["_draw"], x["_rk"]): x["_v"] for x in b.to_pylist()})
    assert len(want) == 4 * n
    packed = pa.Table.from_batches(list(im._packed(pairs, ["g"], 2)(r.select("g", "_rk", "_n", "a", "b").toArrow().to_batches())))
    rows = r.selectExpr("*", "(_rk - 1) div 64 AS _block", "_rk AS place").toArrow()
    seen = 0
    for g in range(3):
        for block in range(6):
            part = lambda t: t.filter((pc.field("g") == g) & (pc.field("_block") == block))
            for x in im._unpacked(pairs, 2)(part(rows), part(packed)).to_pylist():
                if x["_draw"] >= 0:
                    seen += 1
                    assert repr(x[pairs[x["_draw"] // 2]]) == repr(want[g, x["_draw"], x["place"]])
    assert seen == 4 * n
    s = spark.createDataFrame(sample(200).assign(_g="x"))
    plan = im.permutation_importance(s, ["a"], "y", lambda d: d.withColumn("_s", F.round("a", 2)), "day", "k", repeats=2)
    assert {r["feature"] for r in plan.collect()} == {"a"}


def test_odd_residues():
    rng = np.random.default_rng(3)
    p = im.PRIME
    x = np.concatenate([rng.integers(0, 2 ** 62 + 2 ** 31, 10000), [0, 1, p - 1, p, p + 1, 2 * p, 2 * p + 1, p * p, p * p + 1, (p - 1) * (p - 1) + p - 1, 2 ** 62 + 2 ** 31 - 1, 2 ** 32 - 1, 2 ** 32]])
    assert (im._odd(x) == (x % p % 2 == 1)).all()
