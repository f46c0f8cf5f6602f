import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tremolite.operators import metrics as mt, resample as rs
from tremolite.plans import models as md


def frame(spark, y, p):
    return spark.createDataFrame(pd.DataFrame({"y": np.array(y, dtype="int32"), "p": np.array(p, dtype=float)}))


def brute_auc(y, p):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_ties_and_symmetry(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    a = mt.roc_auc(frame(spark, y, p), "y", "p").first()["auc"]
    b = mt.roc_auc(frame(spark, y, -p), "y", "p").first()["auc"]
    assert a == pytest.approx(brute_auc(y, p)) and a + b == pytest.approx(1.0)


@pytest.mark.parametrize("y,p,want", [([1, 1], [0.2, 0.4], 0.5), ([0, 1], [0.1, 0.9], 1.0), ([1, 0], [0.1, 0.9], 0.0), ([1, 0], [0.5, 0.5], 0.5)])
def test_auc_edges(spark, y, p, want):
    assert mt.roc_auc(frame(spark, y, p), "y", "p").first()["auc"] == want


def test_molchan_of_a_perfect_ranking(spark):
    df = frame(spark, [1] * 2 + [0] * 8, list(range(10, 0, -1)))
    assert mt.molchan_skill(df, "y", "p").first()["molchan_skill"] == pytest.approx(0.8)


def test_thresholds(spark):
    r = {x["threshold"]: x for x in mt.threshold_skill(frame(spark, [1, 0, 1, 0], [0.9, 0.6, 0.4, 0.1]), "y", "p", [0.05, 0.5, 0.95]).collect()}
    assert (r[0.5]["tp"], r[0.5]["fp"], r[0.5]["fn"]) == (1, 1, 1) and r[0.05]["n_alarms"] == 4 and r[0.95]["n_alarms"] == 0
    assert r[0.95]["igpe_bits"] == -10 and r[0.5]["probability_gain"] == pytest.approx(1.0)


def test_mutual_information(spark):
    df = spark.createDataFrame([(0, 0)] * 5 + [(1, 1)] * 5, "a int, b int")
    assert mt.mutual_information(df, "a", "b").first()["mi_bits"] == pytest.approx(1.0)


def test_theil_sen(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + (100 if i == 7 else 0)) for i in range(9)], "x double, y double")
    assert rs.theil_sen(df, [], "x", "y").first()["slope"] == pytest.approx(3.0)


def test_bootstrap_weights_average_one(spark):
    w = rs.bootstrap(spark.range(2000).withColumnRenamed("id", "k"), [], "k", 50).groupBy("b").agg(F.sum("w").alias("s")).toPandas()
    assert len(w) == 50 and abs(w.s.mean() / 2000 - 1) < 0.02 and w.s.std() > 5


def test_splits_and_embargo(spark):
    s = md.walk_forward_splits(0, 8 * 365.25, 5, 1, 1)
    assert len(s) == 3 and s[0][2:4] == (5 * 365.25, 5 * 365.25)
    df = spark.createDataFrame([(float(d),) for d in (10, 1800, 1826, 1830, 2190, 2195)], "day double")
    got = {(r["day"], r["fold"]): r["part"] for r in md.assign_folds(df, "day", s[:1], embargo=34.0).collect()}
    assert got == {(10.0, 0): "train", (1830.0, 0): "test", (2190.0, 0): "test"}


def test_calibration_is_monotone(spark):
    rng = np.random.default_rng(4)
    p = rng.random(2000)
    pts = md.binned_calibration(frame(spark, (rng.random(2000) < p ** 2).astype(int), p), "y", "p", 20)
    xs, ys = zip(*pts)
    assert list(xs) == sorted(xs) and list(ys) == sorted(ys) and len(pts) == 20
    f = spark.createDataFrame([(-1.0,), ((xs[3] + xs[4]) / 2,), (2.0,)], "p double").select(md.interpolate(F.col("p"), pts).alias("q")).collect()
    assert [r["q"] for r in f] == pytest.approx([ys[0], (ys[3] + ys[4]) / 2, ys[-1]])


def test_rank_shares(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 500), "id": np.arange(500), "p": np.round(rng.random(500), 1), "q": rng.random(500)})
    pdf.loc[:9, "p"] = np.nan
    df = spark.createDataFrame(pdf.astype({"k": object}).where(pdf.k.notna(), None).assign(p=pdf.p, q=pdf.q, id=pdf.id), "k string, id long, p double, q double")
    got = {r["id"]: (r["rp"], r["rq"]) for r in mt.rank_shares(df, {"rp": "p", "rq": "q"}, ["k"]).collect()}
    want = pdf.assign(k=pdf.k.fillna("none")).groupby("k")[["p", "q"]].rank(method="average", pct=True)
    assert len(got) == 500
    for i, (p, q) in got.items():
        assert q == pytest.approx(want.q[i])
        assert (p is None) if np.isnan(want.p[i]) else p == pytest.approx(want.p[i])
    assert mt.rank_shares(df.where("false"), {"rp": "p"}).count() == 0


def test_fits_read_no_row_again_for_the_class_weight(spark):
    """The weight was a scalar subquery, evaluated in every pass of a fit, and folds an interpreted loop over their list."""
    df = spark.range(100).selectExpr("id", "cast(id % 4 = 0 AS int) AS label", "cast(id AS double) AS day")
    w = md.weighted(df, "label")
    assert {(r.label, r._w) for r in w.collect()} == {(0, 1.0), (1, 3.0)}
    folds = md.assign_folds(w, "day", [(0, 0.0, 40.0, 40.0, 60.0), (1, 0.0, 60.0, 60.0, 80.0)], 5.0)
    got = {(r.fold, r.part): (r.n, r.a, r.b) for r in folds.groupBy("fold", "part").agg(F.count("id").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    assert got == {(0, "train"): (35, 0, 34), (0, "test"): (20, 40, 59), (1, "train"): (55, 0, 54), (1, "test"): (20, 60, 79)}
    plan = folds._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" not in plan and "lambdafunction" not in plan


def test_logistic_scores_are_columns(spark):
    """A vector was built, scaled and scored per row; rows that lack a value stay NaN, constant features count nothing."""
    rng = np.random.default_rng(1)
    a, b = rng.random(400), rng.random(400)
    pdf = pd.DataFrame({"k": np.arange(400), "a": a, "b": b, "flat": 2.0, "y": (rng.random(400) < 0.15 + 0.6 * a + 0.1 * b).astype("int32")})
    df = spark.createDataFrame(pdf)
    model = md.logistic(["a", "b", "flat"], label="y").fit(md.weighted(df, "y"))
    odd = df.unionByName(df.where("k < 3").withColumn("b", F.when(F.col("k") > 0, F.lit(float("nan")))))
    got = md.probability(model, odd, "s")
    assert "UDF" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = model.transform(odd).select("k", "b", vector_to_array("probability")[1].alias("s"))
    key = lambda r: (r["k"], repr(r["b"]))
    for x, y in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key)):
        assert x["s"] == pytest.approx(y["s"], abs=1e-12, nan_ok=True)
