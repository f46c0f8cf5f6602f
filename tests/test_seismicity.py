"""Declustering, trees, cycles and features against sequential twins on small skewed catalogues."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremolite.operators import aggregates as ag, expand as ex
from tremolite.plans import features as ft, seismicity as se

DAY = 86400


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = np.random.default_rng(5)
    n = 500
    hot = rng.random(n) < 0.4
    t = np.where(hot, rng.integers(60 * DAY, 75 * DAY, n), rng.integers(0, 300 * DAY, n)) + 9131 * DAY
    pdf = pd.DataFrame({"event_id": np.arange(n), "t": t, "lat": np.where(hot, 36 + rng.random(n) * 0.5, 26 + 20 * rng.random(n)),
                        "lon": np.where(hot, 140 + rng.random(n) * 0.5, 128 + 20 * rng.random(n)), "mag": np.round(3 + rng.exponential(0.6, n), 2), "depth_km": rng.integers(1, 90, n).astype(float)})
    pdf.loc[5, "t"] = pdf.loc[6, "t"]
    df = spark.createDataFrame(pdf).withColumns({"ci": F.bround(F.col("lat") / 2).cast("int"), "cj": F.bround(F.col("lon") / 2).cast("int"), "dn": F.floor(F.col("t") / DAY)})
    pdf["ci"], pdf["cj"], pdf["dn"] = [round(x / 2) for x in pdf.lat], [round(x / 2) for x in pdf.lon], pdf.t // DAY
    return pdf, df


def brute_parents(pdf):
    out = {}
    ev = pdf.sort_values(["t", "event_id"])
    for a in ev.itertuples():
        best = None
        for b in ev.itertuples():
            dt = (a.t - b.t) / DAY
            if 0 < dt <= 30:
                r = math.hypot((a.lat - b.lat) * 111.32, (a.lon - b.lon) * 111.32 * math.cos(math.radians(a.lat))) + 0.1
                eta = dt * r ** 1.6 * 10 ** (-b.mag)
                if best is None or eta <= best[0]:
                    best = (eta, b.event_id)
        if best:
            out[a.event_id] = best
    return out


def test_nearest_parents_small_blocks(catalogue):
    pdf, df = catalogue
    got = {r["event_id"]: (r["eta"], r["parent_id"]) for r in se.nearest_parents(df, block=16).collect()}
    want = brute_parents(pdf)
    assert got.keys() == want.keys()
    for k, (eta, parent) in want.items():
        assert got[k][0] == pytest.approx(eta, rel=1e-9) and got[k][1] == parent


def test_roots_of_a_chain(spark):
    rows = [(i, i - 1 if i else None, "clustered" if i else "background") for i in range(40)] + [(100, 3, "background")]
    df = spark.createDataFrame(rows, "event_id long, parent_id long, cluster_class string")
    got = {r["event_id"]: r["root"] for r in se.sequence_roots(df).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 100}


def test_valley_between_two_modes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-6, 0.5, 2000), rng.normal(-1, 0.5, 2000)])
    r = se.valley(spark.createDataFrame(pd.DataFrame({"x": x})), "x").first()
    assert 16 <= r["valley_bin"] <= 31 and -4.7 < r["threshold"] < -2.3


def test_cycles_and_scores(catalogue):
    pdf, df = catalogue
    cycles, want = {}, {}
    for key, g in pdf.sort_values(["t", "event_id"]).groupby(["ci", "cj"]):
        k = 0
        for e in g.itertuples():
            if e.mag >= 5:
                if k:
                    cycles.setdefault(key, []).append(k)
                    want[e.event_id] = (key, k)
                k = 0
            else:
                k += 1
    every = [k for c in cycles.values() for k in c]
    got = {r["event_id"]: r["eps"] for r in se.potential_scores(df, ["ci", "cj"]).collect()}
    assert got.keys() == want.keys()
    for e, (key, k) in want.items():
        ref = cycles[key] if len(cycles[key]) >= 5 else every
        assert got[e] == pytest.approx(100 * sum(x < k for x in ref) / len(ref))


def test_kappa(spark):
    m = [3.0, 4.0, 3.5, 5.0, 3.2, 4.4, 3.9]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(m)], "k int, t long, mag double")
    q, chi = 10 ** (1.5 * np.array(m)), (np.arange(7) + 1) / 7
    want = (q * chi ** 2).sum() / q.sum() - ((q * chi).sum() / q.sum()) ** 2
    assert ag.kappa1(df, ["k"], "t", [], "mag").first()["kappa1"] == pytest.approx(want)


STEPS = list(range(9131 + 30, 9131 + 300, 3))


def slope(v):
    n = len(v)
    return 0.0 if n < 3 else float(np.polyfit(np.arange(n), v, 1)[0])


def sequential_features(pdf, cell):
    """Step-by-step twin of the catalogue features of one cell, history kept in plain lists."""
    ev = pdf[(pdf.ci == cell[0]) & (pdf.cj == cell[1])].sort_values(["t", "event_id"])
    days = max((pdf.t.max() - pdf.t.min()) / DAY, 1)
    lt = len(ev) / days if len(ev) else 0.01
    rates, bs, out = [], [], {}
    for s in STEPS:
        w = lambda a, b: ev[(ev.t >= (s - a) * DAY) & (ev.t < (s - b) * DAY)]
        e7, e30, e90 = w(7, 0), w(30, 0), w(90, 0)
        b = 1.0
        if len(e90) >= 20 and e90.mag.mean() - 2.95 > 0.01:
            b = math.log10(math.e) / (e90.mag.mean() - 2.95)
        rates.append(len(e7))
        bs.append(b)
        gap = np.diff(np.sort(e30.t.to_numpy())) / DAY
        gap = gap[gap > 0]
        h = rates[-240:]
        d = np.diff(h)
        m5 = ev[(ev.t < s * DAY) & (ev.mag >= 5)]
        out[s] = {
            "rate_7d": len(e7), "rate_ratio_30d": len(e30) / max(lt * 30, 0.1), "rate_accel_7d": (len(e7) - len(w(14, 7))) / 7, "rate_trend_slope": slope(rates[-9:]),
            "max_mag_30d": e30.mag.max() if len(e30) else 0.0, "b_value": b, "b_value_trend": slope(bs[-6:]),
            "mag_deficit": 3 + math.log10(max(len(e30), 1)) / max(b, 0.5) - e30.mag.max() if len(e30) else 0.0,
            "foreshock_mag_increase": (w(3, 0).mag.max() if len(w(3, 0)) else 0) - (w(6, 3).mag.max() if len(w(6, 3)) else 0),
            "inter_event_cv": gap.std() / max(gap.mean(), 1e-6) if len(gap) >= 3 else 1.0, "cluster_fraction": (gap < 1).sum() / max(len(e30) - 1, 1) if len(e30) >= 2 else 0.0,
            "pi_score": float(d.var()) if len(h) >= 4 else 0.0, "pi_trend": np.mean(h[-3:]) - np.mean(h[-6:-3]) if len(h) >= 6 else 0.0,
            "benioff_strain_30d": (10 ** (0.75 * e30.mag + 2.4)).sum(), "days_since_m5": (s * DAY - m5.t.max()) / DAY if len(m5) else 9999.0}
    return out


def grid_of(spark):
    return ex.with_steps(ex.cell_grid(spark, (13, 23), (64, 74)), STEPS[0], STEPS[-1], 3)


def test_features_equal_sequential_twin(spark, catalogue):
    pdf, df = catalogue
    x = ft.catalogue_features(ft.windows_at_steps(ft.cell_day_table(df), grid_of(spark)), ft.long_term_rates(df))
    counts = pdf.groupby(["ci", "cj"]).size().sort_values()
    cells = [counts.index[-1], counts.index[len(counts) // 2], counts.index[0]]
    got = x.where(" OR ".join(f"(ci = {i} AND cj = {j})" for i, j in cells)).toPandas()
    for cell in cells:
        want = sequential_features(pdf, cell)
        part = got[(got.ci == cell[0]) & (got.cj == cell[1])].set_index("step")
        assert len(part) == len(STEPS)
        for s, feats in want.items():
            for name, v in feats.items():
                assert part.loc[s, name] == pytest.approx(v, rel=1e-6, abs=1e-6), (cell, s, name)


def test_no_look_ahead(spark, catalogue):
    _, df = catalogue
    cut = STEPS[40]
    table = lambda d: ft.windows_at_steps(ft.cell_day_table(d), grid_of(spark)).where(F.col("step") <= cut).toPandas().sort_values(["ci", "cj", "step"])
    a, b = table(df), table(df.where(F.col("t") < cut * DAY))
    # only the order of floating sums may differ
    assert np.allclose(a.astype(float), b.astype(float), rtol=1e-9, equal_nan=True)


def test_triggering_counts_all_events(spark, catalogue):
    """All events before the window count, over as many blocks as the cell needs."""
    pdf, df = catalogue
    grid = grid_of(spark).where(f"step = {STEPS[-1]}")
    got = {(r["ci"], r["cj"]): r["_x7"] for r in ft.triggering_expected(df, grid, block=5).collect()}
    t0 = STEPS[-1] - 7
    for cell, g in pdf[pdf.t < t0 * DAY].sort_values(["t", "event_id"]).groupby(["ci", "cj"]):
        want = sum(0.04 * math.exp(e.mag - 3) / (t0 + k + 0.5 - e.t / DAY + 0.01) ** 1.1 for e in g.itertuples() for k in range(7))
        assert got[cell] == pytest.approx(want)
