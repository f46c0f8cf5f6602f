"""The triggering fit against brute force and against a simulated catalogue."""

import math

import numpy as np
import pandas as pd
import pytest

from tremolite.plans import trigger_fit as tf


def plain(day, mag, theta):
    """Log-likelihood by the double sum."""
    mu, k, alpha, cc, p = math.exp(theta[0]), math.exp(theta[1]), theta[2], math.exp(theta[3]), theta[4]
    t = np.sort(day) - day.min()
    w = np.exp(alpha * (mag[np.argsort(day, kind="stable")] - 3))
    age = t[:, None] - t[None, :]
    lam = mu + k * (np.where(age > 0, (np.maximum(age, 0) + cc) ** -p, 0) * w[None, :]).sum(1)
    end = t[-1]
    return np.log(lam).sum() - mu * end - (k * w * ((end - t + cc) ** (1 - p) - cc ** (1 - p)) / (1 - p)).sum()


def simulate(seed, mu, k, alpha, cc, p, days):
    rng = np.random.default_rng(seed)
    todo = [(t, 3 + rng.exponential(1 / 2.3)) for t in rng.uniform(0, days, rng.poisson(mu * days))]
    out = []
    while todo:
        t, m = todo.pop()
        out.append((t, m))
        n = rng.poisson(k * math.exp(alpha * (m - 3)) * cc ** (1 - p) / (p - 1))
        wait = cc * (rng.uniform(size=n) ** (1 / (1 - p)) - 1)
        todo += [(t + x, 3 + rng.exponential(1 / 2.3)) for x in wait if t + x < days]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(z, float(t), float(m)) for z, t, m in rows], "zone string, day double, mag double").repartition(5)


def test_value_and_gradient(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = [("a", t, m) for t, m in simulate(2, 0.5, 0.02, 1.2, 0.02, 1.2, 900)]
    burst = np.r_[rng.uniform(0, 400, 150), 200 + rng.exponential(0.5, 300), [200.0] * 5]
    b = [("b", t, 3 + rng.exponential(0.4)) for t in burst]
    events = frame(spark, a + b)
    spans = tf.zone_spans(events)
    monkeypatch.setattr(tf, "BLOCK_LEVELS", 3)  # many blocks
    like = tf.Likelihood(events, spans)
    points = {"a": np.array([math.log(0.4), math.log(0.03), 1.1, math.log(0.03), 1.3]), "b": np.array([math.log(0.2), math.log(0.01), 0.7, math.log(0.005), 1.01])}
    got = like(points)
    worst = 0.0
    for z, rows in (("a", a), ("b", b)):
        day, mag = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        want = plain(day, mag, points[z])
        worst = max(worst, abs(got[z][0] - want) / abs(want))
        for i in range(5):
            h = np.zeros(5)
            h[i] = 1e-5
            slope = (plain(day, mag, points[z] + h) - plain(day, mag, points[z] - h)) / 2e-5
            assert got[z][1][i] == pytest.approx(slope, rel=1e-4, abs=1e-3)
        info = got[z][2]
        assert np.allclose(info, info.T) and (np.linalg.eigvalsh(info) > -1e-9).all()
    assert worst < 1e-8 and like.levels > 6


def test_recovers_a_simulated_catalogue(spark):
    true = dict(mu=0.6, K=0.02, alpha=1.0, c=0.02, p=1.25)
    rows = [("z", t, m) for t, m in simulate(5, *true.values(), 6000)]
    few = [("few", float(i), 3.5) for i in range(50)]
    got = {r["zone"]: r for r in tf.fit_zones(frame(spark, rows + few)).collect()}
    z = got["z"]
    assert z["fitted"] and not got["few"]["fitted"] and got["few"]["n_events"] == 50
    day, mag = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    theta = np.array([math.log(z["mu"]), math.log(z["K"]), z["alpha"], math.log(z["c"]), z["p"]])
    best = plain(day, mag, theta)
    assert -z["nll"] == pytest.approx(best, rel=1e-7)
    # the truth is as likely as a sample of this size allows: twice the difference follows chi squared with 5 degrees (99.9 %: 20.5)
    at_truth = plain(day, mag, np.array([math.log(true["mu"]), math.log(true["K"]), true["alpha"], math.log(true["c"]), true["p"]]))
    assert 0 <= 2 * (best - at_truth) < 20.5
    for i in range(5):  # a maximum in every direction
        for h in (-0.02, 0.02):
            other = theta.copy()
            other[i] += h
            assert plain(day, mag, other) <= best + 1e-6


def test_empty(spark):
    none = spark.createDataFrame([], "zone string, day double, mag double")
    assert tf.fit_zones(none).count() == 0 and tf.likelihood_at_start(none).count() == 0


def test_zone_parameters_feed_the_expected_counts(spark):
    from tremolite.functions import physics as ph, spatial as sp
    from tremolite.plans import features as ft

    rng = np.random.default_rng(3)
    cells = [(18, 71), (13, 64), (21, 71)]
    rows = [(i, ci, cj, int(t * 86400), int(t), float(3 + rng.exponential(0.4))) for i, (t, (ci, cj)) in enumerate((t, cells[i % 3]) for i, t in enumerate(rng.uniform(0, 200, 120)))]
    quakes = spark.createDataFrame(rows, "event_id long, ci int, cj int, t long, dn long, mag double")
    grid = spark.createDataFrame([(ci, cj, s) for ci, cj in cells for s in range(30, 200, 10)], "ci int, cj int, step long")
    zones = {(r["ci"], r["cj"]): r["z"] for r in grid.select("ci", "cj", sp.zone_of(grid["ci"] * 2.0, grid["cj"] * 2.0).alias("z")).distinct().collect()}
    assert len(set(zones.values())) > 1
    fitted = {zones[cells[0]]: {"K": 0.1, "alpha": 0.5, "c": 0.3, "p": 1.4, "mc": 3.0}}
    got = {(r["ci"], r["cj"], r["step"]): (r["_x7"], r["_x30"]) for r in ft.triggering_expected(quakes, grid, zone_params=fitted).collect()}
    for (ci, cj, step), found in got.items():
        par = fitted.get(zones[ci, cj], ph.TRIGGER)
        for w, x in zip((7, 30), found, strict=True):
            want = sum(par["K"] * math.exp(par["alpha"] * (m - par["mc"])) * sum((step - w - t / 86400 + w * (k + 0.5) / 7 + par["c"]) ** -par["p"] for k in range(7)) * w / 7
                       for _, i, j, t, d, m in rows if (i, j) == (ci, cj) and d < step - w)
            assert (x or 0) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_a_pass_gathers_few_cells_and_keeps_their_sums(spark):
    """20,000 events in mixed order: a pass once sent a row per event and level of its batch, now only cells of the coarse levels leave the blocks."""
    rng = np.random.default_rng(7)
    rows = [("z", t, 3 + m) for t, m in zip(rng.uniform(0, 2000, 20000), rng.exponential(0.4, 20000), strict=True)]
    events = frame(spark, rows)
    like = tf.Likelihood(events, tf.zone_spans(events))
    point = tf.start_point(20000, 2000.0)
    far = like._far(like.blocks, {"z": point})["z"]
    held = [x for x in far if x is not None]
    assert len(held) == like.levels - like.coarse and len(held[0][0]) <= min(tf.COARSE, 4 * like.blocks.count())
    weight = np.exp(point[2] * (np.array([m for _, _, m in rows]) - 3))
    t = np.array([t for _, t, _ in rows]) - min(t for _, t, _ in rows)
    for level, (cells, m, _) in zip(range(like.coarse, like.levels), held, strict=True):
        size = like.width * 2.0 ** level
        power = (((np.floor(t / size) + 0.5) * size - t) / (size / 2))[:, None] ** np.arange(tf.ORDER)
        assert m.sum(0) == pytest.approx((weight[:, None] * power).sum(0), rel=1e-9, abs=1e-6)


def test_a_block_forms_moments_once_and_evaluates_one_series(monkeypatch):
    """Events enter moments once per pass, not once per level, and no event meets the cells of all levels; the sums are those of all pairs."""
    rng = np.random.default_rng(9)
    width, coarse, levels = 2.0 ** -4, 7, 8
    t, mag = np.r_[0.0, np.sort(rng.uniform(0, (2 << coarse) * width, 2999))], 3 + rng.exponential(0.4, 3000)
    theta = np.array([math.log(0.5), math.log(0.03), 1.1, math.log(0.03), 1.3])
    seen, met = [], []
    real, far = tf.mo.cell_moments, tf._far_sums
    monkeypatch.setattr(tf.mo, "cell_moments", lambda t, *rest: seen.append(len(t)) or real(t, *rest))
    monkeypatch.setattr(tf, "_far_sums", lambda t, cell, cells, series, *rest: met.append((len(t), series.shape)) or far(t, cell, cells, series, *rest))
    run = tf._block({"z": theta}, {"z": (3000, 0.0, t[-1])}, width, levels, coarse, {})
    got, = run(iter([pd.DataFrame({"zone": ["z"], "block": [0], "t": [t], "mag": [mag]})]))
    assert seen == [3000] and met == [(3000, (len(np.unique(t // width)), 3, tf.ORDER))]
    assert got["x"][0] - 0.5 * t[-1] == pytest.approx(plain(t, mag, theta), rel=1e-8)


def test_expected_counts_meet_moments_instead_of_events(spark, monkeypatch):
    """Probes once met every earlier event of their cell; now a cell of any number of events is no more than its calendar, and the counts are those of all events."""
    from tremolite.functions import physics as ph
    from tremolite.plans import features as ft

    met, real = spark.sparkContext.accumulator(0), ft._kernel_sums

    def counted(*args):
        inner = real(*args)

        def run(batches):
            def seen():
                for batch in batches:
                    arrays = [np.concatenate([np.atleast_1d(y) for y in x]) for name in batch.columns for x in batch[name] if isinstance(x, (list, np.ndarray))]
                    met.add(sum(map(len, arrays)))
                    yield batch
            yield from inner(seen())
        return run
    monkeypatch.setattr(ft, "_kernel_sums", counted)
    rng = np.random.default_rng(6)
    t = np.sort(np.r_[rng.integers(700 * 86400, 704 * 86400, 20000), [3 * 86400, 86400 * 9 - 1, 86400 * 9, 400 * 86400 + 5]])
    mag = 3 + rng.exponential(0.4, len(t))
    quakes = spark.createDataFrame([(i, 13, 64, int(a), int(a // 86400), float(m)) for i, (a, m) in enumerate(zip(t, mag))], "event_id long, ci int, cj int, t long, dn long, mag double")
    steps = [8, 10, 11, 16, 39, 40, 500, 708, 711, 712, 740, 2400]
    grid = spark.createDataFrame([(13, 64, s) for s in steps], "ci int, cj int, step long")
    got = {r["step"]: r for r in ft.triggering_expected(quakes, grid).collect()}
    assert set(got) == set(steps) - {8, 10}  # nothing lies before the windows of the first two
    for s, r in got.items():
        for w in (7, 30):
            before = t < (s - w) * 86400
            age = s - w - t[before, None] / 86400 + w * (np.arange(7) + 0.5) / 7 + ph.TRIGGER["c"]
            want = (ph.TRIGGER["K"] * np.exp(mag[before] - 3)[:, None] * age ** -ph.TRIGGER["p"]).sum() * w / 7
            assert (r[f"_x{w}"] or 0) == pytest.approx(want, rel=1e-10, abs=0), (s, w)
    assert met.value < 2000


def test_a_burst_is_cut_into_narrow_cells(spark):
    """Cells once followed the mean rate alone, so the events of a burst met each other pair by pair."""
    rng = np.random.default_rng(10)
    t = np.r_[0.0, rng.uniform(0, 2000, 1000), 1000 + rng.exponential(0.5, 3000), 2000.0]
    mag = 3 + rng.exponential(0.4, len(t))
    events = frame(spark, [("z", a, m) for a, m in zip(t, mag)])
    like = tf.Likelihood(events, tf.zone_spans(events))
    inside = np.unique(np.floor(t / like.width), return_counts=True)[1]
    assert (inside ** 2).sum() / len(t) < 4 * tf.PER_CELL
    point = tf.start_point(len(t), 2000.0)
    assert like({"z": point})["z"][0] == pytest.approx(plain(t, mag, point), rel=1e-8)
