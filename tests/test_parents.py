"""The search for nearest parents against every pair, and how much of the pairs it evaluates."""

import numpy as np
import pandas as pd
import pytest

from tremolite.plans import parents as pr, seismicity as se

DAY = 86400


def catalogue(n, seed=2, days=90, whole=False):
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 1 / 3
    t = np.where(hot, 20 * DAY + rng.exponential(3 * DAY, n), rng.random(n) * days * DAY)
    lat = np.where(hot, 36 + rng.normal(0, 0.2, n), 26 + 20 * rng.random(n))
    lon = np.where(hot, 140 + rng.normal(0, 0.2, n), 128 + 20 * rng.random(n))
    mag = 3 + rng.exponential(0.43, n)
    if whole:  # coarse values: many equal times, places and distances
        t, lat, lon, mag = np.round(t / DAY) * DAY, np.round(lat), np.round(lon), np.round(mag)
    return pd.DataFrame({"event_id": np.arange(n), "t": t, "lat": lat, "lon": lon, "mag": np.round(mag, 2)})


def every_pair(pdf, max_days=30.0):
    """Best (eta, parent) of each event over all others; ties to the latest, then the largest id."""
    t, lat, lon, mag, ids = (pdf[x].to_numpy() for x in ("t", "lat", "lon", "mag", "event_id"))
    out = {}
    for i in range(len(pdf)):
        dt = (t[i] - t) / DAY
        r = np.hypot((lat[i] - lat) * 111.32, (lon[i] - lon) * 111.32 * np.cos(np.radians(lat[i]))) + 0.1
        ok = np.flatnonzero((dt > 0) & (dt <= max_days))
        if len(ok):
            eta = dt[ok] * r[ok] ** 1.6 * 10 ** -mag[ok]
            near = ok[eta <= eta.min() * (1 + 1e-12)]
            out[int(ids[i])] = (eta.min(), max((t[k], ids[k]) for k in near)[1])
    return out


@pytest.mark.parametrize("n,whole,size", [(1500, False, 16), (1500, False, 256), (1200, True, 16)])
def test_search_equals_every_pair(spark, n, whole, size):
    pdf = catalogue(n, whole=whole)
    got = {r["event_id"]: (r["eta"], r["parent_id"]) for r in pr.bounded_parents(spark.createDataFrame(pdf), size=size).collect()}
    want = every_pair(pdf)
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], rel=1e-9) for k in want)
    if not whole:  # equal distances of coarse values differ in the last bit between the two formulas
        assert all(got[k][1] == want[k][1] for k in want)


def test_both_ways_agree(spark):
    df = spark.createDataFrame(catalogue(3000, seed=8, whole=True))
    cols = ["event_id", "parent_id", "eta", "parent_mag", "dt_days", "dist_km"]
    whole, search = se.nearest_parents(df).select(*cols), se.nearest_parents(df, crowd=100).select(*cols)
    assert whole.exceptAll(search).isEmpty() and search.exceptAll(whole).isEmpty()


def test_edges(spark):
    schema = "event_id long, t long, lat double, lon double, mag double"
    assert pr.parent_search(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 100, 35.0, 140.0, 4.0), (2, 100, 35.0, 140.0, 4.0), (3, 200, 35.0, 140.0, 3.0), (4, 200 + 31 * DAY, 35.0, 140.0, 3.0)]
    got = {r["event_id"]: r["parent_id"] for r in pr.bounded_parents(spark.createDataFrame(rows, schema)).collect()}
    assert got == {3: 2}  # the same moment is no parent, equal distances go to the largest id, 31 days are too old


def test_most_pairs_are_never_evaluated(spark):
    share = []
    for n in (4000, 16000):
        pdf = catalogue(n)
        t = np.sort(pdf.t.to_numpy())
        window = (np.arange(n) - np.searchsorted(t, t - 30 * DAY)).sum()
        seen = pr.parent_search(spark.createDataFrame(pdf), size=64).agg({"evaluated": "sum"}).first()[0]
        share.append(seen / window)
    assert share[1] < 0.12 and share[1] < share[0]  # and the share falls as the catalogue grows


def test_small_groups_and_small_batches(spark, monkeypatch):
    pdf = catalogue(1500, seed=5)
    want = every_pair(pdf)
    got = {r["event_id"]: (r["eta"], r["parent_id"]) for r in pr.parent_search(spark.createDataFrame(pdf), size=16, group=64).where("eta IS NOT NULL").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    # one group that takes its candidates in many batches
    monkeypatch.setattr(pr, "BATCH", 100)
    cols = {"t": "t", "event_id": "id", "lat": "lat", "lon": "lon", "mag": "mag"}
    piece = lambda part: {new: part[old].to_numpy() for old, new in cols.items()}
    parts = [pdf.iloc[i::10] for i in range(10)]
    rows = pd.DataFrame([{"grp": 1, "low": -1.0 if i < 2 else float(i), **piece(part)} for i, part in enumerate(parts)])
    out = pd.concat(pr._visited(pr._Rescaled(30.0, 1.0, 1.6))(iter([rows.iloc[:4], rows.iloc[4:]])))
    assert len(out) == len(parts[0]) + len(parts[1])
    assert all(want.get(r.event_id, (None, -1))[1] == r.parent_id for r in out.itertuples())


def test_events_without_magnitude_or_place(spark):
    schema = "event_id long, t long, lat double, lon double, mag double"
    rows = [(1, 100, 35.0, 140.0, 4.0), (2, 150, 35.0, 140.0, None), (3, 160, None, 140.0, 9.0), (4, 200, 35.0, 140.0, float("nan")), (5, 300, 35.0, 140.0, 3.0)]
    got = {r["event_id"]: r["parent_id"] for r in pr.bounded_parents(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: 1, 4: 1, 5: 1}


def test_evaluated_per_event_hardly_grows(spark):
    each = [pr.parent_search(spark.createDataFrame(catalogue(n)), size=64).agg({"evaluated": "sum"}).first()[0] / n for n in (4000, 16000)]
    assert each[1] < 1.25 * each[0] and max(each) < 100


def test_events_that_move_per_event_do_not_grow(spark, monkeypatch):
    """Whole windows sent every block of candidates to every block of children: the copies of an event grew with the catalogue."""
    def counted(kernel):
        def run(batches):
            for batch in batches:
                got = batch.t.map(len).groupby(batch.grp).sum()
                yield pd.DataFrame({"event_id": got.index, "eta": 0.0, "parent_t": 0.0, "parent_id": 0, "parent_mag": 0.0, "dt_days": 0.0, "dist_km": 0.0, "evaluated": got.to_numpy()})
        return run
    monkeypatch.setattr(pr, "_visited", counted)
    each = [pr.parent_search(spark.createDataFrame(catalogue(n)), size=64).agg({"evaluated": "sum"}).first()[0] / n for n in (2000, 16000)]
    assert each[1] < 1.1 * each[0] and max(each) <= 4.0  # the own bucket and the three before it, at most
