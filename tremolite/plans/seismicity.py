"""Declustering, triggering trees, cycles, pattern scores and forecasts over event catalogues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import physics as ph, spatial as sp
from ..operators import blocks as bl, joins as jn, ordered as od
from ..session import checkpoint_root
from . import parents as pr

c, lit = F.col, F.lit
DAY = 86400

_LINK = "event_id long, eta double, parent_t double, parent_id long, parent_mag double, dt_days double, dist_km double"


def _best_parents(max_days: float, b: float, d_frac: float):
    """Best parent of each child of a block among one block of candidates; rows in, one row per child out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                child_t, child_lat, child_lon = (np.asarray(x) for x in (row.c_t, row.c_lat, row.c_lon))
                p_t, p_lat, p_lon, p_mag = (np.asarray(x) for x in (row.p_t, row.p_lat, row.p_lon, row.p_mag))
                p_id, c_id = np.asarray(row.p_id), np.asarray(row.c_id)
                weight = 10.0 ** (-b * p_mag)
                out = []
                for lo in range(0, len(c_id), 256):
                    part = slice(lo, lo + 256)
                    dt = (child_t[part, None] - p_t[None, :]) / DAY
                    dy = (child_lat[part, None] - p_lat[None, :]) * sp.DEG_KM
                    dx = (child_lon[part, None] - p_lon[None, :]) * sp.DEG_KM * np.cos(np.radians(child_lat[part]))[:, None]
                    r = np.sqrt(dy * dy + dx * dx) + 0.1
                    with np.errstate(invalid="ignore"):
                        eta = np.where((dt > 0) & (dt <= max_days), dt * r ** d_frac * weight[None, :], np.inf)
                    # candidates are in time order: the last of equal minima is the latest parent
                    k = eta.shape[1] - 1 - np.argmin(eta[:, ::-1], axis=1)
                    i = np.arange(eta.shape[0])
                    ok = np.isfinite(eta[i, k])
                    i, k = i[ok], k[ok]
                    out.append(pd.DataFrame({"event_id": c_id[part][i], "eta": eta[i, k], "parent_t": p_t[k], "parent_id": p_id[k],
                                             "parent_mag": p_mag[k], "dt_days": dt[i, k], "dist_km": r[i, k]}))
                if out:
                    yield pd.concat(out, ignore_index=True)
    return run


def nearest_parents(events: DataFrame, max_days: float = 30.0, b: float = 1.0, d_frac: float = 1.6, block: int = 2048,
                    slots: int = 3, crowd: int = 2048) -> DataFrame:
    """The earlier event within `max_days` that minimises dt * r^d_frac * 10^(-b M), per event.

    Where a time bucket holds more than `crowd` events, `parents.bounded_parents` finds the same rows without evaluating whole
    windows; below that, whole windows are cheaper. Time is cut into max_days / slots buckets and a crowded bucket into hash blocks of about `block` rows, so one array
    row holds a bounded number of events. A child block meets the candidate blocks of its own and the earlier buckets;
    pairs are formed inside the task and only the best parent per child leaves it.
    """
    width = max_days * DAY / slots
    e = events.select("event_id", c("t").cast("double").alias("t"), "lat", "lon", "mag").withColumn("tb", F.floor(c("t") / lit(width)))
    count = e.groupBy("tb").agg(F.count(lit(1)).alias("n"))
    if (count.agg(F.max("n")).first()[0] or 0) > crowd:
        return pr.bounded_parents(events, max_days, b, d_frac, slots=slots)
    size = count.select("tb", F.ceil(c("n") / lit(float(block))).alias("nb"))
    e = e.join(size, "tb").withColumn("blk", F.pmod(F.xxhash64("event_id"), c("nb")))
    rows = e.groupBy("tb", "blk").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "lat", "lon", "mag"))).alias("rows"))
    child = rows.select("tb", c("rows.event_id").alias("c_id"), c("rows.t").alias("c_t"), c("rows.lat").alias("c_lat"), c("rows.lon").alias("c_lon"))
    cand = rows.select(F.explode(F.sequence(c("tb"), c("tb") + slots)).alias("tb"), c("rows.event_id").alias("p_id"), c("rows.t").alias("p_t"),
                       c("rows.lat").alias("p_lat"), c("rows.lon").alias("p_lon"), c("rows.mag").alias("p_mag"))
    pairs = child.join(cand, "tb").drop("tb")
    found = pairs.mapInPandas(_best_parents(max_days, b, d_frac), _LINK)
    best = found.groupBy("event_id").agg(F.min(F.struct("eta", (-c("parent_t")).alias("nt"), (-c("parent_id")).alias("nid"), "parent_mag", "dt_days", "dist_km")).alias("m"))
    return best.select("event_id", (-c("m.nid")).alias("parent_id"), c("m.eta").alias("eta"), F.log10(F.greatest(c("m.eta"), lit(1e-20))).alias("log_eta"),
                       c("m.parent_mag").alias("parent_mag"), c("m.dt_days").alias("dt_days"), c("m.dist_km").alias("dist_km"))


def valley(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """One row: the smoothed-histogram minimum of the middle third, as a threshold between two modes."""
    lo, hi = df.select(F.min(value)).scalar(), df.select(F.max(value)).scalar()
    b = F.least(F.floor((c(value) - lo) / ((hi - lo) / lit(float(bins)))), lit(bins - 1)).cast("int")
    h = df.groupBy(b.alias("bin")).agg(F.count(lit(1)).alias("k"))
    dense = df.sparkSession.range(bins).select(c("id").cast("int").alias("bin")).join(h, "bin", "left").withColumn("k", F.coalesce("k", lit(0)))
    w = W.partitionBy(lit(0)).orderBy("bin").rowsBetween(-2, 2)  # `bins` rows
    s = dense.withColumn("smooth", F.sum("k").over(w) / lit(5.0))
    third = bins // 3
    low = s.where(c("bin").between(third, 2 * third - 1)).agg(F.min_by("bin", F.struct("smooth", "bin")).alias("bin"))
    return low.select(c("bin").alias("valley_bin"), (lo + (c("bin") + 0.5) * ((hi - lo) / lit(float(bins)))).alias("threshold"))


def decluster(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events with their parent and class; an event without a parent is background."""
    limit = valley(links, "log_eta").select("threshold").scalar()
    e = events.join(links.select("event_id", "parent_id", "log_eta"), "event_id", "left")
    return e.withColumn("cluster_class", F.when(c("log_eta") < limit, "clustered").otherwise("background"))


def sequence_roots(classed: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Root of every event by pointer doubling: each round halves the distance to the root.

    Finished rows leave the loop; only events whose pointer is not a root yet are joined again. Lineage is cut with a
    reliable checkpoint in the session's shared folder.
    """
    checkpoint_root(classed.sparkSession)
    links = classed.select("event_id", F.when(c("cluster_class") == "clustered", c("parent_id")).otherwise(c("event_id")).alias("up"))
    links = links.withColumn("done", (c("up") == c("event_id"))).checkpoint()
    for _ in range(max_rounds):
        target = links.select(c("event_id").alias("up"), c("up").alias("up2"), c("done").alias("done2"))
        moving = links.where(~c("done")).join(target, "up")
        # a pointer that lands on a finished row has its root: that row points at it
        step = moving.select("event_id", c("up2").alias("up"), c("done2").alias("done"))
        links = links.where("done").unionByName(step).checkpoint()
        if links.where(~c("done")).isEmpty():
            return links.select("event_id", c("up").alias("root"))
    raise RuntimeError("parent links contain a cycle")


def foreshocks(classed: DataFrame, roots: DataFrame, min_mag: float = 5.0) -> DataFrame:
    """Earlier members of each target's sequence: count, largest and mean magnitude, duration.

    Running sums along the sequence replace target x member pairs, so a sequence with a third of all events is fine.
    """
    m = classed.select("event_id", "t", "mag", "cluster_class").join(roots, "event_id")
    r = od.running(m, ["root"], "t", {"n_foreshocks": lit(1).cast("long"), "_s": c("mag")}, ["event_id"], maxes={"max_foreshock_mag": c("mag")}, include_current=False)
    start = m.groupBy("root").agg(F.min("t").alias("_t0"))
    out = r.where(c("mag") >= min_mag).join(start, "root")
    n = c("n_foreshocks")
    return out.select("event_id", "root", "cluster_class", n, "max_foreshock_mag", F.when(n > 0, c("_s") / n).alias("mean_foreshock_mag"),
                      F.when(n > 0, (c("t") - c("_t0")) / lit(float(DAY))).otherwise(0.0).alias("duration_days"))


def cycles(quakes: DataFrame, cell: list[str], min_mag: float = 5.0) -> DataFrame:
    """Number of small events between consecutive large ones per cell, plus the open cycle (`closed` = 0)."""
    big = c("mag") >= min_mag
    r = od.running(quakes.select(*cell, "t", "event_id", "mag"), cell, "t", {"cyc": F.when(big, 1).otherwise(0).cast("long")}, ["event_id"], include_current=False, totals=True)
    g = r.groupBy(*cell, "cyc").agg(F.count_if(~big).alias("n"), F.max(big.cast("int")).alias("closed"))
    return g.where("n > 0")


def potential_scores(quakes: DataFrame, cell: list[str], min_mag: float = 5.0, min_cycles: int = 5) -> DataFrame:
    """Share of past cycle lengths below the running count, for each large event; the cell's cycles, or all when it has few."""
    big = c("mag") >= min_mag
    q = od.running(quakes.select(*cell, "t", "event_id", "mag"), cell, "t", {"cyc": F.when(big, 1).otherwise(0).cast("long")}, ["event_id"], include_current=False)
    small = q.groupBy(*cell, "cyc").agg(F.count_if(~big).alias("count"), F.max_by("event_id", F.when(big, 1)).alias("event_id"))
    targets = small.where("event_id IS NOT NULL AND count > 0").select(*cell, "event_id", "count")
    # lengths collapse to a histogram; shares are running sums over it
    lens = targets.groupBy(*cell, c("count").alias("len")).agg(F.count(lit(1)).alias("k"))
    per_cell = od.running(lens, cell, "len", {"below": c("k")}, totals=True, include_current=False).select(*cell, c("len").alias("count"), "below", "below_total")
    allh = lens.groupBy("len").agg(F.sum("k").alias("k"))
    overall = od.running(allh, [], "len", {"ab": c("k")}, totals=True, include_current=False).select(c("len").alias("count"), "ab", "ab_total")
    j = targets.join(per_cell, [*cell, "count"]).join(overall, "count")
    own = c("below_total") >= min_cycles
    return j.select("event_id", *cell, "count", F.when(own, c("below") / c("below_total")).otherwise(c("ab") / c("ab_total")).alias("_e")).withColumn("eps", 100 * c("_e")).drop("_e")


def load_ratio(targets: DataFrame, quakes: DataFrame, days: int = 90, radius: float = 2.0, alpha: float = 0.7, min_n: int = 10) -> DataFrame:
    """Loading over unloading energy before each target; phase from the mean lunar hour angle and the regional strike."""
    strike = F.when(c("depth_km") > 70, 200.0).when((c("lon") > 142) & (c("lat") > 35), 200.0).when((c("lon") < 137) & (c("lat") < 35), 240.0).otherwise(200.0)
    en, load = ph.p10(lit(alpha) * c("mag")), ph.tidal_loading(c("t"), c("lon"), strike)
    e = quakes.select("event_id", "t", "lat", "lon", F.when(load, en).otherwise(0.0).alias("l"), F.when(~load, en).otherwise(0.0).alias("u"))
    g = bl.window_sums(targets, e, ["event_id"], [days], radius, ["l", "u"]).select("event_id", c(f"n{days}").alias("n"), c(f"sum_l{days}").alias("l"), c(f"sum_u{days}").alias("u"))
    return g.where(c("n") >= min_n).where("u >= 1e-10").select("event_id", "n", (c("l") / c("u")).alias("lurr"))


def pattern_scores(events: DataFrame, cell: list[str], x: str, base: tuple, anomaly: tuple, subs: int = 5, weight=None) -> DataFrame:
    """Variance of the normalised rate change of the anomaly period against `subs` base windows, per active cell."""
    b0, b1 = base
    width = (b1 - b0) / subs
    val = weight if weight is not None else lit(1.0)
    sub = F.when((c(x) >= b0) & (c(x) < b1), F.least(F.floor((c(x) - b0) / lit(width)), lit(subs - 1)).cast("int"))
    act = events.where((c(x) >= b0) & (c(x) < anomaly[1]))
    g = act.groupBy(*cell).agg(*[(F.sum(F.when(sub == i, val).otherwise(0.0)) / lit(width)).alias(f"_s{i}") for i in range(subs)],
                               (F.sum(F.when((c(x) >= anomaly[0]) & (c(x) < anomaly[1]), val).otherwise(0.0)) / lit(float(anomaly[1] - anomaly[0]))).alias("_a"))
    vals = [c(f"_s{i}") for i in range(subs)]
    mean = sum(vals[1:], vals[0]) / lit(float(subs))
    var = sum(((z - mean) * (z - mean) for z in vals[1:]), (vals[0] - mean) * (vals[0] - mean)) / lit(float(subs))
    sd = F.sqrt(var)
    sigma = F.when(sd >= 1e-12, sd).when(mean > 1e-12, mean)
    ds = [(c("_a") - z) / sigma for z in vals]
    m1 = sum(ds[1:], ds[0]) / lit(float(subs))
    m2 = sum((z * z for z in ds[1:]), ds[0] * ds[0]) / lit(float(subs))
    return g.withColumn("pi", m2 - m1 * m1).where("pi > 0").select(*cell, "pi")


def reference_forecasts(quakes: DataFrame, grid: DataFrame, start: int, window: int, t0: int, sigma: float = 2.0) -> DataFrame:
    """Uniform, kernel-smoothed, relative-intensity and simple triggered rates per cell for one test window.

    The catalogue is summed per cell (and recent M>=4 events meet only the cells within 3 degrees); the kernel joins the
    cell table with itself inside the fixed grid.
    """
    q = quakes.withColumn("day", (c("t") - t0) / lit(float(DAY))).where(c("day") < start)
    cell = q.groupBy("ci", "cj").agg(F.count_if(c("mag") >= 5).alias("m5"), F.count_if(c("mag") >= 3).alias("m3"))
    g = grid.join(cell, ["ci", "cj"], "left").select("ci", "cj", F.coalesce("m5", lit(0)).alias("m5"), F.coalesce("m3", lit(0)).alias("m3"))
    whole = W.partitionBy(lit(0))  # one row per grid cell
    g = g.withColumns({"tot5": F.sum("m5").over(whole), "tot3": F.sum("m3").over(whole), "cells": F.count(lit(1)).over(whole)})
    days = lit(float(max(start, 1)))
    src = g.where("m5 > 0").select(c("ci").alias("si"), c("cj").alias("sj"), c("m5").alias("k"))
    # the kernel has no cut: every source cell reaches the box around the grid, whose corners are scalars
    corner = lambda f, x: grid.select(f(x)).scalar()
    reach = src.select("si", "sj", "k", F.explode(F.sequence(corner(F.min, "ci"), corner(F.max, "ci"))).alias("ci"))
    reach = reach.select("*", F.explode(F.sequence(corner(F.min, "cj"), corner(F.max, "cj"))).alias("cj"))
    d2 = F.pow((c("ci") - c("si")) * 2.0, 2) + F.pow((c("cj") - c("sj")) * 2.0, 2)
    wt = F.exp(lit(-0.5) * d2 / lit(sigma * sigma))
    smooth = reach.groupBy("ci", "cj").agg((F.sum(wt * c("k")) / F.sum(wt)).alias("sm"))
    recent = q.where((c("mag") >= 4) & (c("day") > start - 365)).select("lat", "lon", "mag", "day", "ci", "cj")
    near = jn.neighbours(recent, k=2, include_self=True).where((F.abs(c("lat") - c("ni") * 2.0) <= 3) & (F.abs(c("lon") - c("nj") * 2.0) <= 3))
    age = lit(float(start)) - c("day")
    dist2 = F.pow(c("lat") - c("ni") * 2.0, 2) + F.pow(c("lon") - c("nj") * 2.0, 2)
    trig = near.groupBy(c("ni").alias("ci"), c("nj").alias("cj")).agg(
        F.sum(ph.omori_integral(c("mag"), age, age + lit(float(window))) * F.exp(lit(-0.5) * dist2)).alias("tr"))
    out = g.join(smooth, ["ci", "cj"], "left").join(trig, ["ci", "cj"], "left")
    w = lit(float(window))
    return out.select("ci", "cj", (c("tot5") / days * w / c("cells")).alias("uniform"), (F.coalesce("sm", lit(0.0)) / days * w).alias("smoothed"),
                      (c("m3") / F.greatest(c("tot3"), lit(1)) * (c("tot5") / days * w)).alias("relative_intensity"),
                      (c("m5") / days * w + F.coalesce("tr", lit(0.0)) * lit(0.01)).alias("simple_etas"))


def sliding_forecasts(quakes: DataFrame, grid: DataFrame, first: int, step: int, count: int, window: int, t0: int, sigma: float = 2.0) -> DataFrame:
    """The rates of `reference_forecasts` and the observed M>=5 events for every test window `k` at once: day `first + step * k` on, `window` days long.

    An event enters the counts of its cell at the first window behind it, so running sums over the calendar give every window's
    training counts from one scan; the kernel is summed along one axis, then the other; a recent event meets the windows of
    the next 365 days and the cells within 3 degrees.
    """
    day, keys = c("day"), ["k", "ci", "cj"]
    q = quakes.withColumn("day", (c("t") - t0) / lit(float(DAY)))
    behind = F.greatest(F.floor((day - first) / lit(float(step))) + 1, lit(0))
    counts = q.withColumn("k", behind).where(c("k") < count).groupBy(*keys).agg(F.count_if(c("mag") >= 5).alias("m5"), F.count_if(c("mag") >= 3).alias("m3"))
    g = grid.withColumn("k", F.explode(F.sequence(lit(0).cast("long"), lit(count - 1).cast("long")))).join(counts, keys, "left")
    calendar, cells = W.partitionBy("ci", "cj").orderBy("k"), W.partitionBy("k")  # windows of a cell, cells of a window
    g = g.select(*keys, *[F.coalesce(F.sum(x).over(calendar), lit(0)).alias(x) for x in ("m5", "m3")])
    g = g.withColumns({"tot5": F.sum("m5").over(cells), "tot3": F.sum("m3").over(cells), "cells": F.count(lit(1)).over(cells)})
    start = (lit(first) + lit(step) * c("k")).cast("double")
    corner = grid.agg(*[f(x).alias(f"{x}{n}") for x in ("ci", "cj") for n, f in ((0, F.min), (1, F.max))]).first()
    kernel = lambda a, b: F.exp(lit(-0.5 / (sigma * sigma)) * F.pow((c(a) - c(b)) * 2.0, 2))
    across = lambda x: F.explode(F.sequence(lit(corner[f"{x}0"]), lit(corner[f"{x}1"])))
    row = g.where("m5 > 0").select("k", c("ci").alias("si"), c("cj").alias("sj"), "m5", across("cj").alias("cj"))
    row = row.groupBy("k", "si", "cj").agg(F.sum(kernel("cj", "sj") * c("m5")).alias("a"), F.sum(kernel("cj", "sj")).alias("b"))
    both = row.withColumn("ci", across("ci"))
    smooth = both.groupBy(*keys).agg((F.sum(kernel("ci", "si") * c("a")) / F.sum(kernel("ci", "si") * c("b"))).alias("sm"))
    last = F.least(F.ceil((day + 365 - first) / lit(float(step))) - 1, lit(count - 1))
    recent = q.where(c("mag") >= 4).select("lat", "lon", "mag", "day", "ci", "cj", F.explode(F.when(behind <= last, F.sequence(behind, last))).alias("k"))
    near = jn.neighbours(recent, k=2, include_self=True).where((F.abs(c("lat") - c("ni") * 2.0) <= 3) & (F.abs(c("lon") - c("nj") * 2.0) <= 3))
    dist2 = F.pow(c("lat") - c("ni") * 2.0, 2) + F.pow(c("lon") - c("nj") * 2.0, 2)
    felt = ph.omori_integral(c("mag"), start - day, start - day + lit(float(window))) * F.exp(lit(-0.5) * dist2)
    trig = near.groupBy("k", c("ni").alias("ci"), c("nj").alias("cj")).agg(F.sum(felt).alias("tr"))
    from_k, to_k = F.greatest(F.floor((day - window - first) / lit(float(step))) + 1, lit(0)), F.least(F.floor((day - first) / lit(float(step))), lit(count - 1))
    seen = q.where(c("mag") >= 5).select("ci", "cj", F.explode(F.when(from_k <= to_k, F.sequence(from_k, to_k))).alias("k")).groupBy(*keys).agg(F.count(lit(1)).alias("obs"))
    out = g.join(smooth, keys, "left").join(trig, keys, "left").join(seen, keys, "left")
    w, days = lit(float(window)), F.greatest(start, lit(1.0))
    return out.select(*keys, start.alias("start"), (c("tot5") / days * w / c("cells")).alias("uniform"), (F.coalesce("sm", lit(0.0)) / days * w).alias("smoothed"),
                      (c("m3") / F.greatest(c("tot3"), lit(1)) * (c("tot5") / days * w)).alias("relative_intensity"),
                      (c("m5") / days * w + F.coalesce("tr", lit(0.0)) * lit(0.01)).alias("simple_etas"), F.coalesce("obs", lit(0)).alias("obs"))
