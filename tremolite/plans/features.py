"""Point-in-time feature matrix: (cell, step) rows with catalogue features, all windows [t - w, t).

Events are summed per (cell, day) first, so everything after that is bounded by the grid and the calendar. Steps fall on
day boundaries, which makes every window a range frame over day numbers: one shuffle by cell serves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import physics as ph, spatial as sp
from ..operators import joins as jn, moments as mo, ordered as od, sinks as sk
from ..operators.windows import frame_slope

c, lit = F.col, F.lit
DAY = 86400
SIZE = 2.0


def gaps(quakes: DataFrame) -> DataFrame:
    """Days since the previous event of the cell, hot cells included."""
    g = od.neighbour_value(quakes.select("ci", "cj", "dn", "t", "event_id"), ["ci", "cj"], "t", ["event_id"], 1, {"pt": "t"})
    return g.withColumn("gap", (c("t") - c("pt")) / lit(float(DAY)))


def cell_day_table(quakes: DataFrame) -> DataFrame:
    """Everything the windows need about one cell on one day."""
    m3 = F.when(c("mag") >= 3, c("mag"))
    base = quakes.groupBy("ci", "cj", c("dn").alias("day")).agg(
        F.count(lit(1)).alias("n"), F.count(m3).alias("n3"), F.sum(m3).alias("s3"), F.max("mag").alias("mx"),
        F.sum(ph.benioff(c("mag"))).alias("ben"),
        F.max(F.when(c("mag") >= 5, c("t"))).alias("t5"), F.max(F.when(c("mag") >= 4, c("t"))).alias("t4"))
    pos = F.when(c("gap") > 0, c("gap"))
    g = gaps(quakes).groupBy("ci", "cj", c("dn").alias("day")).agg(
        F.count(pos).alias("gn"), F.sum(pos).alias("gs"), F.sum(pos * pos).alias("gq"), F.count(F.when(pos < 1, 1)).alias("g1"),
        # gap of the day's first event: its predecessor lies on an earlier day
        F.min_by("gap", F.struct("t", "event_id")).alias("fg"))
    one = (quakes.select(F.bround("lat").cast("int").alias("a"), F.bround("lon").cast("int").alias("b"), c("dn").alias("day"))
           .groupBy("a", "b", "day").agg(F.count(lit(1)).alias("k")))
    span = lambda x: F.explode(F.sequence(F.ceil((x - 1) / lit(2.0)).cast("int"), F.floor((x + 1) / lit(2.0)).cast("int")))
    fore = one.select(span(c("a")).alias("ci"), "b", "day", "k").select("ci", span(c("b")).alias("cj"), "day", "k").groupBy("ci", "cj", "day").agg(F.sum("k").alias("nf"))
    parts = base.unionByName(g, allowMissingColumns=True).unionByName(fore, allowMissingColumns=True)
    # one row per (cell, day): each column is filled by exactly one of the three parts
    return parts.groupBy("ci", "cj", "day").agg(*[F.max(x).alias(x) for x in parts.columns if x not in ("ci", "cj", "day")])


def windows_at_steps(table: DataFrame, grid: DataFrame) -> DataFrame:
    """Window sums of the cell-day table at every (cell, step)."""
    u = table.withColumn("is_step", lit(0)).unionByName(
        grid.select("ci", "cj", c("step").alias("day"), lit(1).alias("is_step")), allowMissingColumns=True)
    cell = W.partitionBy("ci", "cj").orderBy("day")

    def span(a, b):
        return cell.rangeBetween(a, b)

    cols: dict[str, Column] = {}

    def upto(col, day):
        # a frame that starts at the beginning only grows, so Spark adds each row once
        return F.coalesce(F.sum(col).over(cell.rangeBetween(W.unboundedPreceding, day)), lit(0))

    total = lambda col, a, b: upto(col, b) - upto(col, a - 1)
    for w in (3, 7, 14, 30, 90, 180):
        cols[f"n{w}"] = total("n", -w, -1)
    cols["p7"], cols["p30"] = total("n", -14, -8), total("n", -60, -31)
    for name, a, b in (("mx3", -3, -1), ("mx7", -7, -1), ("mx30", -30, -1), ("mxp3", -6, -4)):
        cols[name] = F.coalesce(F.max("mx").over(span(a, b)), lit(0.0))
    cols["n90m3"], cols["s90m3"] = total("n3", -90, -1), total("s3", -90, -1)
    # differences of running sums leave rounding dust where nothing happened
    exact0 = lambda count, value: F.when(count > 0, value).otherwise(0.0)
    for name, a, b in (("ben7", -7, -1), ("ben30", -30, -1), ("benp", -60, -31)):
        cols[name] = exact0(total("n", a, b), total("ben", a, b))
    cols["nf7"] = total("nf", -7, -1)
    first = F.first("fg", ignorenulls=True).over(span(-30, -1))
    lone = F.first(F.when(c("n").isNotNull(), c("fg").isNull()), ignorenulls=True).over(span(-30, -1))  # very first event of the cell
    fg = F.when(F.coalesce(lone, lit(False)), lit(None).cast("double")).otherwise(first)
    fpos = F.when(fg > 0, fg)
    cols["gn30"] = total("gn", -30, -1) - F.when(fpos.isNotNull(), 1).otherwise(0)
    cols["gs30"] = total("gs", -30, -1) - F.coalesce(fpos, lit(0.0))
    cols["gq30"] = total("gq", -30, -1) - F.coalesce(fpos * fpos, lit(0.0))
    cols["g130"] = total("g1", -30, -1) - F.when(fpos < 1, 1).otherwise(0)
    past = cell.rangeBetween(W.unboundedPreceding, -1)
    cols["last5"], cols["last4"] = F.max("t5").over(past), F.max("t4").over(past)
    return u.select("ci", "cj", "day", "is_step", *[e.alias(n) for n, e in cols.items()]).where("is_step = 1").drop("is_step").withColumnRenamed("day", "step")


def long_term_rates(quakes: DataFrame) -> DataFrame:
    """Events per day of each cell over the catalogue span, and the background rate used for triggering."""
    days = quakes.select(F.greatest((F.max("t") - F.min("t")) / lit(float(DAY)), lit(1.0))).scalar()
    g = quakes.groupBy("ci", "cj").agg(F.count(lit(1)).alias("_n"))
    return g.select("ci", "cj", (c("_n") / days).alias("lt"), F.greatest(lit(0.3) * c("_n") / days, lit(0.01)).alias("mu"))


def catalogue_features(steps: DataFrame, rates: DataFrame) -> DataFrame:
    """Groups A, B, D, E, G, H and I from the window sums."""
    x = steps.join(rates, ["ci", "cj"], "left").withColumns({"lt": F.coalesce("lt", lit(0.01)), "mu": F.coalesce("mu", lit(0.01))})
    b = F.coalesce(ph.b_aki(c("n90m3"), F.try_divide(c("s90m3"), c("n90m3"))), lit(1.0))
    mean_gap = F.try_divide(c("gs30"), c("gn30"))
    std_gap = F.sqrt(F.greatest(F.try_divide(c("gq30"), c("gn30")) - mean_gap * mean_gap, lit(0.0)))
    step_day = lambda t: F.when(t.isNotNull(), (c("step") * DAY - t) / lit(float(DAY))).otherwise(9999.0)
    x = x.withColumns({
        "rate_7d": c("n7"), "rate_14d": c("n14"), "rate_30d": c("n30"),
        "rate_ratio_7d": c("n7") / F.greatest(c("lt") * 7, lit(0.1)), "rate_ratio_30d": c("n30") / F.greatest(c("lt") * 30, lit(0.1)),
        "rate_accel_7d": (c("n7") - c("p7")) / lit(7.0), "rate_accel_30d": (c("n30") - c("p30")) / lit(30.0),
        "max_mag_7d": c("mx7"), "max_mag_30d": c("mx30"), "b_value": b,
        "n_foreshock": c("nf7"), "foreshock_mag_increase": c("mx3") - c("mxp3"),
        "inter_event_cv": F.when(c("gn30") >= 3, std_gap / F.greatest(mean_gap, lit(1e-6))).otherwise(1.0),
        "cluster_fraction": F.when(c("n30") >= 2, c("g130") / F.greatest(c("n30") - 1, lit(1))).otherwise(0.0),
        "benioff_strain_30d": c("ben30"), "benioff_accel": c("ben30") / F.greatest(c("benp"), lit(1.0)),
        "energy_ratio": c("ben7") * c("ben7") / F.greatest(c("ben30") * c("ben30"), lit(1.0)),
        "days_since_m5": step_day(c("last5")), "days_since_m4": step_day(c("last4")),
    })
    x = x.withColumns({
        "mag_deficit": F.when(c("n30") > 0, lit(3.0) + F.log10(F.greatest(c("n30"), lit(1)).cast("double")) / F.greatest(c("b_value"), lit(0.5)) - c("mx30")).otherwise(0.0),
        "log_days_since_m5": F.log10(c("days_since_m5") + 1),
    })
    w = W.partitionBy("ci", "cj").orderBy("step")
    diff = c("rate_7d") - F.lag("rate_7d").over(w)
    x = x.withColumn("_diff", diff).withColumn("_i", c("step") / lit(3.0))
    x = x.withColumns({"_d1": F.sum("_diff").over(w), "_d2": F.sum(c("_diff") * c("_diff")).over(w), "_rn": F.row_number().over(w)})
    back = lambda name: c(name) - F.coalesce(F.lag(name, 239).over(w), lit(0))
    m = F.least(c("_rn") - 1, lit(239))   # differences among the last 240 values, from integer running sums
    x = x.withColumns({"_v1": F.coalesce(back("_d1"), lit(0)), "_v2": F.coalesce(back("_d2"), lit(0)), "_m": m})
    cnt = c("_rn")
    return x.withColumns({
        "rate_trend_slope": frame_slope(c("rate_7d"), c("_i"), w.rowsBetween(-8, 0), 3),
        "b_value_trend": frame_slope(c("b_value"), c("_i"), w.rowsBetween(-5, 0), 3),
        "pi_score": F.when(cnt >= 4, F.try_divide(c("_v2"), c("_m")) - F.pow(F.try_divide(c("_v1"), c("_m")), 2)).otherwise(0.0),
        "pi_trend": F.when(cnt >= 6, F.avg("rate_7d").over(w.rowsBetween(-2, 0)) - F.avg("rate_7d").over(w.rowsBetween(-5, -3))).otherwise(0.0),
    }).drop("_diff", "_i", "_d1", "_d2", "_rn", "_v1", "_v2", "_m")


def stress_pairs(quakes: DataFrame, min_mag=5.5, max_km=300.0, depth=15.0) -> DataFrame:
    """(cell, source) stress changes: strong sources reach the few cells inside the distance box, cells are never crossed with all sources."""
    k = int(max_km / sp.DEG_KM / SIZE) + 1
    s = quakes.where(c("mag") >= min_mag).select("t", "lat", "lon", "depth_km", "mag", "ci", "cj")
    p = jn.neighbours(s, k=k, include_self=True)
    la, lo = c("ni") * SIZE, c("nj") * SIZE
    p = p.where((F.abs(c("lat") - la) * lit(sp.DEG_KM) <= max_km) & (F.abs(c("lon") - lo) * lit(sp.DEG_KM) <= max_km))
    pa = ph.stress_change(c("lat"), c("lon"), c("depth_km"), c("mag"), la, lo, lit(depth))
    return p.select(c("ni").alias("ci"), c("nj").alias("cj"), "t", pa.alias("pa"), F.ceil(c("t") / lit(float(DAY))).alias("eday"))


def stress_features(pairs: DataFrame, grid: DataFrame, rates: DataFrame) -> DataFrame:
    """Cumulative and last-year stress (kPa) and the largest rate-state ratio per (cell, step).

    The rate-state rate grows with stress and with age, so a source that is weaker and younger than another never
    sets the maximum: only the record-setting sources of a cell are paired with its steps.
    """
    daily = pairs.groupBy("ci", "cj", c("eday").alias("day")).agg((F.sum("pa") / 1000).alias("kpa"))
    u = daily.withColumn("is_step", lit(0)).unionByName(grid.select("ci", "cj", c("step").alias("day"), lit(1).alias("is_step")), allowMissingColumns=True)
    cell = W.partitionBy("ci", "cj").orderBy("day")
    maps = u.select("ci", "cj", c("day").alias("step"), "is_step",
                    F.coalesce(F.sum("kpa").over(cell.rangeBetween(W.unboundedPreceding, 0)), lit(0.0)).alias("cfs_cumulative_kpa"),
                    F.coalesce(F.sum("kpa").over(cell.rangeBetween(-364, 0)), lit(0.0)).alias("cfs_recent_kpa")).where("is_step = 1").drop("is_step")
    w = W.partitionBy("ci", "cj").orderBy("t", F.desc("pa")).rowsBetween(W.unboundedPreceding, -1)
    records = pairs.withColumn("_best", F.max("pa").over(w)).where("_best IS NULL OR pa > _best").select("ci", "cj", "t", "pa")
    lt = F.coalesce(c("lt"), lit(0.01))
    r = grid.join(records, ["ci", "cj"]).where(c("step") * DAY > c("t")).join(rates, ["ci", "cj"], "left")
    rs = ph.rate_state(c("pa"), lt, (c("step") * DAY - c("t")) / lit(float(DAY)))
    best = r.groupBy("ci", "cj", "step").agg(F.max(rs / F.greatest(lt, lit(1e-6))).alias("_rs"))
    return maps.join(best, ["ci", "cj", "step"], "left").withColumn("cfs_rate_state", F.greatest(F.coalesce("_rs", lit(1.0)), lit(1.0))).drop("_rs")


ORDER, APART = 18, 3  # moments of a cell of time, cells between a probe's day and the cells that stand for their events (a fifth of the distance: 5^-18)


def _finest(windows, points: int) -> float:
    """Width in days of the smallest cells: half the shortest time from the end of the events to a point of a window."""
    return min(1.0, 2.0 ** math.floor(math.log2(min(windows) / points / 4)))


def _day_moments(width: float, fitted: dict):
    """Events of a grid cell and a block of days -> cells of time and their moments, flat."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                par = fitted.get(r.zone, ph.TRIGGER)
                t = np.asarray(r.t, dtype="float64") / DAY
                weight = par["K"] * np.exp(par["alpha"] * (np.asarray(r.mag, dtype="float64") - par["mc"]))
                cells, m = mo.cell_moments(t, np.floor(t / width).astype(np.int64), weight[None, :], width, 0, ORDER)
                yield pd.DataFrame({"ci": [r.ci], "cj": [r.cj], "block": [r.block], "cells": [cells], "moments": [m.ravel()]})
    return run


def _kernel_sums(points: int, width: float, fitted: dict):
    """Triggered counts of the probes of a grid cell from the moments of its cells of time, one row per probe that has events before it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                par = fitted.get(r.zone, ph.TRIGGER)
                cells, m = np.concatenate(list(r.cells)), np.concatenate(list(r.moments)).reshape(-1, 1, ORDER)
                step, w, day = (np.asarray(x) for x in (r.step, r.w, r.day))
                end = np.rint(day / width).astype(np.int64)
                use = end > cells[0]
                step, w, day, end = (x[use] for x in (step, w, day, end))
                at = day[:, None] + w[:, None] * ((np.arange(points) + 0.5) / points) + par["c"]
                binom = mo.binomials(par["p"], ORDER)
                total = np.zeros(at.shape)
                level = 0
                while True:
                    # cells of this level up to `last`, without those that lie in a cell of the next level that is used
                    last = (end >> level) - (APART if level else 1)
                    first = 2 * ((end >> (level + 1)) - APART + 1)
                    half = width * 2.0 ** level / 2
                    for back in range((last - first).max(initial=-1) + 1):
                        b = last - back
                        place = np.minimum(np.searchsorted(cells, b), len(cells) - 1)
                        hit = np.flatnonzero((b >= first) & (cells[place] == b))
                        x = at[hit] - (2 * b[hit, None] + 1) * half
                        q, mm = half / x, m[place[hit], 0] * binom
                        dens = np.zeros(x.shape)
                        for k in range(ORDER - 1, -1, -1):
                            dens = dens * q + mm[:, k, None]
                        total[hit] += x ** -par["p"] * dens
                    if not (first > cells[0]).any():
                        break
                    cells, m = mo.parents(cells, m)
                    level += 1
                yield pd.DataFrame({"ci": r.ci, "cj": r.cj, "step": step, "w": w, "x": total.sum(axis=1) * w / points})
    return run


def triggering_expected(quakes: DataFrame, grid: DataFrame, windows=(7, 30), points=7, block=64, zone_params: dict | None = None) -> DataFrame:
    """Expected triggered count per (cell, step, window) from all events before the window.

    `zone_params` (see `trigger_fit.zone_parameters`) replaces the standard parameters in the zones it names.

    Events of a cell travel once, in blocks of `block` days, and leave the task as moments of short cells of time, so a cell holds no more than
    its calendar. A probe adds up the few cells of time, longer with age, that make up all days before its window.
    """
    fitted, width = zone_params or {}, _finest(windows, points)
    zone = sp.zone_of(c("ci") * SIZE, c("cj") * SIZE).alias("zone")
    days = quakes.where(c("t").isNotNull()).groupBy("ci", "cj", F.floor(c("t") / lit(DAY * block)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("t", "mag"))).alias("e"))
    days = days.select("ci", "cj", "block", c("e.t").alias("t"), c("e.mag").alias("mag"), zone)
    rows = days.mapInPandas(_day_moments(width, fitted), "ci int, cj int, block long, cells array<long>, moments array<double>")
    cells = rows.groupBy("ci", "cj").agg(F.sort_array(F.collect_list(F.struct("block", "cells", "moments"))).alias("m")).select("ci", "cj", c("m.cells").alias("cells"), c("m.moments").alias("moments"))
    probes = grid.select("ci", "cj", "step", F.explode(F.array(*[lit(w) for w in windows])).alias("w")).withColumn("day", c("step") - c("w"))
    probes = probes.groupBy("ci", "cj").agg(F.collect_list(F.struct("step", "w", "day")).alias("q"))
    met = probes.join(cells, ["ci", "cj"]).select("ci", "cj", *[c(f"q.{x}").alias(x) for x in ("step", "w", "day")], "cells", "moments", zone)
    sums = met.mapInPandas(_kernel_sums(points, width, fitted), "ci int, cj int, step long, w int, x double")
    return sums.groupBy("ci", "cj", "step").agg(*[F.sum(F.when(c("w") == w, c("x"))).alias(f"_x{w}") for w in windows])


def triggering_residuals(x: DataFrame, wide: DataFrame, windows=(7, 30)) -> DataFrame:
    """Observed over expected counts and the trend of the short residual; x brings rate_<w>d and mu."""
    out = x.join(wide, ["ci", "cj", "step"], "left")
    for w in windows:
        out = out.withColumn(f"etas_residual_{w}d", c(f"rate_{w}d") / F.greatest(c("mu") * w + F.coalesce(f"_x{w}", lit(0.0)), lit(0.1)))
    frame = W.partitionBy("ci", "cj").orderBy("step").rowsBetween(-8, 0)
    out = out.withColumn("etas_residual_trend", frame_slope(c("etas_residual_7d"), c("step") / lit(3.0), frame, 3))
    return out.drop(*[f"_x{w}" for w in windows])


def spatial_features(x: DataFrame) -> DataFrame:
    """Groups J, K and M: the eight neighbours are reached by scattering each row, zones by a small window per step."""
    near = jn.neighbours(x.select("ci", "cj", "step", "rate_7d", "mx7", "cfs_cumulative_kpa", "etas_residual_7d").where("rate_7d > 0 OR cfs_cumulative_kpa > 0"))
    g = near.groupBy(c("ni").alias("ci"), c("nj").alias("cj"), "step").agg(
        F.sum("rate_7d").alias("neighbor_rate_sum"), F.max("mx7").alias("neighbor_max_mag"), F.max("cfs_cumulative_kpa").alias("neighbor_cfs_max"),
        F.max("etas_residual_7d").alias("neighbor_etas_resid_max"))
    y = x.join(g, ["ci", "cj", "step"], "left")
    for n in ("neighbor_rate_sum", "neighbor_max_mag", "neighbor_cfs_max", "neighbor_etas_resid_max"):
        y = y.withColumn(n, F.greatest(F.coalesce(n, lit(0)), lit(0)))
    mean_near = c("neighbor_rate_sum") / lit(8.0)
    zone = sp.zone_of(c("ci") * SIZE, c("cj") * SIZE)
    y = y.withColumn("zone", zone)
    zw = W.partitionBy("zone", "step")
    zmean = F.avg("rate_7d").over(zw)
    own = F.when(zmean > 0, zmean).otherwise(c("rate_7d"))
    y = y.withColumns({
        "rate_spatial_anomaly": c("rate_7d") / F.greatest(mean_near, lit(0.1)), "spatial_gradient": c("rate_7d") - mean_near,
        "zone_rate_anomaly": c("rate_7d") / F.greatest(own, lit(0.1)),
        "zone_cfs_rank": F.cume_dist().over(zw.orderBy("cfs_cumulative_kpa")),
    })
    signals = [c("rate_ratio_7d") > 3, c("etas_residual_7d") > 3, c("n_foreshock") >= 5, c("cfs_cumulative_kpa") > 50, c("pi_score") > 5, c("benioff_accel") > 3]
    return y.withColumns({"n_active_signals": sum((s.cast("int") for s in signals[1:]), signals[0].cast("int")), "alarm_density": lit(0.0)})


CATALOGUE = """rate_7d rate_14d rate_30d rate_ratio_7d rate_ratio_30d rate_accel_7d rate_accel_30d rate_trend_slope
etas_residual_7d etas_residual_30d etas_residual_trend max_mag_7d max_mag_30d mag_deficit b_value b_value_trend n_foreshock
foreshock_mag_increase inter_event_cv cluster_fraction cfs_cumulative_kpa cfs_rate_state cfs_recent_kpa pi_score pi_trend
benioff_strain_30d benioff_accel energy_ratio days_since_m5 days_since_m4 log_days_since_m5 neighbor_rate_sum
rate_spatial_anomaly n_active_signals alarm_density neighbor_cfs_max neighbor_etas_resid_max zone_rate_anomaly
zone_cfs_rank spatial_gradient neighbor_max_mag""".split()


def catalogue_matrix(quakes: DataFrame, grid: DataFrame) -> DataFrame:
    """All catalogue features for every (cell, step) of the grid."""
    rates = long_term_rates(quakes)
    steps = windows_at_steps(cell_day_table(quakes), grid)
    x = catalogue_features(steps, rates)
    keys = ["ci", "cj", "step"]
    x = x.join(stress_features(stress_pairs(quakes), grid, rates), keys)
    x = triggering_residuals(x, triggering_expected(quakes, grid))
    # neighbours and zones read the table twice: it is written once to the shared folder
    x = sk.materialized(x, "features")
    return spatial_features(x).select(*keys, *CATALOGUE)
