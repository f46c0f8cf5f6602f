"""Window jobs on series, grids and station tables (W*, A05b, A39)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import aggregates as ag, expand as ex, joins as jn, ordered as od, windows as wn
from .q_basic import DAY, R
from .q_joins import grid_points
from .registry import query

c, lit = F.col, F.lit


@query("W01_rolling_anomaly", """WITH a AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY name ORDER BY t_us, id ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING))
  SELECT id, name, value, round(m, 6) AS mean, round(s, 6) AS std, 0.0 + round((value-m)/s, 5) AS sigma, CASE WHEN value > m THEN 'high' ELSE 'low' END AS direction FROM a WHERE n >= 6 AND s >= 1e-10 AND abs((value-m)/s) >= 2""")
def w01(v):
    a = wn.rolling_anomaly(v.series, ["name"], "t_us", ["id"], "value")
    return a.select("id", "name", "value", R(c("mean")).alias("mean"), R(c("std")).alias("std"), R(c("sigma"), 5).alias("sigma"), "direction")


@query("A05b_detect_anomalies", """WITH e AS (SELECT name, h, avg(value) AS v FROM series GROUP BY 1, 2), a AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY name ORDER BY h ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING))
  SELECT name, h, round(v, 6) AS value, 0.0 + round((v-m)/s, 5) AS sigma FROM a WHERE n >= 6 AND s >= 1e-10 AND abs((v-m)/s) >= 2""")
def a05b(v):
    e = v.series.groupBy("name", "h").agg(F.avg("value").alias("v"))
    return wn.series_anomaly(e, ["name"], "h", "v").select("name", "h", R(c("v")).alias("value"), R(c("sigma"), 5).alias("sigma"))


CELL_DAY = "p AS (SELECT gi, gj, dn, avg(value) AS v FROM grid_obs GROUP BY 1, 2, 3)"


def cell_day(v):
    return v.grid_obs.groupBy("gi", "gj", "dn").agg(F.avg("value").alias("v"))


@query("W02_baseline_30", f"""WITH {CELL_DAY}, a AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY gi, gj ORDER BY dn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
  SELECT gi, gj, dn, round(coalesce(m, v), 6) AS v_mean, round(greatest(CASE WHEN n >= 2 THEN s ELSE 1 END, 1e-1), 6) AS v_std FROM a""")
def w02(v):
    return wn.baseline(cell_day(v), ["gi", "gj"], "dn", "v").select("gi", "gj", "dn", R(c("v_mean")).alias("v_mean"), R(c("v_std")).alias("v_std"))


DAILY = "p AS (SELECT dn, avg(value) AS v FROM daily_obs GROUP BY 1)"


def daily(v):
    return v.daily_obs.groupBy("dn").agg(F.avg("value").alias("v")).withColumn("one", lit(1))


@query("W03_rolling_27", f"""WITH {DAILY}, a AS (SELECT dn, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(v) OVER w AS n FROM p WINDOW w AS (ORDER BY dn ROWS BETWEEN 26 PRECEDING AND CURRENT ROW))
  SELECT dn, round(CASE WHEN n >= 13 THEN m END, 6) AS roll_mean, round(CASE WHEN n >= 13 THEN s END, 6) AS roll_std FROM a""")
def w03(v):
    return wn.rolling_mean_std(daily(v), ["one"], "dn", "v", 27).select("dn", R(c("roll_mean")).alias("roll_mean"), R(c("roll_std")).alias("roll_std"))


@query("W04_rolling_slope", f"""WITH {DAILY}, a AS (SELECT dn, v, row_number() OVER (ORDER BY dn) AS i FROM p), b AS (SELECT dn, regr_slope(v, i) OVER w AS s, count(*) OVER w AS n FROM a WINDOW w AS (ORDER BY dn ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
  SELECT dn, 0.0 + round(CASE WHEN n >= 7 THEN s END, 6) AS slope FROM b""")
def w04(v):
    w = W.partitionBy("one").orderBy("dn")
    d = daily(v).withColumn("i", F.row_number().over(w))
    f = w.rowsBetween(-14, 0)
    return d.select("dn", R(F.when(F.count("v").over(f) >= 7, F.regr_slope(c("v"), c("i")).over(f))).alias("slope"))


@query("W05_two_day_drop", f"""WITH {DAILY}, a AS (SELECT dn, v, lag(v, 2) OVER (ORDER BY dn) AS v2 FROM p) SELECT dn, CASE WHEN v2 IS NOT NULL AND (v - v2)/v2*100 < -3 THEN 1 ELSE 0 END AS drop_flag FROM a""")
def w05(v):
    d = daily(v).withColumn("v2", F.lag("v", 2).over(W.partitionBy("one").orderBy("dn")))
    return d.select("dn", F.when(F.try_divide(c("v") - c("v2"), c("v2")) * 100 < -3, 1).otherwise(0).alias("drop_flag"))


EVENT_EPOCH = """e AS (SELECT event_id, g.dn AS epoch, avg(value) AS v FROM quakes q JOIN grid_obs g ON g.dn BETWEEN q.dn - {back} AND q.dn + 1 AND abs(q.lat - glat) <= 5 AND abs(q.lon - glon) <= 5 WHERE mag >= 5 GROUP BY 1, 2)"""


def event_epochs(v, back):
    """Spatial mean of the grid around each strong event, per day of its window."""
    q = v.quakes.where("mag >= 5").select("event_id", c("dn").alias("qd"), "lat", "lon")
    pairs = jn.range_join(q, grid_points(v.grid_obs), time=("qd", "dn", -back, 1), box=("lat", "lon", "glat", "glon", 5.0))
    return pairs.groupBy("event_id", c("dn").alias("epoch")).agg((F.sum("gs") / F.sum("gn")).alias("v"))


@query("W06_tail_split", f"""WITH {EVENT_EPOCH.format(back=20)}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY epoch DESC) AS rn FROM e),
  g AS (SELECT event_id, count(*) AS n, avg(v) FILTER (rn <= 8) AS p, avg(v) FILTER (rn > 8) AS b, stddev_pop(v) FILTER (rn > 8) AS s FROM r GROUP BY 1 HAVING count(*) >= 6)
  SELECT event_id, n AS n_epochs, round(p, 6) AS precursor, round(b, 6) AS base, 0.0 + round(CASE WHEN s > 1e-1 THEN (p-b)/s WHEN b IS NOT NULL THEN 0 END, 5) AS sigma FROM g""")
def w06(v):
    s = wn.tail_split_sigma(event_epochs(v, 20), "event_id", "epoch", "v")
    return s.select("event_id", "n_epochs", R(c("precursor")).alias("precursor"), R(c("base")).alias("base"), R(c("sigma"), 5).alias("sigma"))


@query("W07_detrended_split", f"""WITH {EVENT_EPOCH.format(back=37)}, m AS (SELECT CAST(month(d) AS INT) AS mon, avg(value) AS clim FROM grid_obs GROUP BY 1),
  x AS (SELECT event_id, epoch, v, v - clim AS dv FROM e JOIN m ON m.mon = month(DATE '1970-01-01' + CAST(epoch AS INT))),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY epoch DESC) AS rn, count(*) OVER (PARTITION BY event_id) AS n FROM x),
  g AS (SELECT event_id, max(n) AS n, avg(dv) FILTER (rn <= 8) AS p, avg(dv) FILTER (rn > 8) AS b, stddev_pop(dv) FILTER (rn > 8) AS s,
   avg(v) FILTER (rn <= 8) AS rp, avg(v) FILTER (rn > CASE WHEN n >= 24 THEN 16 ELSE 8 END) AS rb, stddev_pop(v) FILTER (rn > CASE WHEN n >= 24 THEN 16 ELSE 8 END) AS rs FROM r GROUP BY 1 HAVING max(n) >= 20)
  SELECT event_id, 0.0 + round((p-b)/s, 5) AS sigma_detrended, 0.0 + round((rp-rb)/rs, 5) AS sigma_rolling FROM g WHERE s >= 1e-2 AND rs >= 1e-2""")
def w07(v):
    e = event_epochs(v, 37).withColumn("mon", F.month(F.date_from_unix_date(c("epoch").cast("int"))))
    clim = v.grid_obs.groupBy(F.month("d").alias("mon")).agg(F.avg("value").alias("clim"))
    w = W.partitionBy("event_id")
    r = e.join(clim, "mon").withColumns({"rn": F.row_number().over(w.orderBy(F.desc("epoch"))), "n": F.count(lit(1)).over(w), "dv": c("v") - c("clim")})
    late, early = c("rn") <= 8, c("rn") > 8
    context = c("rn") > F.when(c("n") >= 24, 16).otherwise(8)   # a short context falls back to everything before the tail
    g = r.where("n >= 20").groupBy("event_id").agg(
        F.avg(F.when(late, c("dv"))).alias("p"), F.avg(F.when(early, c("dv"))).alias("b"), F.stddev_pop(F.when(early, c("dv"))).alias("s"),
        F.avg(F.when(late, c("v"))).alias("rp"), F.avg(F.when(context, c("v"))).alias("rb"), F.stddev_pop(F.when(context, c("v"))).alias("rs"))
    return g.where("s >= 0.01 AND rs >= 0.01").select("event_id", R((c("p") - c("b")) / c("s"), 5).alias("sigma_detrended"), R((c("rp") - c("rb")) / c("rs"), 5).alias("sigma_rolling"))


@query("W18_gap_baseline_z", f"""WITH {CELL_DAY}, a AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY gi, gj ORDER BY dn RANGE BETWEEN 30 PRECEDING AND 4 PRECEDING))
  SELECT gi, gj, dn, 0.0 + round((v-m)/s, 5) AS z FROM a WHERE n >= 5 AND s >= 1e-2""")
def w18(v):
    w = W.partitionBy("gi", "gj").orderBy("dn").rangeBetween(-30, -4)
    a = cell_day(v).withColumns({"m": F.avg("v").over(w), "s": F.stddev_pop("v").over(w), "n": F.count("v").over(w)})
    return a.where("n >= 5 AND s >= 0.01").select("gi", "gj", "dn", R((c("v") - c("m")) / c("s"), 5).alias("z"))


def pre_event_z(events, points, cell, pre=3, back=30):
    """Mean of [t-pre, t) against the [t-back, t-pre) baseline of the event's grid cell, per event."""
    q = events.select("event_id", c("dn").alias("qd"), (F.bround(c("lat") / cell)).cast("int").alias("qi"), (F.bround(c("lon") / cell)).cast("int").alias("qj"))
    p = points.groupBy("dn", F.bround(c("glat") / cell).cast("int").alias("qi"), F.bround(c("glon") / cell).cast("int").alias("qj")).agg(
        (F.sum("gs") / F.sum("gn")).alias("v"))
    pairs = jn.range_join(q, p, on=["qi", "qj"], time=("qd", "dn", -back, -1))
    early, late = c("dn") < c("qd") - pre, c("dn") >= c("qd") - pre
    g = pairs.groupBy("event_id").agg(F.avg(F.when(late, c("v"))).alias("obs"), F.avg(F.when(early, c("v"))).alias("m"),
                                      F.stddev_pop(F.when(early, c("v"))).alias("s"), F.count(F.when(early, 1)).alias("n"))
    return g.where("n >= 5 AND s >= 0.01 AND obs IS NOT NULL").withColumn("z", (c("obs") - c("m")) / c("s"))


_PREZ = """SELECT event_id, avg(v) FILTER (g.dn >= q.dn-3) AS obs, avg(v) FILTER (g.dn < q.dn-3) AS m, stddev_pop(v) FILTER (g.dn < q.dn-3) AS s, count(*) FILTER (g.dn < q.dn-3) AS n
  FROM quakes q JOIN {g} g ON g.dn BETWEEN q.dn-30 AND q.dn-1 AND CAST(round_even(q.lat/{s},0) AS INT)=g.i AND CAST(round_even(q.lon/{s},0) AS INT)=g.j GROUP BY 1"""


def _gsql(s):
    return f"(SELECT dn, CAST(round_even(glat/{s},0) AS INT) AS i, CAST(round_even(glon/{s},0) AS INT) AS j, avg(value) AS v FROM grid_obs GROUP BY 1,2,3)"


@query("W19_pre_event_z", f"""WITH a AS ({_PREZ.format(g=_gsql('2e0'), s='2e0')}) SELECT event_id, 0.0 + round((obs-m)/s, 5) AS z FROM a WHERE n >= 5 AND s >= 1e-2 AND obs IS NOT NULL""")
def w19(v):
    return pre_event_z(v.quakes, grid_points(v.grid_obs), 2.0).select("event_id", R(c("z"), 5).alias("z"))


@query("G20_resolution_comparison", f"""WITH a AS ({_PREZ.format(g=_gsql('2e0'), s='2e0')}), b AS ({_PREZ.format(g=_gsql('5e0'), s='5e0')}),
  u AS (SELECT 'fine' AS grid, (obs-m)/s AS z FROM a WHERE n >= 5 AND s >= 1e-2 AND obs IS NOT NULL UNION ALL SELECT 'coarse', (obs-m)/s FROM b WHERE n >= 5 AND s >= 1e-2 AND obs IS NOT NULL)
  SELECT grid, count(*) AS n, 0.0 + round(avg(z), 6) AS mean_z, round(avg(CAST(abs(z) > 2 AS INT)), 6) AS share_2sigma FROM u GROUP BY 1""")
def g20(v):
    pts = grid_points(v.grid_obs)
    u = pre_event_z(v.quakes, pts, 2.0).select(lit("fine").alias("grid"), "z").unionByName(pre_event_z(v.quakes, pts, 5.0).select(lit("coarse").alias("grid"), "z"))
    return u.groupBy("grid").agg(F.count(lit(1)).alias("n"), R(F.avg("z")).alias("mean_z"), R(F.avg((F.abs("z") > 2).cast("double"))).alias("share_2sigma"))


@query("W20_median_baseline_ratio", f"""WITH p AS (SELECT kind, h, var_pop(value) AS v FROM station_obs WHERE (t % 86400)//3600 BETWEEN 15 AND 21 GROUP BY 1, 2 HAVING count(*) >= 2),
  a AS (SELECT *, quantile_cont(v, 0.5) OVER w AS m, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY kind ORDER BY h ROWS BETWEEN 60 PRECEDING AND 7 PRECEDING))
  SELECT kind, h, round(v/m, 5) AS ratio FROM a WHERE n >= 10 AND m >= 1e-6""")
def w20(v):
    p = v.station_obs.where("pmod(t, 86400) div 3600 BETWEEN 15 AND 21").groupBy("kind", "h").agg(F.var_pop("value").alias("v"), F.count(lit(1)).alias("k")).where("k >= 2")
    w = W.partitionBy("kind").orderBy("h").rowsBetween(-60, -7)  # hours of one sensor
    a = p.withColumns({"m": F.percentile("v", lit(0.5)).over(w), "n": F.count("v").over(w)})
    return a.where("n >= 10 AND m >= 1e-6").select("kind", "h", R(c("v") / c("m"), 5).alias("ratio"))


@query("W21_displacement", """WITH p AS (SELECT station, dn, avg(value) AS v FROM station_obs GROUP BY 1, 2), a AS (SELECT *, first_value(v) OVER (PARTITION BY station ORDER BY dn) AS v0, row_number() OVER (PARTITION BY station ORDER BY dn DESC) AS rn FROM p)
  SELECT station, dn, 0.0 + round(v - v0, 6) AS displacement FROM a WHERE rn <= 7""")
def w21(v):
    p = v.station_obs.groupBy("station", "dn").agg(F.avg("value").alias("v"))
    w = W.partitionBy("station")
    a = p.withColumns({"v0": F.first("v").over(w.orderBy("dn")), "rn": F.row_number().over(w.orderBy(F.desc("dn")))})
    return a.where("rn <= 7").select("station", "dn", R(c("v") - c("v0")).alias("displacement"))


@query("W22_month_difference", """WITH m AS (SELECT gi, gj, CAST(year(d)*12+month(d) AS INT) AS mi, avg(value) AS v FROM grid_obs GROUP BY 1,2,3)
  SELECT gi, gj, mi, 0.0 + round(v - lag(v) OVER (PARTITION BY gi, gj ORDER BY mi), 6) AS diff FROM m""")
def w22(v):
    m = v.grid_obs.groupBy("gi", "gj", (F.year("d") * 12 + F.month("d")).alias("mi")).agg(F.avg("value").alias("v"))
    return m.select("gi", "gj", "mi", R(c("v") - F.lag("v").over(W.partitionBy("gi", "gj").orderBy("mi"))).alias("diff"))


def transient_score(df, key, day, value, baseline_days=90, recent_days=7):
    """Recent over long-term displacement rate per key, measured back from the key's last day."""
    last = F.max(day).over(W.partitionBy(key))
    d = df.withColumns({"_n": F.count(lit(1)).over(W.partitionBy(key)), "_t1": last})
    base = (c(day) >= c("_t1") - baseline_days) & (c(day) < c("_t1") - recent_days)
    recent = c(day) >= c("_t1") - recent_days

    def rate(cond, tag):
        at = F.when(cond, c(day))
        return [F.max_by(value, at).alias(f"{tag}1"), F.min_by(value, at).alias(f"{tag}0"), F.max(at).alias(f"{tag}t1"), F.min(at).alias(f"{tag}t0"), F.count(at).alias(f"{tag}n")]
    g = d.groupBy(key).agg(F.max("_n").alias("n"), *rate(base, "b"), *rate(recent, "r"))
    br, rr = F.abs(F.try_divide(c("b1") - c("b0"), c("bt1") - c("bt0"))), F.abs(F.try_divide(c("r1") - c("r0"), c("rt1") - c("rt0")))
    bad = (c("n") < 10) | (c("bn") < 5) | (c("rn") < 2) | (c("bt1") <= c("bt0")) | (c("rt1") <= c("rt0"))
    return g.select(key, F.when(bad, 0.0).when(br < 0.001, rr * 100).otherwise(F.try_divide(rr, br)).alias("score"))


@query("W23_transient_score", """WITH p AS (SELECT station, dn, avg(value) AS v FROM daily_obs GROUP BY 1, 2), a AS (SELECT *, max(dn) OVER (PARTITION BY station) AS t1 FROM p),
  g AS (SELECT station, count(*) AS n, arg_max(v, dn) FILTER (dn >= t1-90 AND dn < t1-7) - arg_min(v, dn) FILTER (dn >= t1-90 AND dn < t1-7) AS bd, max(dn) FILTER (dn >= t1-90 AND dn < t1-7) - min(dn) FILTER (dn >= t1-90 AND dn < t1-7) AS bt, count(*) FILTER (dn >= t1-90 AND dn < t1-7) AS bn,
   arg_max(v, dn) FILTER (dn >= t1-7) - arg_min(v, dn) FILTER (dn >= t1-7) AS rd, max(dn) FILTER (dn >= t1-7) - min(dn) FILTER (dn >= t1-7) AS rt, count(*) FILTER (dn >= t1-7) AS rn FROM a GROUP BY 1)
  SELECT station, round(CASE WHEN n < 10 OR bn < 5 OR rn < 2 OR bt <= 0 OR rt <= 0 THEN 0 WHEN abs(bd/bt) < 1e-3 THEN abs(rd/rt)*100 ELSE abs(rd/rt)/abs(bd/bt) END, 4) AS score FROM g""")
def w23(v):
    p = v.daily_obs.groupBy("station", "dn").agg(F.avg("value").alias("v"))
    return transient_score(p, "station", "dn", "v").select("station", R(c("score"), 4).alias("score"))


def common_mode(df, epoch, value, keys=()):
    """Value minus the epoch median over reference stations; medians are exact and never gathered in one task."""
    med = od.exact_quantiles(df, [epoch, *keys], value, {"common": 0.5}).drop("n")
    return df.join(med, [epoch, *keys]).withColumn("clean", c(value) - c("common"))


@query("W24_common_mode", """WITH p AS (SELECT station, dn, avg(value) AS v FROM station_obs GROUP BY 1, 2) SELECT station, dn, 0.0 + round(v - quantile_cont(v, 0.5) OVER (PARTITION BY dn), 5) AS clean FROM p""")
def w24(v):
    p = v.station_obs.groupBy("station", "dn").agg(F.avg("value").alias("v"))
    return common_mode(p, "dn", "v").select("station", "dn", R(c("clean"), 5).alias("clean"))


def detrend(df, key, x, value, base_from, base_to, steps=()):
    """Residual from a line fitted on [base_from, base_to), then from the median offsets of known step times."""
    inside = (c(x) >= base_from) & (c(x) < base_to)
    xs, ys = F.when(inside, c(x) - base_from), F.when(inside, c(value))
    fit = df.groupBy(key).agg(F.regr_slope(ys, xs).alias("_k"), F.regr_intercept(ys, xs).alias("_b"), F.count(ys).alias("_n")).where("_n >= 3")
    out = df.join(fit, key).withColumn("resid", c(value) - (c("_k") * (c(x) - base_from) + c("_b")))
    for at, width in steps:
        pre, post = (c(x) >= at - width) & (c(x) < at), (c(x) > at) & (c(x) <= at + width)
        jump = out.groupBy(key).agg(F.percentile(F.when(pre, c("resid")), lit(0.5)).alias("_p0"), F.percentile(F.when(post, c("resid")), lit(0.5)).alias("_p1"),
                                    F.count(F.when(pre, 1)).alias("_n0"), F.count(F.when(post, 1)).alias("_n1"))
        jump = jump.select(key, F.when((c("_n0") >= 3) & (c("_n1") >= 3), c("_p1") - c("_p0")).otherwise(0.0).alias("_jump"))
        out = out.join(jump, key).withColumn("resid", F.when(c(x) >= at, c("resid") - c("_jump")).otherwise(c("resid"))).drop("_jump")
    return out.drop("_k", "_b", "_n")


_DETREND = """p AS (SELECT station, dn, avg(value) AS v FROM station_obs GROUP BY 1, 2), f AS (SELECT station, regr_slope(v, dn - 19723) FILTER (dn >= 19723 AND dn < 19738) AS k, regr_intercept(v, dn - 19723) FILTER (dn >= 19723 AND dn < 19738) AS b,
   count(*) FILTER (dn >= 19723 AND dn < 19738) AS n FROM p GROUP BY 1), r0 AS (SELECT p.*, v - (k*(dn-19723)+b) AS r FROM p JOIN f USING (station) WHERE n >= 3),
  j AS (SELECT station, CASE WHEN count(*) FILTER (dn >= 19735 AND dn < 19740) >= 3 AND count(*) FILTER (dn > 19740 AND dn <= 19745) >= 3 THEN quantile_cont(r, 0.5) FILTER (dn > 19740 AND dn <= 19745) - quantile_cont(r, 0.5) FILTER (dn >= 19735 AND dn < 19740) ELSE 0 END AS jump FROM r0 GROUP BY 1),
  res AS (SELECT station, dn, CASE WHEN dn >= 19740 THEN r - jump ELSE r END AS resid FROM r0 JOIN j USING (station))"""


def detrended(v):
    p = v.station_obs.groupBy("station", "dn").agg(F.avg("value").alias("v"))
    return detrend(p, "station", "dn", "v", 19723, 19738, steps=[(19740, 5)])


@query("W25_step_and_trend", f"WITH {_DETREND} SELECT station, dn, 0.0 + round(resid + 1e-9, 7) AS resid FROM res")
def w25(v):
    return detrended(v).select("station", "dn", R(c("resid") + 1e-9, 7).alias("resid"))


def displacement_null(df, key, x, value, first, last, length, hop, edge, target):
    """Net displacement of one target window against the 95th percentile of sliding baseline windows."""
    starts = list(range(first, last - length + 1, hop)) + [target]
    d = ex.with_values(df, starts, "w0").where((c(x) >= c("w0")) & (c(x) <= c("w0") + length))
    head, tail = c(x) <= c("w0") + edge, c(x) >= c("w0") + length - edge
    g = d.groupBy(key, "w0").agg(F.percentile(F.when(head, c(value)), lit(0.5)).alias("h"), F.percentile(F.when(tail, c(value)), lit(0.5)).alias("t"), F.count(lit(1)).alias("n"))
    g = g.where("n >= 3 AND h IS NOT NULL AND t IS NOT NULL").withColumn("net", F.abs(c("t") - c("h")))
    s = g.groupBy(key).agg(F.percentile(F.when(c("w0") != target, c("net")), lit(0.95)).alias("p95"), F.max(F.when(c("w0") == target, c("net"))).alias("net"), F.count(F.when(c("w0") != target, 1)).alias("n_base"))
    return s.where("net IS NOT NULL AND n_base >= 5").withColumn("exceed", (c("net") > c("p95")).cast("int"))


_NULL = _DETREND + """, s AS (SELECT unnest([19723,19725,19727,19729,19731,19733,19735,19745]) AS w0),
  g AS (SELECT station, w0, abs(quantile_cont(resid, 0.5) FILTER (dn >= w0+5) - quantile_cont(resid, 0.5) FILTER (dn <= w0+2)) AS net FROM res, s WHERE dn BETWEEN w0 AND w0+7 GROUP BY 1,2 HAVING count(*) >= 3),
  z AS (SELECT station, quantile_cont(net, 0.95) FILTER (w0 <> 19745) AS p95, max(net) FILTER (w0 = 19745) AS net, count(net) FILTER (w0 <> 19745) AS n_base FROM g GROUP BY 1)"""


@query("W26_displacement_null", f"WITH {_NULL} SELECT station, round(net + 1e-9, 5) AS net, round(p95 + 1e-9, 5) AS p95, n_base, CAST(net > p95 AS INT) AS exceed FROM z WHERE net IS NOT NULL AND n_base >= 5")
def w26(v):
    s = displacement_null(detrended(v), "station", "dn", "resid", 19723, 19742, 7, 2, 2, 19745)
    return s.select("station", R(c("net") + 1e-9, 5).alias("net"), R(c("p95") + 1e-9, 5).alias("p95"), "n_base", "exceed")


@query("W27_gap_list", """WITH d AS (SELECT DISTINCT station, dn FROM station_obs), g AS (SELECT *, lead(dn) OVER (PARTITION BY station ORDER BY dn) AS nd FROM d)
  SELECT station, dn, nd AS next_day, nd - dn - 1 AS missing FROM g WHERE nd - dn - 1 > 0 ORDER BY missing DESC, station, dn LIMIT 50""")
def w27(v):
    return wn.gap_list(v.station_obs, ["station"], "dn").orderBy(F.desc("missing"), "station", "dn").limit(50)


@query("W28_islands", """WITH d AS (SELECT DISTINCT station, dn FROM station_obs), g AS (SELECT *, dn - row_number() OVER (PARTITION BY station ORDER BY dn) AS g FROM d)
  SELECT station, min(dn) AS first, max(dn) AS last, count(*) AS length FROM g GROUP BY station, g""")
def w28(v):
    return wn.islands(v.station_obs, ["station"], "dn")


@query("W13_percentile_rank", """WITH n AS (SELECT ci, cj, count(*) AS n FROM quakes GROUP BY 1, 2) SELECT ci, cj, n, round(100*cume_dist() OVER (ORDER BY n), 6) AS pct_rank FROM n""")
def w13(v):
    n = v.quakes.groupBy("ci", "cj").agg(F.count(lit(1)).alias("n"))
    return n.select("ci", "cj", "n", R(100 * F.cume_dist().over(W.partitionBy(lit(0)).orderBy("n"))).alias("pct_rank"))  # one row per cell


@query("W30_rank_ensemble", """WITH s AS (SELECT k, p, disc + tax2 AS q FROM (SELECT k, p, disc, 1 - disc*p AS tax2 FROM scores)),
  n AS (SELECT count(*) AS n FROM s), ra AS (SELECT p, (2*min(rp) + count(*) - 1)/2e0 AS r1 FROM (SELECT p, rank() OVER (ORDER BY p) AS rp FROM s) GROUP BY p), rb AS (SELECT q, (2*min(rq) + count(*) - 1)/2e0 AS r2 FROM (SELECT q, rank() OVER (ORDER BY q) AS rq FROM s) GROUP BY q)
  SELECT k, round(5e-1*r1/n + 5e-1*r2/n, 9) AS blend FROM s JOIN ra USING (p) JOIN rb USING (q), n""")
def w30(v):
    s = v.scores.select("k", "p", (c("disc") + (lit(1) - c("disc") * c("p"))).alias("q"))
    r = wn.average_rank(wn.average_rank(s, [], "p", "r1"), [], "q", "r2")
    n = s.select(F.count(lit(1))).scalar()
    return r.select("k", R(lit(0.5) * c("r1") / n + lit(0.5) * c("r2") / n, 9).alias("blend"))


@query("W16_segment_anomaly", """WITH p AS (SELECT station % 6 AS seg, dn, avg(value) AS v FROM station_obs GROUP BY 1, 2), a AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM p WINDOW w AS (PARTITION BY seg ORDER BY dn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
  SELECT dn, round(coalesce(max(abs((v-m)/greatest(s, 1e-3))), 0), 5) AS segment_max, 0.0 + round(CASE WHEN count(*) >= 3 THEN regr_slope(v, seg) ELSE 0 END, 5) AS spatial_gradient FROM a GROUP BY dn""")
def w16(v):
    p = v.station_obs.groupBy((c("station") % 6).alias("seg"), "dn").agg(F.avg("value").alias("v"))
    w = W.partitionBy("seg").orderBy("dn").rowsBetween(-30, -1)
    a = p.withColumns({"m": F.avg("v").over(w), "s": F.stddev_pop("v").over(w)})
    return a.groupBy("dn").agg(R(F.coalesce(F.max(F.abs((c("v") - c("m")) / F.greatest("s", lit(1e-3)))), lit(0.0)), 5).alias("segment_max"),
                               R(F.when(F.count(lit(1)) >= 3, F.regr_slope(c("v"), c("seg"))).otherwise(0.0), 5).alias("spatial_gradient"))


def lag_correlation(hours, counts, metric, key, max_lag=48, min_pairs=20):
    """Pearson r of event counts with a metric shifted by -max_lag..0 positions on the shared hour index."""
    h = hours.withColumn("i", F.row_number().over(W.partitionBy(lit(0)).orderBy("h")))  # one row per hour of the catalogue
    t = h.join(counts, "h", "left").select("i", F.coalesce("n_eq", lit(0)).alias("n_eq"))
    m = metric.join(h, "h").select(key, "v", F.explode(F.sequence(lit(-max_lag), lit(0))).alias("lag"), "i").withColumn("i", c("i") - c("lag"))
    g = m.join(t, "i").groupBy(key, "lag").agg(F.corr("n_eq", "v").alias("r"), F.count(lit(1)).alias("n"), F.stddev_pop("n_eq").alias("sx"), F.stddev_pop("v").alias("sy"))
    return g.where((c("n") >= min_pairs) & (c("sx") >= 1e-10) & (c("sy") >= 1e-10)).select(key, "lag", "r", "n")


_LAGSQL = """hs AS (SELECT h, row_number() OVER (ORDER BY h) AS i FROM (SELECT DISTINCT h FROM series)), t AS (SELECT i, coalesce(n, 0) AS x FROM hs LEFT JOIN (SELECT h, count(*) AS n FROM series WHERE name='error' GROUP BY 1) USING (h)),
  m AS (SELECT name, i, avg(value) AS y FROM series JOIN hs USING (h) WHERE name <> 'error' GROUP BY 1, 2), g AS (SELECT name, -k AS lag, corr(x, y) AS r, count(*) AS n FROM m JOIN range(49) r(k) ON true JOIN t ON t.i = m.i + k GROUP BY 1, 2 HAVING count(*) >= 20)"""


def lag_table(v):
    s = v.series
    hours = s.select("h").distinct()
    counts = s.where("name = 'error'").groupBy("h").agg(F.count(lit(1)).alias("n_eq"))
    metric = s.where("name <> 'error'").groupBy("name", "h").agg(F.avg("value").alias("v"))
    return lag_correlation(hours, counts, metric, "name")


@query("A39_lag_correlation", f"WITH {_LAGSQL} SELECT name, CAST(lag AS INT) AS lag, 0.0 + round(r, 6) AS r, n FROM g")
def a39(v):
    return lag_table(v).select("name", "lag", R(c("r")).alias("r"), "n")


@query("A39b_lag_peak", f"WITH {_LAGSQL} SELECT name, CAST(arg_max(lag, (abs(r), lag)) AS INT) AS peak_lag, 0.0 + round(arg_max(r, (abs(r), lag)), 6) AS r FROM g GROUP BY 1")
def a39b(v):
    return lag_table(v).groupBy("name").agg(F.max_by("lag", F.struct(F.abs("r"), "lag")).alias("peak_lag"), R(F.max_by("r", F.struct(F.abs("r"), "lag"))).alias("r"))
