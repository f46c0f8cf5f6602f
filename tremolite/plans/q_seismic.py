"""Declustering, magnitude-frequency, cycles, patterns, stress and forecast queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import physics as ph, scalar as sc, spatial as sp
from ..operators import aggregates as ag, blocks as bl, expand as ex, joins as jn, metrics as mt, ordered as od, sinks as sk, thresholds as th
from . import parents as pr, seismicity as se
from .q_basic import DAY, R
from .q_joins import CELL_SQL, ZONE_SQL, catalogue_cells, alarm_matches, alarms_targets, stress_sources, _AT, _KPA, _NEAR, _PAIR
from .registry import query

c, lit = F.col, F.lit
T0 = 788918400  # 1995-01-01T00:00:00Z

LINKS = """pairs AS (SELECT a.event_id, b.event_id AS pid, b.t AS pt, b.mag AS pmag, (a.t-b.t)/864e2 AS dt, sqrt(pow((a.lat-b.lat)*11132e-2,2)+pow((a.lon-b.lon)*11132e-2*cos(radians(a.lat)),2)) + 1e-1 AS r FROM quakes a JOIN quakes b ON b.t < a.t AND b.t >= a.t - 2592000),
  eta AS (SELECT *, dt*pow(r, 16e-1)*pow(10e0, -pmag) AS eta FROM pairs), links AS (SELECT event_id, arg_min(pid, (eta, -pt, -pid)) AS parent_id, min(eta) AS eta, arg_min(pmag, (eta, -pt, -pid)) AS parent_mag, arg_min(dt, (eta, -pt, -pid)) AS dt, arg_min(r, (eta, -pt, -pid)) AS r FROM eta GROUP BY 1)"""
VALLEY = LINKS + """, le AS (SELECT event_id, parent_id, log10(greatest(eta, 1e-20)) AS le FROM links), mm AS (SELECT min(le) AS lo, max(le) AS hi FROM le), hb AS (SELECT least(CAST(floor((le-lo)/((hi-lo)/5e1)) AS INT), 49) AS bin, count(*) AS k FROM le, mm GROUP BY 1),
  dn2 AS (SELECT r.i AS bin, coalesce(k, 0) AS k FROM range(50) r(i) LEFT JOIN hb ON hb.bin = r.i), sm AS (SELECT bin, sum(k) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5e0 AS s FROM dn2),
  va AS (SELECT arg_min(bin, (s, bin)) AS vb FROM sm WHERE bin BETWEEN 16 AND 31), th AS (SELECT vb, lo + (vb+5e-1)*((hi-lo)/5e1) AS thr FROM va, mm),
  cls AS (SELECT q.event_id, q.t, q.mag, le.parent_id, CASE WHEN le.le < (SELECT thr FROM th) THEN 'clustered' ELSE 'background' END AS cluster_class FROM quakes q LEFT JOIN le USING (event_id))"""
ROOTS = VALLEY + """, tree AS (SELECT event_id, event_id AS root FROM cls WHERE cluster_class = 'background' UNION ALL SELECT c.event_id, t.root FROM tree t JOIN cls c ON c.parent_id = t.event_id AND c.cluster_class = 'clustered')"""


J09 = f"WITH {LINKS} SELECT event_id, parent_id, round(log10(eta), 6) AS log_eta, parent_mag, round(dt, 9) AS dt_days, round(r, 5) AS dist_km FROM links"


def _links_out(p):
    return p.select("event_id", "parent_id", R(c("log_eta")).alias("log_eta"), "parent_mag", R(c("dt_days"), 9).alias("dt_days"), R(c("dist_km"), 5).alias("dist_km"))


@query("J09_nearest_parent", J09)
def j09(v):
    return _links_out(se.nearest_parents(v.quakes))


@query("J09b_bounded_parent", J09)
def j09b(v):
    return _links_out(pr.bounded_parents(v.quakes))


def links(v):
    """Links are read several times by what follows: written once."""
    return sk.materialized(se.nearest_parents(v.quakes), "links")


@query("A56_valley_threshold", f"WITH {VALLEY} SELECT CAST(vb AS INT) AS valley_bin, 0.0 + round(thr, 6) AS threshold FROM th")
def a56(v):
    return se.valley(links(v), "log_eta").select("valley_bin", R(c("threshold")).alias("threshold"))


def classed(v):
    return se.decluster(v.quakes, links(v))


@query("G04_declustering", f"WITH {VALLEY} SELECT cluster_class, count(*) AS n, round(avg(mag), 8) AS mean_mag FROM cls GROUP BY 1")
def g04(v):
    return classed(v).groupBy("cluster_class").agg(F.count(lit(1)).alias("n"), R(F.avg("mag"), 8).alias("mean_mag"))


@query("G05_sequence_trees", f"WITH RECURSIVE {ROOTS} SELECT event_id, root FROM tree")
def g05(v):
    return se.sequence_roots(classed(v))


@query("A55_sequence_statistics", f"""WITH RECURSIVE {ROOTS}, m AS (SELECT cls.*, tree.root FROM cls JOIN tree USING (event_id)), w AS (SELECT *, count(*) OVER w AS n, max(mag) OVER w AS mx, avg(mag) OVER w AS av, min(t) OVER w AS t0 FROM m WINDOW w AS (PARTITION BY root ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, root, cluster_class, n AS n_foreshocks, mx AS max_foreshock_mag, round(av, 8) AS mean_foreshock_mag, round(CASE WHEN n > 0 THEN (t-t0)/864e2 ELSE 0 END, 9) AS duration_days FROM w WHERE mag >= 5""")
def a55(v):
    cl = sk.materialized(classed(v), "classed")
    f = se.foreshocks(cl, se.sequence_roots(cl))
    return f.withColumn("mean_foreshock_mag", R(c("mean_foreshock_mag"), 8)).withColumn("duration_days", R(c("duration_days"), 9))


@query("A21_sliding_b", """WITH d AS (SELECT dn, mag FROM quakes), s AS (SELECT DISTINCT dn AS start FROM d UNION SELECT unnest(range((SELECT min(dn) FROM d), (SELECT max(dn) FROM d)))),
  g AS (SELECT start, count(*) AS n, avg(mag) AS m, min(mag) AS lo FROM s JOIN d ON dn >= start AND dn < start + 30 WHERE start + 30 <= (SELECT max(dn) FROM d) GROUP BY 1)
  SELECT start, n AS n_events, round(m, 9) AS m_mean, lo AS m_min, round(log10(exp(1))/(m-lo), 6) AS b_value, round(log10(n) + log10(exp(1))/(m-lo)*lo, 6) AS a_value FROM g WHERE n >= 10 AND m - lo > 1e-2""")
def a21(v):
    return ag.sliding_b(v.quakes, "dn", "mag", 30).select("start", "n_events", R(c("m_mean"), 9).alias("m_mean"), "m_min", R(c("b_value")).alias("b_value"), R(c("a_value")).alias("a_value"))


@query("A22b_b_uncertainty", f"""WITH g AS (SELECT {ZONE_SQL} AS zone, count(*) AS n, avg(mag) AS m, var_samp(mag) AS s FROM quakes WHERE mag >= 3 GROUP BY 1), b AS (SELECT *, log10(exp(1))/(m-295e-2) AS b FROM g WHERE n >= 20)
  SELECT zone, n, round(b, 6) AS b_value, round(23e-1*b*b*sqrt(s/n), 6) AS sigma_b FROM b""")
def a22b(v):
    g = v.quakes.where("mag >= 3").groupBy(sp.zone_of(c("lat"), c("lon")).alias("zone")).agg(*ag.magnitude_stats("mag"))
    return g.where("n >= 20").select("zone", "n", R(ph.b_aki(c("n"), c("m_mean"))).alias("b_value"), R(ph.b_sigma(c("n"), c("m_mean"), c("m_var"))).alias("sigma_b"))


@query("A23_b_before_events", """WITH w AS (SELECT unnest([7, 14, 30, 60, 90, 180]) AS days), p AS (SELECT a.event_id, a.depth_km, days, count(*) AS n, avg(b.mag) AS m, min(b.mag) AS lo FROM quakes a JOIN quakes b ON b.t < a.t AND b.t >= a.t - 180*86400 AND abs(a.lat-b.lat) <= 3 AND abs(a.lon-b.lon) <= 3, w WHERE a.mag >= 5 AND b.t >= a.t - days*86400 GROUP BY 1,2,3),
  g AS (SELECT days, CASE WHEN depth_km < 30 THEN 'shallow' WHEN depth_km < 70 THEN 'mid' ELSE 'deep' END AS depth_class, log10(exp(1))/(m-lo) AS b FROM p WHERE n >= 10 AND m - lo > 1e-2)
  SELECT days, depth_class, count(*) AS n, round(avg(b), 6) AS mean_b FROM g GROUP BY 1,2""")
def a23(v):
    q = v.quakes
    t = q.where("mag >= 5").select("event_id", "t", "lat", "lon", F.when(c("depth_km") < 30, "shallow").when(c("depth_km") < 70, "mid").otherwise("deep").alias("depth_class"))
    days = [7, 14, 30, 60, 90, 180]
    n = bl.window_sums(t, q.select("event_id", "t", "lat", "lon", "mag"), ["event_id", "depth_class"], days, 3.0, ["mag"])
    w = [F.struct(lit(d).alias("days"), c(f"n{d}").alias("n"), F.try_divide(c(f"sum_mag{d}"), c(f"n{d}")).alias("m"), c(f"min_mag{d}").alias("lo")) for d in days]
    g = n.select("depth_class", F.inline(F.array(*w)))
    g = g.withColumn("b", ph.b_min(c("n"), c("m"), c("lo"), 10)).where("b IS NOT NULL")
    return g.groupBy("days", "depth_class").agg(F.count(lit(1)).alias("n"), R(F.avg("b")).alias("mean_b"))


@query("A25_natural_time", """WITH r AS (SELECT ci, cj, mag, row_number() OVER (PARTITION BY ci, cj ORDER BY t, event_id) AS k, count(*) OVER (PARTITION BY ci, cj) AS n FROM quakes), q AS (SELECT ci, cj, max(n) AS n, sum(pow(10e0, 15e-1*mag)) AS q, sum(pow(10e0, 15e-1*mag)*k/n) AS q1, sum(pow(10e0, 15e-1*mag)*(k/n)*(k/n)) AS q2 FROM r GROUP BY 1,2 HAVING max(n) >= 6)
  SELECT ci, cj, n, round(q2/q - pow(q1/q, 2), 7) AS kappa1 FROM q""")
def a25(v):
    return ag.kappa1(v.quakes, ["ci", "cj"], "t", ["event_id"], "mag").select("ci", "cj", "n", R(c("kappa1"), 7).alias("kappa1"))


@query("W29_regional_kappa", """WITH p AS (SELECT a.event_id, b.mag, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t DESC, b.event_id DESC) AS rk FROM quakes a JOIN quakes b ON b.t < a.t AND b.t >= a.t - 365*86400 AND abs(a.lat-b.lat) <= 2 AND abs(a.lon-b.lon) <= 2 WHERE a.mag >= 5),
  l AS (SELECT event_id, mag, count(*) OVER (PARTITION BY event_id) AS n, rk FROM p WHERE rk <= 50), k AS (SELECT event_id, n, mag, (n - rk + 1)/n AS chi FROM l), g AS (SELECT event_id, max(n) AS n, sum(pow(10e0, 15e-1*mag)) AS q, sum(pow(10e0, 15e-1*mag)*chi) AS q1, sum(pow(10e0, 15e-1*mag)*chi*chi) AS q2 FROM k GROUP BY 1 HAVING max(n) >= 6)
  SELECT event_id, n, round(q2/q - pow(q1/q, 2), 7) AS kappa1 FROM g""")
def w29(v):
    q = v.quakes
    e = q.select(*[c(x).alias(f"e_{x}") for x in ("event_id", "t", "lat", "lon", "mag")])
    l = th.top_k_within(q.where("mag >= 5").select("event_id", "t", "lat", "lon"), e, ["event_id"], 50, ("t", "e_t", 365 * DAY), ("lat", "lon", "e_lat", "e_lon", 2.0),
                        "e_t", 5.0 * DAY, [F.desc("e_event_id")]).withColumn("n", F.count(lit(1)).over(W.partitionBy("event_id")))
    qq, chi = ph.p10(lit(1.5) * c("e_mag")), (c("n") - c("rk") + 1) / c("n")
    g = l.groupBy("event_id").agg(F.max("n").alias("n"), F.sum(qq).alias("q"), F.sum(qq * chi).alias("q1"), F.sum(qq * chi * chi).alias("q2")).where("n >= 6")
    return g.select("event_id", "n", R(c("q2") / c("q") - F.pow(c("q1") / c("q"), 2), 7).alias("kappa1"))


_CYC = """r AS (SELECT ci, cj, event_id, mag, sum(CASE WHEN mag >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY ci, cj ORDER BY t, event_id) - CASE WHEN mag >= 5 THEN 1 ELSE 0 END AS cyc FROM quakes),
  g AS (SELECT ci, cj, cyc, count(*) FILTER (mag < 5) AS n, max(CASE WHEN mag >= 5 THEN 1 ELSE 0 END) AS closed, arg_max(event_id, mag) FILTER (mag >= 5) AS event_id FROM r GROUP BY 1,2,3)"""


@query("A26_cycle_lengths", f"WITH {_CYC} SELECT ci, cj, CAST(cyc AS BIGINT) AS cyc, n, closed FROM g WHERE n > 0")
def a26(v):
    return se.cycles(v.quakes, ["ci", "cj"])


@query("W17_potential_score", f"""WITH {_CYC}, t AS (SELECT ci, cj, event_id, n FROM g WHERE closed = 1 AND n > 0), s AS (SELECT a.event_id, a.ci, a.cj, a.n, count(*) AS own, count(*) FILTER (b.n < a.n) AS below FROM t a JOIN t b ON a.ci=b.ci AND a.cj=b.cj GROUP BY 1,2,3,4),
  o AS (SELECT a.event_id, count(*) AS al, count(*) FILTER (b.n < a.n) AS ab FROM t a, t b GROUP BY 1)
  SELECT event_id, ci, cj, n AS count, round(100*CASE WHEN own >= 5 THEN below/own ELSE ab/al END, 6) AS eps FROM s JOIN o USING (event_id)""")
def w17(v):
    return se.potential_scores(v.quakes, ["ci", "cj"]).withColumn("eps", R(c("eps")))


_LHA = "((28046061837e-8 + 36098564736629e-11*((t-946728000)/864e2)) % 36e1 + lon - (2183165e-4 + 4812678813e-4*((t-946728000)/864e2/36525e0)) % 36e1)"


@query("F11_tidal_phase", """WITH a AS (SELECT event_id, (t-946728000)/864e2 AS d, lon FROM quakes), b AS (SELECT event_id, ((28046061837e-8 + 36098564736629e-11*d) % 36e1 + 36e1) % 36e1 AS g, ((2183165e-4 + 4812678813e-4*(d/36525e0)) % 36e1 + 36e1) % 36e1 AS m, lon FROM a),
  h AS (SELECT event_id, (g + lon - m + 72e1) % 36e1 AS lha FROM b) SELECT event_id, round(lha, 4) AS lha, CAST(((2*lha) % 36e1 - 200 + 36e1) % 36e1 < 90 OR ((2*lha) % 36e1 - 200 + 36e1) % 36e1 BETWEEN 180 AND 269999999e-6 AS INT) AS loading FROM h""")
def f11(v):
    return v.quakes.select("event_id", R(ph.lunar_hour_angle(c("t"), c("lon")), 4).alias("lha"), ph.tidal_loading(c("t"), c("lon"), lit(200.0)).cast("int").alias("loading"))


@query("A27_load_unload_ratio", """WITH a AS (SELECT t, lat, lon, mag, (t-946728000)/864e2 AS d, CASE WHEN depth_km > 70 THEN 200 WHEN lon > 142 AND lat > 35 THEN 200 WHEN lon < 137 AND lat < 35 THEN 240 ELSE 200 END AS strike FROM quakes),
  b AS (SELECT *, (((28046061837e-8 + 36098564736629e-11*d) % 36e1 + 36e1) % 36e1 + lon - ((2183165e-4 + 4812678813e-4*(d/36525e0)) % 36e1 + 36e1) % 36e1 + 72e1) % 36e1 AS lha FROM a),
  e AS (SELECT t, lat, lon, pow(10e0, 7e-1*mag) AS en, ((2*lha) % 36e1 - strike + 36e1) % 36e1 AS ph FROM b),
  p AS (SELECT q.event_id, count(*) AS n, sum(CASE WHEN ph < 90 OR (ph >= 180 AND ph < 270) THEN en ELSE 0 END) AS l, sum(CASE WHEN ph < 90 OR (ph >= 180 AND ph < 270) THEN 0 ELSE en END) AS u FROM quakes q JOIN e ON e.t < q.t AND e.t >= q.t - 365*86400 AND abs(q.lat-e.lat) <= 2 AND abs(q.lon-e.lon) <= 2 WHERE q.mag >= 5 GROUP BY 1)
  SELECT event_id, n, round(l/u, 6) AS lurr FROM p WHERE n >= 10 AND u >= 1e-10""")
def a27(v):
    q = v.quakes
    return se.load_ratio(q.where("mag >= 5"), q, days=365).withColumn("lurr", R(c("lurr")))


_YF = "CAST(dn - 9131 AS DOUBLE)/36525e-2"


def halves(v):
    """Half-degree row/column index and years since the catalogue start."""
    return v.quakes.select("lat", "lon", "mag", "t", "event_id", sp.snap(c("lat"), 0.5, "index", 25.0).alias("row"), sp.snap(c("lon"), 0.5, "index", 125.0).alias("col"),
                           ((c("dn") - 9131).cast("double") / lit(365.25)).alias("yf"))


@query("A28_cell_rates", f"""SELECT CAST(floor((lat-25)/5e-1) AS INT) AS "row", CAST(floor((lon-125)/5e-1) AS INT) AS col, CAST(floor({_YF}) AS INT) AS yr, count(*) AS n_rate, round(sum(pow(10e0, 75e-2*mag)), 3) AS energy_rate FROM quakes GROUP BY 1,2,3""")
def a28(v):
    return halves(v).groupBy("row", "col", F.floor("yf").cast("int").alias("yr")).agg(F.count(lit(1)).alias("n_rate"), R(F.sum(ph.p10(lit(0.75) * c("mag"))), 3).alias("energy_rate"))


_PI = f"""h AS (SELECT CAST(floor((lat-25)/5e-1) AS INT) AS rw, CAST(floor((lon-125)/5e-1) AS INT) AS cl, {_YF} AS yf FROM quakes), a AS (SELECT rw, cl, {', '.join(f'count(*) FILTER (yf < 4 AND least(floor(yf/8e-1), 4) = {i})/8e-1 AS s{i}' for i in range(5))}, count(*) FILTER (yf >= 4 AND yf < 6)/2e0 AS an FROM h WHERE yf >= 0 AND yf < 6 GROUP BY 1,2),
  l AS (SELECT rw, cl, an, unnest([s0,s1,s2,s3,s4]) AS s FROM a), b AS (SELECT rw, cl, any_value(an) AS an, avg(s) AS m, stddev_pop(s) AS sd, var_pop(s) AS vp FROM l GROUP BY 1,2),
  pi AS (SELECT rw, cl, vp/pow(CASE WHEN sd >= 1e-12 THEN sd WHEN m > 1e-12 THEN m END, 2) AS pi FROM b)"""


def pi_map(v):
    return se.pattern_scores(halves(v), ["row", "col"], "yf", (0.0, 4.0), (4.0, 6.0))


@query("A29_pattern_score", f"""WITH {_PI.replace('count(*) FILTER (yf < 4', 'sum(mag-2) FILTER (yf < 4').replace('count(*) FILTER (yf >= 4', 'sum(mag-2) FILTER (yf >= 4').replace('AS yf FROM', 'AS yf, mag FROM').replace('unnest([s0,s1,s2,s3,s4])', 'unnest([coalesce(s0,0),coalesce(s1,0),coalesce(s2,0),coalesce(s3,0),coalesce(s4,0)])')}
  SELECT rw AS "row", cl AS col, round(pi, 5) AS pi FROM pi WHERE pi > 1e-9""")
def a29(v):
    p = se.pattern_scores(halves(v), ["row", "col"], "yf", (0.0, 4.0), (4.0, 6.0), weight=c("mag") - 2)
    return p.where("pi > 1e-9").select("row", "col", R(c("pi"), 5).alias("pi"))


def hot_cells(v):
    """Activity ratio of the last period per cell, used as a continuous score."""
    h = halves(v)
    return h.groupBy("row", "col").agg(F.sum(F.when(c("yf") < 4, c("mag") - 2).otherwise(0.0)).alias("base"), F.sum(F.when(c("yf") >= 4, c("mag") - 2).otherwise(0.0)).alias("late")).withColumn(
        "score", c("late") / (c("base") + 1))


_HOT = f"""h AS (SELECT event_id, CAST(floor((lat-25)/5e-1) AS INT) AS rw, CAST(floor((lon-125)/5e-1) AS INT) AS cl, {_YF} AS yf, mag FROM quakes), s AS (SELECT rw, cl, sum(CASE WHEN yf >= 4 THEN mag-2 ELSE 0 END)/(sum(CASE WHEN yf < 4 THEN mag-2 ELSE 0 END)+1) AS score FROM h GROUP BY 1,2)"""


@query("T04_top_percent_cells", f"""WITH {_HOT}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS rk, count(*) OVER () AS n FROM s), th AS (SELECT unnest([1,5,10,20,30,50]) AS pct), cut AS (SELECT pct, max(score) AS cut FROM th, r WHERE rk = greatest(1, CAST(floor(n*pct/1e2) AS BIGINT)) GROUP BY 1),
  tg AS (SELECT rw, cl FROM h WHERE mag >= 5), ts AS (SELECT score FROM tg JOIN s USING (rw, cl))
  SELECT pct, (SELECT count(*) FROM s WHERE score >= cut) AS n_hot, (SELECT count(*) FROM ts WHERE score >= cut) AS n_hits, round((SELECT count(*) FROM ts WHERE score >= cut)/(SELECT count(*) FROM ts), 6) AS hit_rate, round((SELECT count(*) FROM s WHERE score >= cut)/(SELECT count(*) FROM s), 6) AS area_fraction FROM cut""")
def t04(v):
    s = hot_cells(v)
    tg = v.quakes.where("mag >= 5").groupBy(sp.snap(c("lat"), 0.5, "index", 25.0).alias("row"), sp.snap(c("lon"), 0.5, "index", 125.0).alias("col")).agg(F.count(lit(1)).alias("hits"))
    s = s.select("row", "col", "score").join(tg, ["row", "col"], "left").withColumn("hits", F.coalesce("hits", lit(0)))
    # ties share one row of the score table, running counts give hot cells and hits at every cutoff
    g = s.groupBy("score").agg(F.count(lit(1)).alias("k"), F.sum("hits").alias("hh")).withColumn("neg", -c("score"))
    r = od.running(g, [], "neg", {"cells": c("k"), "hit": c("hh")}, totals=True)
    p = ex.with_values(r, [1, 5, 10, 20, 30, 50], "pct")
    need = F.greatest(lit(1), F.floor(c("cells_total") * c("pct") / lit(100.0)))
    p = p.where((c("cells") >= need) & (c("cells") - c("k") < need))
    return p.select("pct", c("cells").alias("n_hot"), c("hit").alias("n_hits"), R(c("hit") / c("hit_total")).alias("hit_rate"), R(c("cells") / c("cells_total")).alias("area_fraction"))


@query("A30_hotspot_overlap", f"""WITH h AS (SELECT ci, cj, CAST(floor({_YF}) AS INT) AS yr FROM quakes), n AS (SELECT yr, ci, cj, count(*) AS n FROM h GROUP BY 1,2,3), r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY n DESC, ci, cj) AS rk, count(*) OVER (PARTITION BY yr) AS m FROM n), t AS (SELECT * FROM r WHERE rk <= greatest(1, CAST(floor(m*1e-1) AS BIGINT))),
  k AS (SELECT yr, count(*) AS k FROM t GROUP BY 1), o AS (SELECT a.yr, count(*) AS bth FROM t a JOIN t b ON b.yr = a.yr-1 AND a.ci=b.ci AND a.cj=b.cj GROUP BY 1)
  SELECT k.yr, k.k AS n_hot, round(coalesce(bth,0)/(k.k + p.k - coalesce(bth,0)), 6) AS jaccard FROM k JOIN k p ON p.yr = k.yr-1 LEFT JOIN o ON o.yr = k.yr""")
def a30(v):
    n = v.quakes.groupBy(F.floor((c("dn") - 9131).cast("double") / lit(365.25)).cast("int").alias("yr"), "ci", "cj").agg(F.count(lit(1)).alias("n"))
    w = W.partitionBy("yr")  # cells of one year
    t = n.withColumns({"rk": F.row_number().over(w.orderBy(F.desc("n"), "ci", "cj")), "m": F.count(lit(1)).over(w)}).where(c("rk") <= F.greatest(lit(1), F.floor(c("m") * 0.1)))
    # a cell that is hot in year y also marks year y+1: one grouping gives both sizes and the overlap
    marks = t.select("yr", "ci", "cj", lit(1).alias("now"), lit(0).alias("prev")).unionByName(t.select((c("yr") + 1).alias("yr"), "ci", "cj", lit(0).alias("now"), lit(1).alias("prev")))
    g = marks.groupBy("yr", "ci", "cj").agg(F.max("now").alias("now"), F.max("prev").alias("prev")).groupBy("yr").agg(
        F.sum("now").alias("n_hot"), F.sum("prev").alias("n_prev"), F.sum(c("now") * c("prev")).alias("both"))
    return g.where("n_hot > 0 AND n_prev > 0").select("yr", "n_hot", R(c("both") / (c("n_hot") + c("n_prev") - c("both"))).alias("jaccard"))


@query("A69_score_at_events", f"""WITH {_HOT}, ts AS (SELECT score FROM (SELECT rw, cl FROM h WHERE mag >= 5) JOIN s USING (rw, cl)), q AS (SELECT quantile_cont(score, 0.75) AS q75 FROM s)
  SELECT round(q75, 6) AS q75, (SELECT count(*) FROM ts) AS n_events, round((SELECT avg(CAST(score >= q75 AS INT)) FROM ts), 6) AS event_share, round((SELECT avg(CAST(score >= q75 AS INT)) FROM s), 6) AS cell_share, round((SELECT avg(CAST(score >= q75 AS INT)) FROM ts)/(SELECT avg(CAST(score >= q75 AS INT)) FROM s), 6) AS lift FROM q""")
def a69(v):
    s = hot_cells(v).select("row", "col", "score")
    q75 = od.exact_quantiles(s, [], "score", {"q75": 0.75}).select("q75").scalar()
    tg = v.quakes.where("mag >= 5").select(sp.snap(c("lat"), 0.5, "index", 25.0).alias("row"), sp.snap(c("lon"), 0.5, "index", 125.0).alias("col"))
    both = s.withColumn("w", lit(0)).unionByName(tg.join(s, ["row", "col"]).withColumn("w", lit(1))).withColumn("q75", q75)
    hot = (c("score") >= c("q75")).cast("double")
    g = both.agg(F.max("q75").alias("q"), F.count_if(c("w") == 1).alias("n_events"), F.avg(F.when(c("w") == 1, hot)).alias("es"), F.avg(F.when(c("w") == 0, hot)).alias("cs"))
    return g.select(R(c("q")).alias("q75"), "n_events", R(c("es")).alias("event_share"), R(c("cs")).alias("cell_share"), R(c("es") / c("cs")).alias("lift"))


@query("A51_cell_base_rate", """WITH d AS (SELECT (max(t)-min(t))/864e2 AS days FROM quakes) SELECT ci, cj, round(count(*)*7/(SELECT greatest(days, 1) FROM d), 8) AS base_rate FROM quakes WHERE mag >= 5 GROUP BY 1,2""")
def a51(v):
    q = v.quakes
    days = q.select(F.greatest((F.max("t") - F.min("t")) / lit(86400.0), lit(1.0))).scalar()
    g = q.where("mag >= 5").groupBy("ci", "cj").agg(F.count(lit(1)).alias("k"))
    return g.select("ci", "cj", R(c("k") * 7 / days, 8).alias("base_rate"))


@query("A52_alarm_skill", f"""WITH {_AT}, n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_NEAR})) AS tp, (SELECT count(*) FROM b WHERE EXISTS (SELECT 1 FROM a WHERE {_NEAR})) AS m, (SELECT (max(t)-min(t))/864e2 FROM quakes) AS days),
  cr AS (SELECT ci, cj, count(*)*7/greatest((SELECT days FROM n), 1) AS r FROM quakes WHERE mag >= 52e-1 GROUP BY 1,2), ar AS (SELECT avg(coalesce(r, 1e-3)) AS base FROM quakes q LEFT JOIN cr USING (ci, cj) WHERE q.mag BETWEEN 45e-1 AND 5)
  SELECT na AS n_alarms, nb AS n_targets, tp, na-tp AS fp, nb-m AS fn, m AS matched_targets, round(tp/greatest(na,1), 6) AS precision, round(m/greatest(nb,1), 6) AS recall, round(base, 8) AS cell_base_rate, round(tp/greatest(na,1)/greatest(base, 1e-4), 4) AS probability_gain, round(log2(greatest(tp/greatest(na,1)/greatest(base, 1e-4), 1e-3)), 4) AS bits,
   round(na/greatest(days*50, 1), 8) AS alarm_fraction, round(m/greatest(nb,1) - na/greatest(days*50, 1), 6) AS molchan_score FROM n, ar""")
def a52(v):
    al, tg = alarms_targets(v)
    hit, got = alarm_matches(al, tg)
    q = v.quakes
    days = q.select((F.max("t") - F.min("t")) / lit(86400.0)).scalar()
    rate = q.where("mag >= 5.2").groupBy("ci", "cj").agg(F.count(lit(1)).alias("k"))
    alc = q.where("mag BETWEEN 4.5 AND 5").groupBy("ci", "cj").agg(F.count(lit(1)).alias("na")).join(rate, ["ci", "cj"], "left")
    g = alc.agg(F.sum("na").alias("na"), F.sum(c("na") * F.when(c("k").isNotNull(), c("k") * 7).cast("double")).alias("wk"), F.sum(F.when(c("k").isNull(), c("na")).otherwise(0)).alias("none"))
    g = g.select("na", "wk", "none", hit.select(F.count(lit(1))).scalar().alias("tp"), got.select(F.count(lit(1))).scalar().alias("m"),
                 tg.select(F.count(lit(1))).scalar().alias("nb"), days.alias("days"))
    g = g.withColumn("base", (F.coalesce("wk", lit(0.0)) / F.greatest("days", lit(1.0)) + c("none") * lit(0.001)) / c("na"))
    pr, rc = c("tp") / F.greatest(c("na"), lit(1)), c("m") / F.greatest(c("nb"), lit(1))
    gain = pr / F.greatest(c("base"), lit(1e-4))
    frac = c("na") / F.greatest(c("days") * 50, lit(1.0))
    return g.select(c("na").alias("n_alarms"), c("nb").alias("n_targets"), "tp", (c("na") - c("tp")).alias("fp"), (c("nb") - c("m")).alias("fn"), c("m").alias("matched_targets"),
                    R(pr).alias("precision"), R(rc).alias("recall"), R(c("base"), 8).alias("cell_base_rate"), R(gain, 4).alias("probability_gain"), R(F.log2(F.greatest(gain, lit(0.001))), 4).alias("bits"),
                    R(frac, 8).alias("alarm_fraction"), R(rc - frac).alias("molchan_score"))


@query("F03_fault_dimensions", """SELECT event_id, round(pow(10e0, -286e-2+63e-2*mag), 6) AS length_km, round(pow(10e0, -161e-2+41e-2*mag), 6) AS width_km, round(pow(10e0, 15e-1*mag+905e-2)/(32e9*pow(10e0, -286e-2+63e-2*mag)*1e3*pow(10e0, -161e-2+41e-2*mag)*1e3), 8) AS slip_m FROM quakes""")
def f03(v):
    l, w, s = ph.fault_dimensions(c("mag"))
    return v.quakes.select("event_id", R(l).alias("length_km"), R(w).alias("width_km"), R(s, 8).alias("slip_m"))


@query("F05_regional_mechanism", """SELECT CASE WHEN depth_km > 70 THEN 45 WHEN lon > 142 AND lat > 35 THEN 25 WHEN lon < 137 AND lat < 35 THEN 15 WHEN lat > 40 THEN 40 WHEN lon > 130 AND lon < 132 AND lat < 34 THEN 60 ELSE 35 END AS dip, count(*) AS n FROM quakes GROUP BY 1""")
def f05(v):
    return v.quakes.groupBy(ph.regional_mechanism(c("lat"), c("lon"), c("depth_km"))["dip"].cast("int").alias("dip")).agg(F.count(lit(1)).alias("n"))


@query("F06_stress_kernel", f"""SELECT q.event_id, s.event_id AS src_id, round({_KPA}, 6) AS kpa FROM quakes q JOIN quakes s ON s.mag >= 55e-1 AND s.t >= q.t - 315576000 AND s.t < q.t AND abs(q.lat-s.lat) <= 4 AND abs(q.lon-s.lon) <= 4 WHERE q.mag >= 5""")
def f06(v):
    p = stress_sources(v.quakes.where("mag >= 5"), v.quakes.where("mag >= 5.5"), max_km=4 * sp.DEG_KM)
    return p.select("event_id", "src_id", R(c("kpa")).alias("kpa"))


@query("F07_rate_state", """SELECT event_id, round(CASE WHEN abs(value_pa) < 1 OR dt <= 0 THEN 1e-2 ELSE 1e-2/(exp(greatest(least(-value_pa/1e4,50),-50)) + (1-exp(greatest(least(-value_pa/1e4,50),-50)))*exp(-dt/1825e0)) END, 8) AS rate FROM (SELECT event_id, (mag-4)*1e4 AS value_pa, CAST(depth_km AS DOUBLE)*10 AS dt FROM quakes)""")
def f07(v):
    return v.quakes.select("event_id", R(ph.rate_state((c("mag") - 4) * lit(1e4), lit(0.01), c("depth_km") * 10), 8).alias("rate"))


@query("F08_triggering_integral", """SELECT ci, cj, round(sum(4e-2*exp(mag-3)*greatest((pow(7e0+(1002000000-t)/864e2+1e-2, 1-11e-1) - pow((1002000000-t)/864e2+1e-2, 1-11e-1))/(1-11e-1), 0)), 7) AS expected_7d, round(sum(4e-2*exp(mag-3)/pow((1002000000-t)/864e2+1e-2, 11e-1)), 8) AS intensity FROM quakes GROUP BY 1,2""")
def f08(v):
    age = (lit(1002000000) - c("t")) / lit(86400.0)
    return v.quakes.groupBy("ci", "cj").agg(R(F.sum(ph.omori_integral(c("mag"), age, age + 7.0)), 7).alias("expected_7d"), R(F.sum(ph.omori(c("mag"), age)), 8).alias("intensity"))


FORECAST_SQL = CELL_SQL + """, q AS (SELECT *, (t-788918400)/864e2 AS day FROM quakes WHERE (t-788918400)/864e2 < 2000),
  cc AS (SELECT ci, cj, count(*) FILTER (mag>=5) AS m5, count(*) FILTER (mag>=3) AS m3 FROM q GROUP BY 1,2), g AS (SELECT cells.ci, cells.cj, coalesce(m5,0) AS m5, coalesce(m3,0) AS m3 FROM cells LEFT JOIN cc USING (ci, cj)),
  sm AS (SELECT g.ci, g.cj, sum(exp(-5e-1*(pow((g.ci-s.ci)*2,2)+pow((g.cj-s.cj)*2,2))/4e0)*s.m5)/sum(exp(-5e-1*(pow((g.ci-s.ci)*2,2)+pow((g.cj-s.cj)*2,2))/4e0)) AS sm FROM g, g s WHERE s.m5 > 0 GROUP BY 1,2),
  tr AS (SELECT g.ci, g.cj, sum(4e-2*exp(mag-3)*greatest((pow(2000e0-day+7+1e-2, 1-11e-1)-pow(2000e0-day+1e-2, 1-11e-1))/(1-11e-1), 0)*exp(-5e-1*(pow(lat-g.ci*2,2)+pow(lon-g.cj*2,2)))) AS tr FROM g JOIN q ON abs(lat-g.ci*2) <= 3 AND abs(lon-g.cj*2) <= 3 WHERE mag >= 4 AND day > 2000-365 GROUP BY 1,2),
  fc AS (SELECT ci, cj, (SELECT sum(m5) FROM g)/2000e0*7/(SELECT count(*) FROM g) AS uniform, coalesce(sm,0)/2000e0*7 AS smoothed, m3/greatest((SELECT sum(m3) FROM g),1)*((SELECT sum(m5) FROM g)/2000e0*7) AS relative_intensity, m5/2000e0*7 + coalesce(tr,0)*1e-2 AS simple_etas FROM g LEFT JOIN sm USING (ci, cj) LEFT JOIN tr USING (ci, cj))"""


def forecasts(v, start=2000, window=7):
    grid = catalogue_cells(v)
    return se.reference_forecasts(v.quakes, grid, start, window, T0)


MODELS = ["uniform", "smoothed", "relative_intensity", "simple_etas"]


@query("G13_reference_forecasts", f"WITH {FORECAST_SQL} SELECT ci, cj, round(uniform, 9) AS uniform, round(smoothed, 9) AS smoothed, round(relative_intensity, 9) AS relative_intensity, round(simple_etas, 9) AS simple_etas FROM fc")
def g13(v):
    return forecasts(v).select("ci", "cj", *[R(c(m), 9).alias(m) for m in MODELS])
