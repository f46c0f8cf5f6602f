"""Feature-matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import features as ft, feeds as fd
from .q_basic import R
from .q_joins import GRID_SQL, STEP, ZONE_SQL, base_grid, label_rows, step_range
from .registry import query

c, lit = F.col, F.lit
KEYS = ["ci", "cj", "step"]

# one row per (cell, step, event of the last 180 days before the step); age in days
PAST = f"""{GRID_SQL}, pe AS (SELECT b.ci, b.cj, b.step, q.event_id, q.t, q.mag, b.step*86400 - q.t AS age FROM base b JOIN quakes q ON q.ci=b.ci AND q.cj=b.cj AND q.t < b.step*86400 AND q.t >= (b.step-180)*86400)"""


def steps_of(v):
    return ft.windows_at_steps(ft.cell_day_table(v.quakes), base_grid(v))


def cat(v):
    return ft.catalogue_features(steps_of(v), ft.long_term_rates(v.quakes))


@query("W08_window_counts", f"""WITH {PAST}, a AS (SELECT ci, cj, step, count(*) FILTER (age <= 604800) AS n7, count(*) FILTER (age <= 14*86400) AS n14, count(*) FILTER (age <= 30*86400) AS n30, count(*) FILTER (age <= 90*86400) AS n90, count(*) AS n180,
   count(*) FILTER (age > 604800 AND age <= 14*86400) AS p7, count(*) FILTER (age > 30*86400 AND age <= 60*86400) AS p30 FROM pe GROUP BY 1,2,3)
  SELECT ci, cj, step, coalesce(n7,0) AS n7, coalesce(n14,0) AS n14, coalesce(n30,0) AS n30, coalesce(n90,0) AS n90, coalesce(n180,0) AS n180, coalesce(p7,0) AS p7, coalesce(p30,0) AS p30 FROM base LEFT JOIN a USING (ci, cj, step)""")
def w08(v):
    return steps_of(v).select(*KEYS, "n7", "n14", "n30", "n90", "n180", "p7", "p30")


@query("W09_window_max", f"""WITH {PAST}, a AS (SELECT ci, cj, step, max(mag) FILTER (age <= 604800) AS m7, max(mag) FILTER (age <= 30*86400) AS m30, max(mag) FILTER (age <= 3*86400) AS m3, max(mag) FILTER (age > 3*86400 AND age <= 6*86400) AS mp FROM pe GROUP BY 1,2,3)
  SELECT ci, cj, step, coalesce(m7,0) AS max_mag_7d, coalesce(m30,0) AS max_mag_30d, 0.0 + round(coalesce(m3,0)-coalesce(mp,0), 6) AS foreshock_mag_increase FROM base LEFT JOIN a USING (ci, cj, step)""")
def w09(v):
    return cat(v).select(*KEYS, "max_mag_7d", "max_mag_30d", R(c("foreshock_mag_increase")).alias("foreshock_mag_increase"))


@query("W10_step_trends", f"""WITH {PAST}, a AS (SELECT ci, cj, step, count(*) FILTER (age <= 604800) AS n7 FROM pe GROUP BY 1,2,3), s AS (SELECT ci, cj, step, coalesce(n7, 0) AS r FROM base LEFT JOIN a USING (ci, cj, step)),
  d AS (SELECT *, r - lag(r) OVER (PARTITION BY ci, cj ORDER BY step) AS df FROM s),
  w AS (SELECT ci, cj, step, regr_slope(r, step/3e0) OVER (p ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS sl, count(*) OVER (p ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS n9, var_pop(df) OVER (p ROWS BETWEEN 238 PRECEDING AND CURRENT ROW) AS vp, count(*) OVER (p ROWS BETWEEN 239 PRECEDING AND CURRENT ROW) AS n240,
   avg(r) OVER (p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3, avg(r) OVER (p ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS o3 FROM d WINDOW p AS (PARTITION BY ci, cj ORDER BY step))
  SELECT ci, cj, step, 0.0 + round(CASE WHEN n9 >= 3 THEN coalesce(sl, 0) ELSE 0 END, 7) AS rate_trend_slope, round(CASE WHEN n240 >= 4 THEN vp ELSE 0 END + 1e-11, 9) AS pi_score, 0.0 + round(CASE WHEN n240 >= 6 THEN r3 - o3 ELSE 0 END, 7) AS pi_trend FROM w""")
def w10(v):
    return cat(v).select(*KEYS, R(c("rate_trend_slope"), 7).alias("rate_trend_slope"), R(c("pi_score") + 1e-11, 9).alias("pi_score"), R(c("pi_trend"), 7).alias("pi_trend"))


@query("W11_gap_statistics", f"""WITH {PAST}, e AS (SELECT *, (t - lag(t) OVER (PARTITION BY ci, cj, step ORDER BY t, event_id))/864e2 AS gap FROM pe WHERE age <= 30*86400),
  a AS (SELECT ci, cj, step, count(*) AS n, count(*) FILTER (gap > 0) AS gn, avg(gap) FILTER (gap > 0) AS m, stddev_pop(gap) FILTER (gap > 0) AS s, count(*) FILTER (gap > 0 AND gap < 1) AS g1 FROM e GROUP BY 1,2,3)
  SELECT ci, cj, step, round(CASE WHEN gn >= 3 THEN s/greatest(m, 1e-6) ELSE 1 END, 5) AS inter_event_cv, round(CASE WHEN n >= 2 THEN g1/greatest(n-1, 1) ELSE 0 END, 7) AS cluster_fraction FROM base LEFT JOIN a USING (ci, cj, step)""")
def w11(v):
    return cat(v).select(*KEYS, R(c("inter_event_cv"), 5).alias("inter_event_cv"), R(c("cluster_fraction"), 7).alias("cluster_fraction"))


@query("W12_days_since", f"""WITH {GRID_SQL}, a AS (SELECT b.ci, b.cj, b.step, max(t) FILTER (mag >= 5) AS t5, max(t) AS t4 FROM base b JOIN quakes q ON q.ci=b.ci AND q.cj=b.cj AND q.t < b.step*86400 WHERE mag >= 4 GROUP BY 1,2,3)
  SELECT ci, cj, step, round(coalesce((step*86400 - t5)/864e2, 9999), 9) AS days_since_m5, round(coalesce((step*86400 - t4)/864e2, 9999), 9) AS days_since_m4, round(log10(coalesce((step*86400 - t5)/864e2, 9999) + 1), 9) AS log_days_since_m5 FROM base LEFT JOIN a USING (ci, cj, step)""")
def w12(v):
    return cat(v).select(*KEYS, *[R(c(x), 9).alias(x) for x in ("days_since_m5", "days_since_m4", "log_days_since_m5")])


RATE7 = f"""{PAST}, a AS (SELECT ci, cj, step, count(*) FILTER (age <= 604800) AS n7, max(mag) FILTER (age <= 604800) AS m7 FROM pe GROUP BY 1,2,3), s AS (SELECT ci, cj, step, coalesce(n7, 0) AS r, coalesce(m7, 0) AS m FROM base LEFT JOIN a USING (ci, cj, step))"""


def spatial(v):
    x = cat(v)
    rates, grid = ft.long_term_rates(v.quakes), base_grid(v)
    x = x.join(ft.stress_features(ft.stress_pairs(v.quakes), grid, rates), KEYS).withColumn("etas_residual_7d", lit(0.0))
    return ft.spatial_features(x)


@query("W14_zone_ratio", f"""WITH {RATE7}, z AS (SELECT *, {ZONE_SQL.replace('lat', 'ci*2').replace('lon', 'cj*2')} AS zone FROM s), m AS (SELECT *, avg(r) OVER (PARTITION BY zone, step) AS zm FROM z)
  SELECT ci, cj, step, zone, round(r/greatest(CASE WHEN zm > 0 THEN zm ELSE r END, 1e-1), 6) AS zone_rate_anomaly FROM m""")
def w14(v):
    return spatial(v).select(*KEYS, "zone", R(c("zone_rate_anomaly")).alias("zone_rate_anomaly"))


@query("W15_neighbour_stats", f"""WITH {RATE7}, n AS (SELECT a.ci, a.cj, a.step, CAST(sum(b.r) AS BIGINT) AS nr, max(b.m) AS nm FROM s a JOIN s b ON a.step=b.step AND abs(a.ci-b.ci)<=1 AND abs(a.cj-b.cj)<=1 AND NOT (a.ci=b.ci AND a.cj=b.cj) GROUP BY 1,2,3)
  SELECT ci, cj, step, nr AS neighbor_rate_sum, nm AS neighbor_max_mag, round(r/greatest(nr/8e0, 1e-1), 6) AS rate_spatial_anomaly, 0.0 + round(r - nr/8e0, 6) AS spatial_gradient FROM s JOIN n USING (ci, cj, step)""")
def w15(v):
    return spatial(v).select(*KEYS, c("neighbor_rate_sum").cast("long").alias("neighbor_rate_sum"), c("neighbor_max_mag").cast("double").alias("neighbor_max_mag"),
                             R(c("rate_spatial_anomaly")).alias("rate_spatial_anomaly"), R(c("spatial_gradient")).alias("spatial_gradient"))


@query("A24_benioff", f"""WITH {PAST}, a AS (SELECT ci, cj, step, sum(pow(10e0, 75e-2*mag+24e-1)) FILTER (age <= 30*86400) AS b30, sum(pow(10e0, 75e-2*mag+24e-1)) FILTER (age > 30*86400 AND age <= 60*86400) AS bp, sum(pow(10e0, 75e-2*mag+24e-1)) FILTER (age <= 604800) AS b7 FROM pe GROUP BY 1,2,3)
  SELECT ci, cj, step, round(coalesce(b30,0), 2) AS benioff_strain_30d, round(coalesce(b30,0)/greatest(coalesce(bp,0), 1), 2) AS benioff_accel, round(pow(coalesce(b7,0),2)/greatest(pow(coalesce(b30,0),2), 1), 6) AS energy_ratio FROM base LEFT JOIN a USING (ci, cj, step)""")
def a24(v):
    return cat(v).select(*KEYS, R(c("benioff_strain_30d"), 2).alias("benioff_strain_30d"), R(c("benioff_accel"), 2).alias("benioff_accel"), R(c("energy_ratio")).alias("energy_ratio"))


@query("A22_b_value_90d", f"""WITH {PAST}, a AS (SELECT ci, cj, step, count(*) AS n, avg(mag) AS m, var_samp(mag) AS vs FROM pe WHERE age <= 90*86400 GROUP BY 1,2,3)
  SELECT ci, cj, step, round(coalesce(CASE WHEN n >= 20 AND m - 295e-2 > 1e-2 THEN log10(exp(1))/(m - 295e-2) END, 1), 6) AS b_value FROM base LEFT JOIN a USING (ci, cj, step)""")
def a22(v):
    return cat(v).select(*KEYS, R(c("b_value")).alias("b_value"))


@query("J12b_foreshock_boxes", f"""WITH {GRID_SQL}, o AS (SELECT CAST(round_even(lat,0) AS INT) AS a, CAST(round_even(lon,0) AS INT) AS b, t FROM quakes), n AS (SELECT s.ci, s.cj, s.step, count(*) AS n FROM base s JOIN o ON abs(o.a - 2*s.ci) <= 1 AND abs(o.b - 2*s.cj) <= 1 AND o.t < s.step*86400 AND o.t >= (s.step-7)*86400 GROUP BY 1,2,3)
  SELECT ci, cj, step, coalesce(n, 0) AS n_foreshock FROM base LEFT JOIN n USING (ci, cj, step)""")
def j12b(v):
    return cat(v).select(*KEYS, "n_foreshock")


_SRC = """src AS (SELECT t, lat, lon, depth_km, mag FROM quakes WHERE mag >= 55e-1), pr AS (SELECT c.ci, c.cj, s.t, CASE WHEN r < 500 THEN 0 ELSE pow(10e0, 15e-1*mag+905e-2)/(8*pi()*pow(r,3)) END AS pa FROM
   (SELECT c.ci, c.cj, s.*, sqrt(pow((c.cj*2e0-s.lon)*11132e-2*cos(radians(s.lat))*1e3,2)+pow((c.ci*2e0-s.lat)*111320e0,2)+pow((15e0-s.depth_km)*1e3,2)) AS r FROM cells c JOIN src s ON abs(s.lat-c.ci*2)*11132e-2 <= 300 AND abs(s.lon-c.cj*2)*11132e-2 <= 300) s, (SELECT 1) x, LATERAL (SELECT s.ci, s.cj) c)"""


@query("G01_stress_map", f"""WITH {GRID_SQL}, {_SRC}, lt AS (SELECT ci, cj, count(*)/greatest((SELECT (max(t)-min(t))/864e2 FROM quakes), 1) AS lt FROM quakes GROUP BY 1,2),
  a AS (SELECT b.ci, b.cj, b.step, sum(pa)/1e3 AS cum, sum(CASE WHEN b.step*86400 - t < 365*86400 THEN pa END)/1e3 AS rec,
   max(CASE WHEN b.step*86400 > t AND pa >= 1 THEN 1/(exp(greatest(-pa/1e4, -50)) + (1-exp(greatest(-pa/1e4, -50)))*exp(-(b.step*86400 - t)/864e2/1825e0)) ELSE 1 END) AS rs FROM base b JOIN pr ON pr.ci=b.ci AND pr.cj=b.cj AND pr.t <= b.step*86400 GROUP BY 1,2,3)
  SELECT ci, cj, step, round(coalesce(cum,0), 5) AS cfs_cumulative_kpa, round(coalesce(rec,0), 5) AS cfs_recent_kpa, round(greatest(coalesce(rs,1),1), 5) AS cfs_rate_state FROM base LEFT JOIN a USING (ci, cj, step)""")
def g01(v):
    q = v.quakes
    s = ft.stress_features(ft.stress_pairs(q), base_grid(v), ft.long_term_rates(q))
    return s.select(*KEYS, *[R(c(x), 5).alias(x) for x in ("cfs_cumulative_kpa", "cfs_recent_kpa", "cfs_rate_state")])


def _dens(w):
    return " + ".join(f"1/pow((step-{w})*1e0 + {w}*{(k + 0.5) / 7!r}e0 - t/864e2 + 1e-2, 11e-1)" for k in range(7))


@query("G02_etas_residual", f"""WITH {GRID_SQL}, mu AS (SELECT ci, cj, greatest(3e-1*count(*)/greatest((SELECT (max(t)-min(t))/864e2 FROM quakes), 1), 1e-2) AS mu FROM quakes GROUP BY 1,2),
  r AS (SELECT ci, cj, t, mag FROM quakes), n AS (SELECT b.ci, b.cj, b.step, count(*) FILTER (t >= (step-7)*86400) AS n7, count(*) FILTER (t >= (step-30)*86400) AS n30,
   sum(CASE WHEN t < (step-7)*86400 THEN 4e-2*exp(mag-3)*({_dens(7)})*7/7e0 END) AS x7, sum(CASE WHEN t < (step-30)*86400 THEN 4e-2*exp(mag-3)*({_dens(30)})*30/7e0 END) AS x30 FROM base b JOIN r ON r.ci=b.ci AND r.cj=b.cj AND r.t < b.step*86400 GROUP BY 1,2,3)
  SELECT ci, cj, step, round(coalesce(n7,0)/greatest(coalesce(mu,1e-2)*7+coalesce(x7,0), 1e-1), 5) AS etas_residual_7d, round(coalesce(n30,0)/greatest(coalesce(mu,1e-2)*30+coalesce(x30,0), 1e-1), 5) AS etas_residual_30d FROM base LEFT JOIN n USING (ci, cj, step) LEFT JOIN mu USING (ci, cj)""")
def g02(v):
    q, grid = v.quakes, base_grid(v)
    t = ft.triggering_residuals(cat(v), ft.triggering_expected(q, grid))
    return t.select(*KEYS, R(c("etas_residual_7d"), 5).alias("etas_residual_7d"), R(c("etas_residual_30d"), 5).alias("etas_residual_30d"))


@query("G06_feature_matrix")
def g06(v):
    """Catalogue and feed features with the labels of three targets (magnitude, days ahead)."""
    m = ft.catalogue_matrix(v.quakes, base_grid(v)).join(fd.feed_table(v, base_grid(v)), KEYS)
    for name, mag, days in (("label", 5.0, 7), ("label_m55", 5.5, 7), ("label_m6", 6.0, 14)):
        hits = label_rows(v.quakes.where(c("mag") >= mag), days, STEP, *step_range(v)).withColumn(name, lit(1))
        m = m.join(hits, KEYS, "left").withColumn(name, F.coalesce(name, lit(0)))
    return m
