"""Joins, set operations and expansions (J*, U*, P13)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import physics as ph, spatial as sp
from ..operators import aggregates as ag, blocks as bl, expand as ex, joins as jn, thresholds as th
from .q_basic import DAY, R
from .registry import query

c, lit = F.col, F.lit


@query("J01_hour_alignment", """SELECT h, count(*) FILTER (name='error') AS n_events, round(avg(value) FILTER (name='click'), 6) AS m_click,
  round(avg(value) FILTER (name='view'), 6) AS m_view, round(avg(value) FILTER (name='purchase'), 6) AS m_purchase, round(avg(value) FILTER (name='signup'), 6) AS m_signup
  FROM series GROUP BY h""")
def j01(v):
    metric = lambda n: R(F.avg(F.when(c("name") == n, c("value")))).alias(f"m_{n}")
    # one pass replaces the chain of outer joins: every hour of any series appears, counts default to 0
    return v.series.groupBy("h").agg(F.count_if(c("name") == "error").alias("n_events"), *[metric(n) for n in ("click", "view", "purchase", "signup")])


def with_mechanism(quakes, mechanisms):
    """Mechanism by coordinates rounded to 0.1 degree (last entry wins), regional default when there is none."""
    m = ag.latest_per_key(mechanisms, ["mi", "mj"], ["mid"]).select("mi", "mj", "strike", "dip", "rake")
    q = quakes.withColumn("mi", sp.cell_index(c("lat"), 0.1)).withColumn("mj", sp.cell_index(c("lon"), 0.1))
    d = ph.regional_mechanism(c("lat"), c("lon"), c("depth_km"))
    q = q.join(m, ["mi", "mj"], "left").withColumn("_d", d)
    return q.select(*quakes.columns, c("strike").isNotNull().cast("int").alias("matched"),
                    *[F.coalesce(c(x), c(f"_d.{x}")).alias(x) for x in ("strike", "dip", "rake")])


MECH_SQL = """m AS (SELECT mi, mj, arg_max(strike, mid) AS strike, arg_max(dip, mid) AS dip, arg_max(rake, mid) AS rake FROM mechanisms GROUP BY 1, 2),
  fm AS (SELECT q.*, CAST(m.strike IS NOT NULL AS INT) AS matched,
   coalesce(m.strike, CASE WHEN depth_km > 70 THEN 200 WHEN lon > 142 AND lat > 35 THEN 200 WHEN lon < 137 AND lat < 35 THEN 240 WHEN lat > 40 THEN 200 WHEN lon > 130 AND lon < 132 AND lat < 34 THEN 30 ELSE 200 END) AS strike,
   coalesce(m.dip, CASE WHEN depth_km > 70 THEN 45 WHEN lon > 142 AND lat > 35 THEN 25 WHEN lon < 137 AND lat < 35 THEN 15 WHEN lat > 40 THEN 40 WHEN lon > 130 AND lon < 132 AND lat < 34 THEN 60 ELSE 35 END) AS dip,
   coalesce(m.rake, CASE WHEN depth_km > 70 THEN 90 WHEN lon > 142 AND lat > 35 THEN 90 WHEN lon < 137 AND lat < 35 THEN 90 WHEN lat > 40 THEN 90 WHEN lon > 130 AND lon < 132 AND lat < 34 THEN -90 ELSE 90 END) AS rake
   FROM quakes q LEFT JOIN m ON m.mi = CAST(round_even(q.lat/1e-1, 0) AS INT) AND m.mj = CAST(round_even(q.lon/1e-1, 0) AS INT))"""


@query("J02_mechanism_lookup", f"WITH {MECH_SQL} SELECT event_id, matched, CAST(strike AS DOUBLE) AS strike, CAST(dip AS DOUBLE) AS dip, CAST(rake AS DOUBLE) AS rake FROM fm")
def j02(v):
    return with_mechanism(v.quakes, v.mechanisms).select("event_id", "matched", "strike", "dip", "rake")


@query("F04_fault_class", f"""WITH {MECH_SQL} SELECT CASE WHEN abs(rake) <= 30 OR abs(rake) >= 150 THEN 'strike_slip' WHEN rake > 30 AND rake < 150 THEN 'reverse' ELSE 'normal' END AS fault, count(*) AS n FROM fm GROUP BY 1""")
def f04(v):
    return with_mechanism(v.quakes, v.mechanisms).groupBy(ph.fault_class(c("rake")).alias("fault")).agg(F.count(lit(1)).alias("n"))


def grid_points(grid):
    """Sum and count per grid point and day: the number of rows is bounded by the grid, not by the readings."""
    return grid.groupBy("dn", "glat", "glon").agg(F.sum("value").alias("gs"), F.count("value").alias("gn"))


@query("J03_space_time_window", """SELECT event_id, g.dn AS epoch, round(avg(value), 6) AS mean_value, count(*) AS n FROM quakes q JOIN grid_obs g
  ON g.dn BETWEEN q.dn - 7 AND q.dn + 1 AND abs(q.lat - glat) <= 2 AND abs(q.lon - glon) <= 2 WHERE mag >= 5 GROUP BY 1, 2""")
def j03(v):
    q = v.quakes.where("mag >= 5").select("event_id", c("dn").alias("qd"), "lat", "lon")
    pairs = jn.range_join(q, grid_points(v.grid_obs), time=("qd", "dn", -7, 1), box=("lat", "lon", "glat", "glon", 2.0))
    return pairs.groupBy("event_id", c("dn").alias("epoch")).agg(R(F.sum("gs") / F.sum("gn")).alias("mean_value"), F.sum("gn").alias("n"))


def day_series(v):
    return v.daily_obs.groupBy("dn").agg(F.avg("value").alias("kp")).select(c("dn").alias("sd"), (c("dn") * DAY).alias("st"), "kp")


@query("J04_point_in_time_mean", """WITH s AS (SELECT dn*86400 AS st, avg(value) AS kp FROM daily_obs GROUP BY dn)
  SELECT event_id, (SELECT round(avg(kp), 6) FROM s WHERE st BETWEEN t - 172800 AND t) AS kp_48h FROM quakes""")
def j04(v):
    q = v.quakes.select("event_id", "t")
    pairs = jn.range_join(q, day_series(v), time=("t", "st", -172800, 0))
    g = pairs.groupBy("event_id").agg(R(F.avg("kp")).alias("kp_48h"))
    return q.select("event_id").join(g, "event_id", "left")


@query("J05_lead_profile", """WITH s AS (SELECT dn*86400 AS st, avg(value) AS kp FROM daily_obs GROUP BY dn), l AS (SELECT unnest([6,12,24,48,72,96,120,168]) AS lead_h)
  SELECT lead_h, round(avg(kp), 6) AS mean_kp, count(*) AS n FROM quakes, l, s WHERE mag >= 4 AND st BETWEEN t - lead_h*3600 - 10800 AND t - lead_h*3600 + 10800 GROUP BY 1""")
def j05(v):
    q = ex.with_values(v.quakes.where("mag >= 4").select("t"), [6, 12, 24, 48, 72, 96, 120, 168], "lead_h")
    q = q.withColumn("at", c("t") - c("lead_h") * 3600)
    return jn.range_join(q, day_series(v), time=("at", "st", -10800, 10800)).groupBy("lead_h").agg(
        R(F.avg("kp")).alias("mean_kp"), F.count(lit(1)).alias("n"))


def isolated(targets, events, days=3, degrees=1.5, drop=0.5):
    """Targets with no earlier comparable event (magnitude at least theirs - drop) nearby in the last days."""
    t = targets.withColumn("floor_mag", c("mag") - lit(float(drop)))
    hit = jn.exists_within(t, events.select("t", "lat", "lon", "mag"), ["event_id"], time=("t", "t", -days * DAY, 0),
                           closed="left", box=("lat", "lon", "lat", "lon", degrees), weight=("floor_mag", "mag"))
    return targets.join(hit, "event_id", "left_anti")


_ISO = """SELECT a.event_id FROM quakes a WHERE {cond} NOT EXISTS (SELECT 1 FROM quakes b WHERE b.t >= a.t - 259200 AND b.t < a.t
  AND abs(a.lat - b.lat) <= 1.5e0 AND abs(a.lon - b.lon) <= 1.5e0 AND b.mag >= a.mag - 5e-1)"""


@query("P13_isolated_targets", _ISO.format(cond="a.mag >= 4.5e0 AND"))
def p13(v):
    return isolated(v.quakes.where("mag >= 4.5"), v.quakes).select("event_id")


@query("J06_anti_range_join", _ISO.format(cond=""))
def j06(v):
    return isolated(v.quakes, v.quakes).select("event_id")


@query("J07_nearest_station", """WITH d AS (SELECT event_id, sid, sqrt(pow(lat-slat,2)+pow((lon-slon)*cos(radians(lat)),2)) AS dist FROM quakes, stations)
  SELECT event_id, arg_min(sid, (dist, sid)) AS sid, round(min(dist), 6) AS distance FROM d WHERE dist <= 1 GROUP BY 1""")
def j07(v):
    j = jn.nearest_join(v.quakes.select("event_id", "lat", "lon"), v.stations, ["event_id"], ("lat", "lon"), ("slat", "slon"), "sid", 1.0, sp.degree_distance)
    return j.select("event_id", "sid", R(c("distance")).alias("distance"))


@query("J08_first_in_box", """SELECT event_id, min(mid) AS mid FROM quakes JOIN mechanisms ON abs(lat - mi/1e1) <= 3e-1 AND abs(lon - mj/1e1) <= 3e-1 GROUP BY 1""")
def j08(v):
    m = v.mechanisms.groupBy("mi", "mj").agg(F.min("mid").alias("mid")).select("mid", (c("mi") / lit(10.0)).alias("mlat"), (c("mj") / lit(10.0)).alias("mlon"))
    return jn.range_join(v.quakes.select("event_id", "lat", "lon"), m, box=("lat", "lon", "mlat", "mlon", 0.3)).groupBy("event_id").agg(F.min("mid").alias("mid"))


@query("J10_stations_in_radius", """WITH d AS (SELECT event_id, sid, sqrt(pow((lat-slat)*11132e-2,2)+pow((lon-slon)*11132e-2*cos(radians(lat)),2)) AS km FROM quakes, stations WHERE mag >= 4)
  SELECT event_id, count(*) AS n, round(min(km), 4) AS nearest_km FROM d WHERE km <= 150 GROUP BY 1""")
def j10(v):
    q = v.quakes.where("mag >= 4").select("event_id", "lat", "lon")
    p = jn.within_km(q, v.stations.select("sid", "slat", "slon"), 150.0)
    return p.groupBy("event_id").agg(F.count(lit(1)).alias("n"), R(F.min("km"), 4).alias("nearest_km"))


def alarm_matches(alarms, targets, window_days=7, radius=2.0):
    """(hit alarm ids, matched target ids): a target in [t, t+w] and inside the box of the alarm."""
    w = window_days * DAY
    box = ("lat", "lon", "lat", "lon", radius)
    hit = jn.exists_within(alarms, targets, ["event_id"], time=("t", "t", 0, w), box=box)
    got = jn.exists_within(targets, alarms, ["event_id"], time=("t", "t", -w, 0), box=box)
    return hit, got


_AT = "a AS (SELECT event_id, t, lat, lon FROM quakes WHERE mag BETWEEN 45e-1 AND 5), b AS (SELECT event_id, t, lat, lon FROM quakes WHERE mag >= 52e-1)"
_NEAR = "b.t BETWEEN a.t AND a.t + 604800 AND abs(a.lat-b.lat) <= 2 AND abs(a.lon-b.lon) <= 2"


def alarms_targets(v):
    cols = ["event_id", "t", "lat", "lon"]
    return v.quakes.where("mag BETWEEN 4.5 AND 5").select(*cols), v.quakes.where("mag >= 5.2").select(*cols)


@query("J11_alarm_target_match", f"""WITH {_AT} SELECT 'alarm' AS side, event_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_NEAR})
  UNION ALL SELECT 'target', event_id FROM b WHERE EXISTS (SELECT 1 FROM a WHERE {_NEAR})""")
def j11(v):
    hit, got = alarm_matches(*alarms_targets(v))
    return hit.select(lit("alarm").alias("side"), "event_id").unionByName(got.select(lit("target").alias("side"), "event_id"))


def cell_days(quakes):
    return quakes.groupBy("ci", "cj", "dn").agg(F.count(lit(1)).alias("n"), F.max("mag").alias("mx"))


@query("J12_neighbour_cells", """WITH d AS (SELECT ci, cj, dn, count(*) AS n FROM quakes GROUP BY 1,2,3)
  SELECT a.ci, a.cj, a.dn, CAST(sum(b.n) AS BIGINT) AS neighbour_n FROM d a JOIN d b ON a.dn=b.dn AND abs(a.ci-b.ci)<=1 AND abs(a.cj-b.cj)<=1 AND NOT (a.ci=b.ci AND a.cj=b.cj) GROUP BY 1,2,3""")
def j12(v):
    d = cell_days(v.quakes)
    # counts are scattered to the neighbours and summed: no self join, partial sums before the shuffle
    out = jn.neighbours(d).groupBy(c("ni").alias("ci"), c("nj").alias("cj"), "dn").agg(F.sum("n").alias("neighbour_n"))
    return d.select("ci", "cj", "dn").join(out, ["ci", "cj", "dn"])


def label_rows(targets, window: int, step: int, offset: int, horizon: int):
    """(ci, cj, step) keys with a target in the 3 x 3 cells in (step, step + window]; step in days."""
    day = c("t") / lit(float(DAY))
    first, last = F.ceil(day - lit(window)), F.ceil(day) - 1
    k0, k1 = F.ceil((first - lit(offset)) / lit(float(step))), F.floor((last - lit(offset)) / lit(float(step)))
    t = targets.select("ci", "cj", F.explode(F.when(k0 <= k1, F.sequence(k0, k1))).alias("k"))
    t = t.select("ci", "cj", (c("k") * step + offset).alias("step")).where(c("step").between(offset, horizon)).distinct()
    return jn.neighbours(t, include_self=True).select(c("ni").alias("ci"), c("nj").alias("cj"), "step").distinct()


# The grid of the label and feature queries starts 180 days into the catalogue and has a step every 3 days; cells and
# the last step come from the catalogue itself.
WARM_UP, STEP = 180, 3
_AXIS = lambda x: f"unnest(range(CAST((SELECT min({x}) FROM quakes) AS BIGINT), CAST((SELECT max({x}) FROM quakes) AS BIGINT) + 1))"
CELL_SQL = f"cells AS (SELECT ci, cj FROM (SELECT CAST({_AXIS('ci')} AS INT) AS ci), (SELECT CAST({_AXIS('cj')} AS INT) AS cj))"
GRID_SQL = f"{CELL_SQL}, steps AS (SELECT unnest(range(CAST((SELECT min(dn) FROM quakes) AS BIGINT) + {WARM_UP}, CAST((SELECT max(dn) FROM quakes) AS BIGINT) + 1, {STEP})) AS step), base AS (SELECT * FROM cells, steps)"


def bounds(v):
    """First and last day and cell of the catalogue: six numbers, read once per query."""
    if "_bounds" not in v.__dict__:
        v._bounds = v.quakes.agg(*[f(x).alias(f"{x}{n}") for x in ("dn", "ci", "cj") for n, f in ((0, F.min), (1, F.max))]).first()
    return v._bounds


def catalogue_cells(v):
    b = bounds(v)
    return ex.cell_grid(v.spark, (b["ci0"], b["ci1"]), (b["cj0"], b["cj1"]))


def step_range(v):
    return bounds(v)["dn0"] + WARM_UP, bounds(v)["dn1"]


def base_grid(v):
    return ex.with_steps(catalogue_cells(v), *step_range(v), STEP)


@query("J13_neighbour_label", f"""WITH {GRID_SQL}, tg AS (SELECT ci, cj, t FROM quakes WHERE mag >= 5),
  hits AS (SELECT DISTINCT b.ci, b.cj, b.step FROM base b JOIN tg ON abs(tg.ci-b.ci)<=1 AND abs(tg.cj-b.cj)<=1 AND tg.t > b.step*86400 AND tg.t <= (b.step+7)*86400)
  SELECT ci, cj, step, CAST(hits.ci IS NOT NULL AS INT) AS label FROM base LEFT JOIN hits USING (ci, cj, step)""")
def j13(v):
    hits = label_rows(v.quakes.where("mag >= 5"), 7, STEP, *step_range(v)).withColumn("label", lit(1))
    return base_grid(v).join(hits, ["ci", "cj", "step"], "left").withColumn("label", F.coalesce("label", lit(0)))


@query("J14_stacked_keys", """WITH a AS (SELECT ci, cj, dn, avg(mag) AS p1 FROM quakes WHERE depth_km < 60 GROUP BY 1,2,3), b AS (SELECT ci, cj, dn, max(mag) AS p2 FROM quakes WHERE depth_km >= 30 GROUP BY 1,2,3),
  k AS (SELECT DISTINCT ci, cj, dn FROM quakes)
  SELECT ci, cj, dn, round(coalesce(p1, 0), 6) AS p1, coalesce(p2, 3) AS p2 FROM k LEFT JOIN a USING (ci, cj, dn) LEFT JOIN b USING (ci, cj, dn)""")
def j14(v):
    # both sides come from the same table and key: one conditional aggregation replaces two shuffled joins
    g = v.quakes.groupBy("ci", "cj", "dn").agg(F.avg(F.when(c("depth_km") < 60, c("mag"))).alias("p1"), F.max(F.when(c("depth_km") >= 30, c("mag"))).alias("p2"))
    return g.select("ci", "cj", "dn", R(F.coalesce("p1", lit(0.0))).alias("p1"), F.coalesce("p2", lit(3.0)).alias("p2"))


@query("J15_previous_value", """WITH p AS (SELECT station, dn, max(value) AS v FROM daily_obs GROUP BY 1,2)
  SELECT station, dn, v, lag(v) OVER w AS prev_v, 0.0 + round(v - lag(v) OVER w, 6) AS diff FROM p WINDOW w AS (PARTITION BY station ORDER BY dn)""")
def j15(v):
    p = v.daily_obs.groupBy("station", "dn").agg(F.max("value").alias("v"))
    prev = F.lag("v").over(W.partitionBy("station").orderBy("dn"))
    return p.select("station", "dn", "v", prev.alias("prev_v"), R(c("v") - prev).alias("diff"))


@query("J15b_asof_strict", """SELECT q.event_id, p.event_id AS prev_id, p.t AS prev_t, p.mag AS prev_mag FROM quakes q ASOF LEFT JOIN (SELECT * FROM quakes WHERE mag >= 4) p ON q.ci = p.ci AND q.cj = p.cj AND q.t > p.t""")
def j15b(v):
    q = v.quakes.select("ci", "cj", "t", "event_id")
    p = v.quakes.where("mag >= 4").select("ci", "cj", c("t").alias("prev_t"), c("event_id").alias("prev_id"), c("mag").alias("prev_mag"))
    return jn.asof_join(q, p, ["ci", "cj"], "t", "prev_t", ["prev_id", "prev_mag"], strict=True).select("event_id", "prev_id", "prev_t", "prev_mag")


ZONE_SQL = """CASE WHEN lat BETWEEN 35 AND 42 AND lon BETWEEN 140 AND 148 THEN 'tohoku_offshore' WHEN lat BETWEEN 33 AND 36 AND lon BETWEEN 137 AND 142 THEN 'kanto_tokai'
  WHEN lat BETWEEN 30 AND 35 AND lon BETWEEN 130 AND 137 THEN 'nankai' WHEN lat BETWEEN 28 AND 34 AND lon BETWEEN 128 AND 133 THEN 'kyushu'
  WHEN lat BETWEEN 41 AND 46 AND lon BETWEEN 140 AND 148 THEN 'hokkaido' WHEN lat BETWEEN 26 AND 35 AND lon BETWEEN 138 AND 145 THEN 'izu_bonin' ELSE 'other' END"""


@query("J16_zone_containment", f"SELECT {ZONE_SQL} AS zone, count(*) AS n, round(avg(mag), 8) AS mean_mag FROM quakes GROUP BY 1")
def j16(v):
    return v.quakes.groupBy(sp.zone_of(c("lat"), c("lon")).alias("zone")).agg(F.count(lit(1)).alias("n"), R(F.avg("mag"), 8).alias("mean_mag"))


def stress_kpa():
    return ph.stress_change(c("src_lat"), c("src_lon"), c("src_depth"), c("src_mag"), c("lat"), c("lon"), c("depth_km")) / lit(1000.0)


def stress_sources(targets, sources, max_km=500.0, max_years=10.0):
    """Target x earlier source pairs inside the box, with the stress change of each pair in kPa.

    Both sides are magnitude-filtered catalogues; a crowded bucket is split by salt.
    """
    r = max_km / sp.DEG_KM
    s = sources.select(c("event_id").alias("src_id"), c("t").alias("src_t"), c("lat").alias("src_lat"), c("lon").alias("src_lon"),
                       c("depth_km").alias("src_depth"), c("mag").alias("src_mag"))
    p = jn.range_join(targets, s, time=("t", "src_t", -max_years * 365.25 * DAY, 0), closed="left", box=("lat", "lon", "src_lat", "src_lon", r), salt=4)
    return p.withColumn("kpa", stress_kpa())


_R500 = 500.0 / sp.DEG_KM
_KPA = """CASE WHEN sqrt(pow((q.lon-s.lon)*11132e-2*cos(radians(s.lat))*1e3,2)+pow((q.lat-s.lat)*111320e0,2)+pow((q.depth_km-s.depth_km)*1e3,2)) < 500 THEN 0 ELSE
  pow(10e0, 15e-1*s.mag+905e-2)/(8*pi()*pow(sqrt(pow((q.lon-s.lon)*11132e-2*cos(radians(s.lat))*1e3,2)+pow((q.lat-s.lat)*111320e0,2)+pow((q.depth_km-s.depth_km)*1e3,2)),3)) END/1e3"""
_PAIR = f"s.mag >= 5 AND s.t >= q.t - 315576000 AND s.t < q.t AND abs(q.lat-s.lat) <= {_R500!r} AND abs(q.lon-s.lon) <= {_R500!r}"


@query("J17_stress_sum", f"""SELECT q.event_id, count(*) AS n_sources, round(sum({_KPA}), 5) AS stress_kpa FROM quakes q JOIN quakes s ON {_PAIR} WHERE q.mag >= 45e-1 GROUP BY 1""")
def j17(v):
    p = bl.stress_sums(v.quakes.where("mag >= 4.5"), v.quakes.where("mag >= 5"), ["event_id"])
    return p.select("event_id", "n_sources", R(c("kpa"), 5).alias("stress_kpa"))


@query("T05_top_sources", f"""WITH p AS (SELECT q.event_id, s.mag, {_KPA} AS kpa, row_number() OVER (PARTITION BY q.event_id ORDER BY s.mag DESC, s.t DESC, s.event_id) AS rk FROM quakes q JOIN quakes s ON {_PAIR} WHERE q.mag >= 45e-1)
  SELECT event_id, count(*) AS n, round(sum(kpa), 5) AS stress_kpa FROM p WHERE rk <= 5 GROUP BY 1""")
def t05(v):
    q = v.quakes
    sources = q.where("mag >= 5").select(c("event_id").alias("src_id"), c("t").alias("src_t"), c("lat").alias("src_lat"), c("lon").alias("src_lon"),
                                         c("depth_km").alias("src_depth"), c("mag").alias("src_mag"))
    p = th.top_k_within(q.where("mag >= 4.5").select("event_id", "t", "lat", "lon", "depth_km"), sources, ["event_id"], 5, ("t", "src_t", 10 * 365.25 * DAY),
                        ("lat", "lon", "src_lat", "src_lon", 500.0 / sp.DEG_KM), "src_mag", 0.25, [F.desc("src_t"), c("src_id")])
    return p.withColumn("kpa", stress_kpa()).groupBy("event_id").agg(F.count(lit(1)).alias("n"), R(F.sum("kpa"), 5).alias("stress_kpa"))


@query("J18_next_day_pairs", """WITH p AS (SELECT station, dn, max(value) AS v FROM daily_obs GROUP BY 1,2), g AS (SELECT *, lead(dn) OVER w AS nd, lead(v) OVER w AS nv FROM p WINDOW w AS (PARTITION BY station ORDER BY dn))
  SELECT station, dn, v, nv FROM g WHERE nd = dn + 1""")
def j18(v):
    p = v.daily_obs.groupBy("station", "dn").agg(F.max("value").alias("v"))
    w = W.partitionBy("station").orderBy("dn")
    return p.select("station", "dn", "v", F.lead("v").over(w).alias("nv"), F.lead("dn").over(w).alias("nd")).where("nd = dn + 1").drop("nd")


@query("J19_any_target_ahead", """WITH d AS (SELECT DISTINCT dn FROM daily_obs) SELECT dn, CAST(EXISTS (SELECT 1 FROM quakes q WHERE q.mag >= 55e-1 AND q.dn BETWEEN d.dn + 1 AND d.dn + 30) AS INT) AS target_ahead FROM d""")
def j19(v):
    days = v.daily_obs.select("dn").distinct()
    ahead = v.quakes.where("mag >= 5.5").select("dn").distinct().select(F.explode(F.sequence(c("dn") - 30, c("dn") - 1)).alias("dn")).distinct()
    return days.join(ahead.withColumn("f", lit(1)), "dn", "left").select("dn", F.coalesce("f", lit(0)).alias("target_ahead"))


@query("J20_target_near_grid", """WITH g AS (SELECT DISTINCT dn, glat, glon FROM grid_obs) SELECT dn, glat, glon FROM g WHERE EXISTS (SELECT 1 FROM quakes q WHERE q.mag >= 5 AND q.dn BETWEEN g.dn AND g.dn + 8 AND abs(q.lat-glat) <= 1 AND abs(q.lon-glon) <= 1)""")
def j20(v):
    g = v.grid_obs.select("dn", "glat", "glon").distinct()
    t = v.quakes.where("mag >= 5").select(c("dn").alias("td"), "lat", "lon").distinct()
    return jn.exists_within(g, t, ["dn", "glat", "glon"], time=("dn", "td", 0, 8), box=("glat", "glon", "lat", "lon", 1.0))


def grid_edges(cells, radius=3):
    """Edges of the cell graph: the 8 neighbours, and cells of the same named zone within `radius` cells; inverse distance and direction."""
    a = cells.withColumn("zone", sp.zone_of(c("ci") * 2.0, c("cj") * 2.0))
    b = a.select(c("ci").alias("ni"), c("cj").alias("nj"), c("zone").alias("nzone"))
    e = jn.neighbours(a, k=radius).join(b, ["ni", "nj"])
    near = (F.abs(c("ni") - c("ci")) <= 1) & (F.abs(c("nj") - c("cj")) <= 1)
    dist = F.sqrt(F.pow(c("ni") - c("ci"), 2) + F.pow(c("nj") - c("cj"), 2))
    return e.where(near | ((c("zone") == c("nzone")) & (c("zone") != "other") & (dist <= radius))).select(
        "ci", "cj", "ni", "nj", near.cast("int").alias("adjacent"), (lit(1.0) / dist).alias("inv_distance"),
        ((c("ni") - c("ci")) / dist).alias("dir_lat"), ((c("nj") - c("cj")) / dist).alias("dir_lon"))


@query("J21_cell_graph", f"""WITH z AS (SELECT ci, cj, {ZONE_SQL.replace('lat', 'ci*2').replace('lon', 'cj*2')} AS zone FROM (SELECT DISTINCT ci, cj FROM quakes))
  SELECT a.ci, a.cj, b.ci AS ni, b.cj AS nj, CAST(abs(a.ci-b.ci)<=1 AND abs(a.cj-b.cj)<=1 AS INT) AS adjacent, round(1/sqrt(pow(a.ci-b.ci,2)+pow(a.cj-b.cj,2)), 6) AS inv_distance
  FROM z a JOIN z b ON NOT (a.ci=b.ci AND a.cj=b.cj) AND ((abs(a.ci-b.ci)<=1 AND abs(a.cj-b.cj)<=1) OR (a.zone=b.zone AND a.zone<>'other' AND sqrt(pow(a.ci-b.ci,2)+pow(a.cj-b.cj,2))<=3))""")
def j21(v):
    return grid_edges(v.quakes.select("ci", "cj").distinct()).select("ci", "cj", "ni", "nj", "adjacent", R(c("inv_distance")).alias("inv_distance"))


@query("J22_cross_sensor_ratio", """WITH a AS (SELECT dn, avg(value) FILTER (kind='view') AS va, avg(value) FILTER (kind='click') AS vb FROM station_obs GROUP BY dn),
  b AS (SELECT *, avg(va/vb) OVER (ORDER BY dn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS base FROM a)
  SELECT dn, round(va/vb, 6) AS ratio, round((va/vb)/base, 6) AS ratio_vs_base FROM b""")
def j22(v):
    a = v.station_obs.groupBy("dn").agg(F.avg(F.when(c("kind") == "view", c("value"))).alias("va"), F.avg(F.when(c("kind") == "click", c("value"))).alias("vb"))
    w = W.partitionBy(lit(0)).orderBy("dn").rowsBetween(-30, -1)  # one row per day
    r = F.try_divide(c("va"), c("vb"))
    return a.withColumn("ratio", r).select("dn", R(c("ratio")).alias("ratio"), R(F.try_divide(c("ratio"), F.avg("ratio").over(w))).alias("ratio_vs_base"))


MISSING_SQL = """st AS (SELECT DISTINCT station FROM attempts), days AS (SELECT DISTINCT dn FROM attempts),
  okd AS (SELECT DISTINCT station, dn FROM attempts WHERE failed = 0), bad AS (SELECT station, dn FROM attempts WHERE failed = 1 GROUP BY 1,2 HAVING count(*) >= 2)"""


def expected_pairs(a):
    """Every (station, day) of the calendar: the day list is a range, so stations are expanded, never crossed with rows."""
    lo, hi = a.agg(F.min("dn"), F.max("dn")).first()
    return ex.with_steps(a.select("station").distinct(), lo, hi, 1, "dn")


@query("J23_missing_pairs", f"""WITH {MISSING_SQL} SELECT station, dn FROM st, days WHERE NOT EXISTS (SELECT 1 FROM okd WHERE okd.station=st.station AND okd.dn=days.dn)
  AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.station=st.station AND bad.dn=days.dn) ORDER BY dn, station LIMIT 300""")
def j23(v):
    a = v.attempts
    g = a.groupBy("station", "dn").agg(F.count_if(c("failed") == 0).alias("ok"), F.count_if(c("failed") == 1).alias("bad"))
    skip = g.where("ok > 0 OR bad >= 2").select("station", "dn")
    return expected_pairs(a).join(skip, ["station", "dn"], "left_anti").orderBy("dn", "station").limit(300)


@query("J24_missing_chunks", """WITH s AS (SELECT DISTINCT station FROM attempts), ch AS (SELECT unnest(range(19723, CAST((SELECT max(dn) FROM attempts) AS BIGINT) + 1, 5)) AS c0),
  okd AS (SELECT DISTINCT station, 19723 + ((dn - 19723)//5)*5 AS c0, dn FROM attempts WHERE failed=0), n AS (SELECT station, c0, count(*) AS have FROM okd GROUP BY 1,2),
  miss AS (SELECT s.station, ch.c0, coalesce(have, 0) AS have FROM s CROSS JOIN ch LEFT JOIN n ON n.station=s.station AND n.c0=ch.c0 WHERE coalesce(have, 0) < 5),
  newest AS (SELECT * FROM miss ORDER BY c0 DESC, station LIMIT 20), oldest AS (SELECT * FROM miss ORDER BY c0, station LIMIT 40)
  SELECT DISTINCT station, c0, have FROM (SELECT * FROM newest UNION ALL SELECT * FROM oldest)""")
def j24(v):
    a, days, first = v.attempts, 5, 19723
    have = (a.where("failed = 0").select("station", "dn").distinct()
            .groupBy("station", (F.floor((c("dn") - first) / days) * days + first).alias("c0")).agg(F.count(lit(1)).alias("have")))
    last = a.agg(F.max("dn")).first()[0]  # the calendar of the data
    chunks = ex.with_steps(a.select("station").distinct(), first, last, days, "c0")
    miss = chunks.join(have, ["station", "c0"], "left").withColumn("have", F.coalesce("have", lit(0).cast("long"))).where(c("have") < days)
    newest = miss.orderBy(F.desc("c0"), "station").limit(20)   # reserve for the newest chunks
    oldest = miss.orderBy("c0", "station").limit(40)
    return newest.unionByName(oldest).distinct()


# ---- set operations and expansion -----------------------------------------------------------------------------------

@query("U01_hour_union", "SELECT DISTINCT h FROM series")
def u01(v):
    # all series live in one table, so the union of their hours is one scan and one distinct
    return v.series.select("h").distinct()


@query("U02_merge_feeds", """SELECT station, dn, round(sum(value), 4) AS total, count(DISTINCT kind) AS feeds FROM station_obs WHERE kind IN ('view', 'click') GROUP BY 1, 2""")
def u02(v):
    feed = lambda k: v.station_obs.where(c("kind") == k).groupBy("station", "dn").agg(F.sum("value").alias("s")).withColumn("feed", lit(k))
    return feed("view").unionByName(feed("click")).groupBy("station", "dn").agg(R(F.sum("s"), 4).alias("total"), F.countDistinct("feed").alias("feeds"))


def retry_ledger(attempts, keys, t):
    """Failures per key with the time of the last one."""
    return attempts.where("failed = 1").groupBy(*keys).agg(F.count(lit(1)).alias("retry_count"), F.max(t).alias("last_failed"))


@query("U03_existing_minus_failed", """WITH ok AS (SELECT DISTINCT station, dn FROM attempts WHERE failed=0), led AS (SELECT station, dn, count(*) AS retry_count, max(t) AS last_failed FROM attempts WHERE failed=1 GROUP BY 1,2)
  SELECT station, dn FROM ok WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.station=ok.station AND led.dn=ok.dn AND retry_count >= 3 AND last_failed > 1706659200 - 30*86400)""")
def u03(v):
    now = 1706659200
    skip = retry_ledger(v.attempts, ["station", "dn"], "t").where((c("retry_count") >= 3) & (c("last_failed") > now - 30 * DAY))
    return v.attempts.where("failed = 0").select("station", "dn").distinct().join(skip, ["station", "dn"], "left_anti")


@query("U04_observed_cells", """SELECT ci, cj FROM (SELECT DISTINCT ci, cj FROM quakes) INTERSECT SELECT gi, gj FROM grid_obs""")
def u04(v):
    return v.quakes.select("ci", "cj").intersect(v.grid_obs.select(c("gi").alias("ci"), c("gj").alias("cj")))


@query("U05_anchor_window", "SELECT DISTINCT CAST(CAST(make_timestamp(t*1000000) AS DATE) + CAST(k AS INT) AS VARCHAR)[1:10] AS d FROM quakes, range(-3, 4) r(k) WHERE mag >= 5")
def u05(v):
    a = v.quakes.where("mag >= 5").select(F.to_date(F.timestamp_seconds("t")).alias("anchor")).distinct()
    return ex.day_window(a, "anchor", 3, 3).select(F.date_format("d", "yyyy-MM-dd").alias("d")).distinct()


@query("U06_month_days", """WITH m AS (SELECT date_trunc('month', d) AS m, gi, gj, avg(value) AS v FROM grid_obs GROUP BY 1,2,3)
  SELECT CAST(month(m) AS INT) AS mon, CAST(year(m) AS INT) AS yr, count(*) AS cell_days, round(avg(v), 6) AS mean_value FROM (SELECT m, v, unnest(range(day(last_day(m)))) AS k FROM m) GROUP BY 1,2""")
def u06(v):
    m = v.grid_obs.groupBy(F.trunc("d", "month").alias("m"), "gi", "gj").agg(F.avg("value").alias("v"))
    return ex.period_days(m, "m", "month").groupBy(F.month("d").alias("mon"), F.year("d").alias("yr")).agg(F.count(lit(1)).alias("cell_days"), R(F.avg("v")).alias("mean_value"))


@query("U07_forward_fill", """WITH p AS (SELECT gi, gj, d, avg(value) AS v FROM grid_obs WHERE quality >= 9e-2 GROUP BY 1,2,3),
  n AS (SELECT *, least(d + 13, coalesce(lead(d) OVER (PARTITION BY gi, gj ORDER BY d) - 1, d + 13)) AS stop FROM p)
  SELECT gi, gj, CAST(CAST(x AS DATE) AS VARCHAR) AS d, round(v, 6) AS v FROM (SELECT gi, gj, v, unnest(generate_series(CAST(d AS TIMESTAMP), CAST(stop AS TIMESTAMP), INTERVAL 1 DAY)) AS x FROM n)""")
def u07(v):
    p = v.grid_obs.where("quality >= 0.09").groupBy("gi", "gj", "d").agg(F.avg("value").alias("v"))
    return ex.forward_fill_days(p, ["gi", "gj"], "d", 13, "day").select("gi", "gj", F.date_format("day", "yyyy-MM-dd").alias("d"), R(c("v")).alias("v"))


@query("U08_dense_grid", f"""WITH {GRID_SQL}, n AS (SELECT ci, cj, dn, count(*) AS n FROM quakes GROUP BY 1,2,3) SELECT base.ci, base.cj, step, coalesce(n, 0) AS n FROM base LEFT JOIN n ON n.ci=base.ci AND n.cj=base.cj AND n.dn=step""")
def u08(v):
    n = v.quakes.groupBy("ci", "cj", c("dn").alias("step")).agg(F.count(lit(1)).alias("n"))
    return base_grid(v).join(n, ["ci", "cj", "step"], "left").withColumn("n", F.coalesce("n", lit(0).cast("long")))


@query("U10_key_union", """SELECT DISTINCT ci, cj, dn FROM (SELECT ci, cj, dn FROM quakes WHERE mag >= 4 UNION ALL SELECT gi, gj, dn FROM grid_obs WHERE quality >= 9e-2)""")
def u10(v):
    return v.quakes.where("mag >= 4").select("ci", "cj", "dn").union(v.grid_obs.where("quality >= 0.09").select("gi", "gj", "dn")).distinct()
