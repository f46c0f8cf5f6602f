"""Scans, predicates, projections, sorts and plain aggregations (S01, S28, P*, T*, A01-A20, A42, A48, A54, A66, A67)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scalar as sc, spatial as sp
from ..operators import aggregates as ag, expand as ex, ordered as od
from .registry import query

c, lit = F.col, F.lit
NOW = 991353600  # 2001-06-01T00:00:00Z, the fixed clock of the trailing-window queries
DAY = 86400


def R(x, n=6):
    return F.round(x, n)


# ---- scans and predicates -------------------------------------------------------------------------------------------

@query("S01_time_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def s01(v):
    # the filter stays on the stored column, so it reaches the Parquet scan
    return v.table("orders").where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'").select(
        "o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query("S28_bbox_filter", """SELECT event_id, lat, lon FROM quakes WHERE lat BETWEEN 30 AND 42 AND lon BETWEEN 130 AND 145""")
def s28(v):
    return v.quakes.where(c("lat").between(30, 42) & c("lon").between(130, 145)).select("event_id", "lat", "lon")


# Seismic intensity codes and their labels.
INTENSITY = {10: "1", 20: "2", 30: "3", 40: "4", 45: "5-", 50: "5+", 55: "6-", 60: "6+", 70: "7"}


@query("P01_code_label", """SELECT CASE flag WHEN 10 THEN '1' WHEN 20 THEN '2' WHEN 30 THEN '3' WHEN 40 THEN '4' WHEN 45 THEN '5-'
  WHEN 50 THEN '5+' WHEN 55 THEN '6-' WHEN 60 THEN '6+' WHEN 70 THEN '7' ELSE CAST(flag AS VARCHAR) END AS label, count(*) AS n
  FROM station_obs GROUP BY 1""")
def p01(v):
    return v.station_obs.groupBy(sc.label_of(c("flag"), INTENSITY).alias("label")).agg(F.count(lit(1)).alias("n"))


METRICS = {"value": "value", "level": "flag"}


@query("P02_metric_snapshot", """SELECT station, CAST(flag AS DOUBLE) AS metric FROM station_obs
  WHERE dn = (SELECT max(dn) FROM station_obs) AND flag IS NOT NULL""")
def p02(v):
    return (ag.latest_snapshot(v.station_obs, "dn").where(c(METRICS["level"]).isNotNull())
            .select("station", c(METRICS["level"]).cast("double").alias("metric")))


@query("P03_null_tolerant_floor", """WITH q AS (SELECT event_id, CASE WHEN depth_km < 3 THEN NULL ELSE mag END AS m FROM quakes)
  SELECT count(*) AS n, count(m) AS n_known, round(avg(m), 6) AS mean_mag FROM q WHERE m >= 4 OR m IS NULL""")
def p03(v):
    q = v.quakes.select(F.when(c("depth_km") >= 3, c("mag")).alias("m"))
    return q.where("m >= 4 OR m IS NULL").agg(F.count(lit(1)).alias("n"), F.count("m").alias("n_known"), R(F.avg("m")).alias("mean_mag"))


@query("P04_minute_downsample", """SELECT id, name, value FROM series WHERE (t_us // 60000000) % 10 = 0""")
def p04(v):
    return v.series.where((F.floor(c("t_us") / lit(60000000)) % 10) == 0).select("id", "name", "value")


@query("P05_trailing_window", f"SELECT event_id, t, mag FROM quakes WHERE t >= {NOW} - 30*86400 AND t < {NOW}")
def p05(v):
    return v.quakes.where((c("t") >= NOW - 30 * DAY) & (c("t") < NOW)).select("event_id", "t", "mag")


@query("P06_box_predicate", """SELECT count(*) AS n, round(avg(mag), 6) AS mean_mag FROM quakes WHERE abs(lat - 36) <= 2 AND abs(lon - 140) <= 2""")
def p06(v):
    return v.quakes.where(sp.within_box(c("lat"), c("lon"), lit(36.0), lit(140.0), 2)).agg(
        F.count(lit(1)).alias("n"), R(F.avg("mag")).alias("mean_mag"))


# Depth limits of the classes.
def depth_class(d):
    return (F.when(d.isNull(), "unknown").when(d < 30, "shallow_lt30km").when(d < 70, "intermediate_30_70km")
            .otherwise("deep_gt70km"))


DEPTH_SQL = "CASE WHEN depth_km IS NULL THEN 'unknown' WHEN depth_km < 30 THEN 'shallow_lt30km' WHEN depth_km < 70 THEN 'intermediate_30_70km' ELSE 'deep_gt70km' END"


@query("P07_depth_mag_class", f"""SELECT {DEPTH_SQL} AS depth_class, concat('M', CAST(floor(mag) AS INT)) AS mag_class, count(*) AS n
  FROM quakes GROUP BY 1, 2""")
def p07(v):
    return v.quakes.groupBy(depth_class(c("depth_km")).alias("depth_class"),
                            F.concat(lit("M"), F.floor("mag").cast("int")).alias("mag_class")).agg(F.count(lit(1)).alias("n"))


def hour_of(t):
    return F.floor(F.pmod(t, lit(DAY)) / lit(3600))


@query("P08_day_night", """SELECT CASE WHEN (t % 86400)//3600 >= 10 AND (t % 86400)//3600 < 20 THEN 'night' ELSE 'day' END AS part,
  count(*) AS n, round(avg(value), 6) AS mean_value FROM station_obs GROUP BY 1""")
def p08(v):
    h = hour_of(c("t"))
    return v.station_obs.groupBy(F.when((h >= 10) & (h < 20), "night").otherwise("day").alias("part")).agg(
        F.count(lit(1)).alias("n"), R(F.avg("value")).alias("mean_value"))


@query("P09_night_hours", """SELECT station, count(*) AS n, round(avg(value), 6) AS mean_value FROM station_obs
  WHERE (t % 86400)//3600 BETWEEN 15 AND 21 GROUP BY station""")
def p09(v):
    return v.station_obs.where(hour_of(c("t")).between(15, 21)).groupBy("station").agg(
        F.count(lit(1)).alias("n"), R(F.avg("value")).alias("mean_value"))


@query("P10_range_sentinel", """SELECT count(*) AS n, count(CASE WHEN value BETWEEN 5 AND 200 THEN value END) AS n_valid,
  round(avg(CASE WHEN value BETWEEN 5 AND 200 THEN value END), 6) AS mean_valid FROM station_obs""")
def p10(v):
    ok = F.when(c("value").between(5, 200), c("value"))
    return v.station_obs.agg(F.count(lit(1)).alias("n"), F.count(ok).alias("n_valid"), R(F.avg(ok)).alias("mean_valid"))


@query("P11_active_groups", """SELECT 'series' AS feature_group, 1 AS active FROM (SELECT 1 FROM series LIMIT 1)
  UNION ALL SELECT 'stations', 1 FROM (SELECT 1 FROM stations LIMIT 1)
  UNION ALL SELECT 'strong', CASE WHEN (SELECT max(mag) FROM quakes) >= 99 THEN 1 ELSE 0 END""")
def p11(v):
    feeds = {"series": v.series, "stations": v.stations, "strong": v.quakes.where("mag >= 99")}
    parts = [df.limit(1).agg(F.count(lit(1)).cast("int").alias("active")).select(lit(n).alias("feature_group"), "active")
             for n, df in feeds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("P12_select_features", "SELECT k, y, p, disc FROM scores")
def p12(v):
    stable = ["p", "disc"]
    return v.scores.select("k", "y", *stable)


@query("P14_systematic_sample", """WITH r AS (SELECT event_id, t, row_number() OVER (ORDER BY t, event_id) - 1 AS pos, count(*) OVER () AS n FROM quakes),
  pick AS (SELECT DISTINCT CAST(floor(i * (SELECT any_value(n) FROM r) / 200.0) AS BIGINT) AS pos FROM range(200) g(i))
  SELECT event_id, t FROM r JOIN pick USING (pos)""")
def p14(v):
    return ex.systematic_sample(v.quakes.select("event_id", "t"), "t", ["event_id"], 200)


@query("P15_time_split", """SELECT CASE WHEN t < 883612800 THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(*) FILTER (mag >= 5) AS n_m5
  FROM quakes GROUP BY 1""")
def p15(v):
    return v.quakes.groupBy(F.when(c("t") < 883612800, "train").otherwise("test").alias("part")).agg(
        F.count(lit(1)).alias("n"), F.count_if(c("mag") >= 5).alias("n_m5"))


LAND = [(31.0, 34.0, 129.5, 132.0), (33.5, 36.5, 132.0, 137.0), (35.0, 41.0, 137.0, 142.0), (41.5, 45.5, 140.0, 146.0)]


@query("P16_land_mask", """SELECT event_id FROM quakes WHERE (lat BETWEEN 31 AND 34 AND lon BETWEEN 129.5e0 AND 132)
  OR (lat BETWEEN 33.5e0 AND 36.5e0 AND lon BETWEEN 132 AND 137) OR (lat BETWEEN 35 AND 41 AND lon BETWEEN 137 AND 142)
  OR (lat BETWEEN 41.5e0 AND 45.5e0 AND lon BETWEEN 140 AND 146)""")
def p16(v):
    return v.quakes.where(sp.in_any_box(c("lat"), c("lon"), LAND)).select("event_id")


@query("P17_spread_stations", """WITH r AS (SELECT sid, slat, row_number() OVER (ORDER BY -slat, sid) - 1 AS pos, count(*) OVER () AS n FROM stations),
  pick AS (SELECT DISTINCT CAST(floor(i * (SELECT any_value(n) FROM r) / 25.0) AS BIGINT) AS pos FROM range(25) g(i))
  SELECT sid, slat FROM r JOIN pick USING (pos)""")
def p17(v):
    s = v.stations.select("sid", "slat", (-c("slat")).alias("_o"))
    return ex.systematic_sample(s, "_o", ["sid"], 25).drop("_o")


@query("P18_code_from_name", """SELECT nullif(regexp_extract(n_name, '[1-6]', 0), '') AS segment, count(*) AS n FROM nation GROUP BY 1""")
def p18(v):
    return v.table("nation").groupBy(F.nullif(F.regexp_extract("n_name", "[1-6]", 0), lit("")).alias("segment")).agg(
        F.count(lit(1)).alias("n"))


REASONS = {"click": "sensor offline before 2016", "error": "upstream outage"}


@query("P19_gap_reason", """SELECT name, CASE name WHEN 'click' THEN 'sensor offline before 2016' WHEN 'error' THEN 'upstream outage' END AS reason,
  count(DISTINCT h) AS hours FROM series GROUP BY name""")
def p19(v):
    pairs = [lit(x) for kv in REASONS.items() for x in kv]
    g = v.series.groupBy("name").agg(F.countDistinct("h").alias("hours"))
    return g.select("name", F.try_element_at(F.create_map(*pairs), c("name")).alias("reason"), "hours")


# ---- sorts and top-k ------------------------------------------------------------------------------------------------

@query("T01_two_key_sort", "SELECT sid, network FROM stations")
def t01(v):
    return v.stations.select("sid", "network").orderBy(F.desc("network"), F.asc("sid"))


@query("T02_last_value", "SELECT name, arg_max(value, (t_us, id)) AS last_value FROM series GROUP BY name")
def t02(v):
    return v.series.groupBy("name").agg(F.max_by("value", F.struct("t_us", "id")).alias("last_value"))


@query("T03_top_cells", "SELECT ci, cj, count(*) AS n FROM quakes GROUP BY 1, 2 ORDER BY n DESC, ci, cj LIMIT 10")
def t03(v):
    return v.quakes.groupBy("ci", "cj").agg(F.count(lit(1)).alias("n")).orderBy(F.desc("n"), "ci", "cj").limit(10)


@query("T06_latest_run", """WITH d AS (SELECT station, dn, avg(value) AS v FROM station_obs GROUP BY 1, 2)
  SELECT station, max(dn) AS dn, round(arg_max(v, dn), 6) AS v FROM d GROUP BY station""")
def t06(v):
    d = v.station_obs.groupBy("station", "dn").agg(F.avg("value").alias("v"))
    return ag.latest_per_key(d, ["station"], ["dn"]).select("station", "dn", R(c("v")).alias("v"))


# ---- plain aggregations ---------------------------------------------------------------------------------------------

@query("A01_hourly_mean", "SELECT name, h * 3600 AS bucket, count(*) AS n, round(avg(value), 6) AS mean_value FROM series GROUP BY 1, 2")
def a01(v):
    s = v.series.withColumn("t", F.floor(c("t_us") / lit(1000000)))
    return ag.tumbling(s, "t", 3600, ["name"], F.count(lit(1)).alias("n"), R(F.avg("value")).alias("mean_value"))


@query("A02_latest_snapshot", "SELECT station, kind, value FROM station_obs WHERE h = (SELECT max(h) FROM station_obs)")
def a02(v):
    return ag.latest_snapshot(v.station_obs, "h").select("station", "kind", "value")


@query("A03_latest_per_station", """SELECT station, arg_max(value, (t_us, id)) AS value, max(t_us) AS t_us FROM station_obs GROUP BY station""")
def a03(v):
    return ag.latest_per_key(v.station_obs.select("station", "value", "t_us", "id"), ["station"], ["t_us", "id"]).select(
        "station", "value", "t_us")


@query("A04_kpi_row", f"""SELECT count(*) AS n, count(*) FILTER (t >= {NOW}-7*86400 AND t < {NOW}) AS n_7d, count(*) FILTER (mag >= 5) AS n_m5,
  count(DISTINCT ci*1000+cj) AS cells, arg_max(mag, (t, event_id)) AS last_mag, max(mag) AS max_mag FROM quakes""")
def a04(v):
    return v.quakes.agg(F.count(lit(1)).alias("n"), F.count_if((c("t") >= NOW - 7 * DAY) & (c("t") < NOW)).alias("n_7d"),
                        F.count_if(c("mag") >= 5).alias("n_m5"), F.countDistinct(c("ci") * 1000 + c("cj")).alias("cells"),
                        F.max_by("mag", F.struct("t", "event_id")).alias("last_mag"), F.max("mag").alias("max_mag"))


@query("A05_epoch_mean", "SELECT dn, round(avg(value), 6) AS mean_value FROM grid_obs GROUP BY dn")
def a05(v):
    return v.grid_obs.groupBy("dn").agg(R(F.avg("value")).alias("mean_value"))


@query("A06_cell_day_mean", "SELECT dn, gi, gj, round(avg(CASE WHEN quality > 0 THEN value END), 6) AS mean_value FROM grid_obs GROUP BY 1, 2, 3")
def a06(v):
    return v.grid_obs.groupBy("dn", "gi", "gj").agg(R(F.avg(F.when(c("quality") > 0, c("value")))).alias("mean_value"))


@query("A07_cell_count_mean", """SELECT dn, gi, gj, count(*) AS n, round(avg(nullif(quality, 0)), 6) AS mean_quality FROM grid_obs GROUP BY 1, 2, 3""")
def a07(v):
    return v.grid_obs.groupBy("dn", "gi", "gj").agg(F.count(lit(1)).alias("n"), R(F.avg(F.nullif(c("quality"), lit(0.0)))).alias("mean_quality"))


@query("A08_month_cell_max", """SELECT CAST(year(d)*100 + month(d) AS INT) AS ym, gi, gj, max(value) AS max_value FROM grid_obs GROUP BY 1, 2, 3""")
def a08(v):
    return v.grid_obs.groupBy((F.year("d") * 100 + F.month("d")).alias("ym"), "gi", "gj").agg(F.max("value").alias("max_value"))


@query("A09_year_cell_mean", "SELECT CAST(year(d) AS INT) AS yr, gi, gj, round(avg(value), 6) AS mean_value FROM grid_obs GROUP BY 1, 2, 3")
def a09(v):
    return v.grid_obs.groupBy(F.year("d").alias("yr"), "gi", "gj").agg(R(F.avg("value")).alias("mean_value"))


# Decades of the flux classes.
def flare_class(flux):
    """Letter and one decimal of the decade an X-ray flux falls in."""
    scale = F.when(flux >= 1e-4, 1e-4).when(flux >= 1e-5, 1e-5).when(flux >= 1e-6, 1e-6).when(flux >= 1e-7, 1e-7).otherwise(1e-8)
    letter = F.when(flux >= 1e-4, "X").when(flux >= 1e-5, "M").when(flux >= 1e-6, "C").when(flux >= 1e-7, "B").otherwise("A")
    return F.when(flux > 0, F.concat(letter, F.format_string("%.1f", flux / scale)))


@query("A10_flare_daily_max", """WITH m AS (SELECT dn, max(CASE WHEN kind='view' THEN value END)/1e6 AS xs, max(CASE WHEN kind='click' THEN value END)/1e6 AS xl
    FROM station_obs GROUP BY dn)
  SELECT dn, xs, xl, CASE WHEN xl >= 1e-4 THEN 'X' WHEN xl >= 1e-5 THEN 'M' WHEN xl >= 1e-6 THEN 'C' WHEN xl >= 1e-7 THEN 'B' ELSE 'A' END
   || printf('%.1f', xl / CASE WHEN xl >= 1e-4 THEN 1e-4 WHEN xl >= 1e-5 THEN 1e-5 WHEN xl >= 1e-6 THEN 1e-6 WHEN xl >= 1e-7 THEN 1e-7 ELSE 1e-8 END) AS flare FROM m""")
def a10(v):
    m = v.station_obs.groupBy("dn").agg((F.max(F.when(c("kind") == "view", c("value"))) / lit(1e6)).alias("xs"),
                                        (F.max(F.when(c("kind") == "click", c("value"))) / lit(1e6)).alias("xl"))
    return m.select("dn", "xs", "xl", flare_class(c("xl")).alias("flare"))


@query("A11_daily_max_sentinel", """SELECT dn, max(CASE WHEN flag <> 0 THEN value END) AS max_value, count(*) FILTER (flag = 0) AS n_sentinel
  FROM station_obs GROUP BY dn""")
def a11(v):
    return v.station_obs.groupBy("dn").agg(F.max(F.when(c("flag") != 0, c("value"))).alias("max_value"),
                                           F.count_if(c("flag") == 0).alias("n_sentinel"))


@query("A12_daily_min_max", """SELECT dn, min(flag) AS bz_min, max(value) AS pressure_max, min(value) AS dst_min FROM station_obs GROUP BY dn""")
def a12(v):
    return v.station_obs.groupBy("dn").agg(F.min("flag").alias("bz_min"), F.max("value").alias("pressure_max"), F.min("value").alias("dst_min"))


@query("A13_daily_range_ratio", """WITH a AS (SELECT dn, avg(value) AS m, max(value)-min(value) AS rv, max(flag)-min(flag) AS rf FROM station_obs GROUP BY dn)
  SELECT dn, round(m, 6) AS mean_value, round(rv, 6) AS value_range, round(CASE WHEN rf > 0 THEN rv/rf ELSE 1 END, 6) AS range_ratio FROM a""")
def a13(v):
    a = v.station_obs.groupBy("dn").agg(F.avg("value").alias("m"), (F.max("value") - F.min("value")).alias("rv"), (F.max("flag") - F.min("flag")).alias("rf"))
    return a.select("dn", R(c("m")).alias("mean_value"), R(c("rv")).alias("value_range"),
                    R(F.when(c("rf") > 0, F.try_divide(c("rv"), c("rf"))).otherwise(1.0)).alias("range_ratio"))


@query("A14_station_hour_mean", """SELECT station, h, round(avg(CASE WHEN flag <> 99 THEN value END), 6) AS mean_value, count(*) AS n FROM station_obs GROUP BY 1, 2""")
def a14(v):
    return v.station_obs.groupBy("station", "h").agg(R(F.avg(F.when(c("flag") != 99, c("value")))).alias("mean_value"), F.count(lit(1)).alias("n"))


@query("A15_day_variance", """SELECT station, round(var_pop(value), 4) AS power, count(*) AS n FROM station_obs GROUP BY station HAVING count(*) >= 30""")
def a15(v):
    return v.station_obs.groupBy("station").agg(R(F.var_pop("value"), 4).alias("power"), F.count(lit(1)).alias("n")).where("n >= 30")


@query("A15b_hour_variance", """SELECT station, h, round(var_pop(value), 4) AS power, count(*) AS n FROM station_obs GROUP BY station, h HAVING count(*) >= 2""")
def a15b(v):
    return v.station_obs.groupBy("station", "h").agg(R(F.var_pop("value"), 4).alias("power"), F.count(lit(1)).alias("n")).where("n >= 2")


@query("A16_station_day_stats", """SELECT station, dn, round(avg(value), 6) AS mean_value, min(value) AS low, max(value) AS high, count(*) AS n FROM station_obs GROUP BY 1, 2""")
def a16(v):
    return v.station_obs.groupBy("station", "dn").agg(R(F.avg("value")).alias("mean_value"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(lit(1)).alias("n"))


@query("A17_sessions", """WITH a AS (SELECT station, t, value, CASE WHEN t - lag(t) OVER (PARTITION BY station ORDER BY t, id) > 3600 THEN 1 ELSE 0 END AS f, id FROM station_obs),
  b AS (SELECT *, sum(f) OVER (PARTITION BY station ORDER BY t, id) AS s FROM a)
  SELECT station, min(t) AS t_start, max(t) AS t_end, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS low, max(value) AS high
  FROM b GROUP BY station, s HAVING count(*) >= 2""")
def a17(v):
    s = ag.sessions(v.station_obs, "station", "t", 3600, "value")
    return s.where("n >= 2").select("station", "t_start", "t_end", "n", R(c("mean"), 4).alias("mean"), R(c("std"), 4).alias("std"), "low", "high")


_MOVING = ["id", "station", "t", "CASE WHEN id % 11 <> 0 THEN value END AS value", "26 + ((id*7 + station*13) % 2001)/1e2 AS lat", "128 + ((id*17 + station*131) % 2001)/1e2 AS lon",
           "CAST(flag AS DOUBLE) AS rx", "value/1e1 AS ry", "CASE WHEN id % 5 <> 0 THEN CAST(id % 97 AS DOUBLE) END AS rz"]


@query("A17b_passes", f"""WITH o AS (SELECT {", ".join(_MOVING)} FROM station_obs), a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY station ORDER BY t, id) > 3600 THEN 1 ELSE 0 END AS f, sqrt(rx*rx + ry*ry + rz*rz) AS len FROM o),
  b AS (SELECT *, sum(f) OVER (PARTITION BY station ORDER BY t, id) AS s FROM a)
  SELECT station, min(t) AS t_start, max(t) - min(t) AS duration_s, count(*) AS n, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, round(avg(value), 4) AS value_mean, round(stddev_samp(value), 4) AS value_std,
   round(avg(len), 4) AS residual_mean, round(max(len), 4) AS residual_max FROM b GROUP BY station, s HAVING count(*) >= 2""")
def a17b(v):
    """One row in eleven lacks the value, one in five a component of the vector: some passes have neither."""
    s = ag.passes(v.station_obs.selectExpr(*_MOVING), "station", "t", 3600, "lat", "lon", "value", ["rx", "ry", "rz"])
    return s.select("station", "t_start", "duration_s", "n", "lat_min", "lat_max", "lon_min", "lon_max", *[R(c(x), 4).alias(x) for x in ("value_mean", "value_std", "residual_mean", "residual_max")])


@query("A18_month_climatology", """SELECT gi, gj, CAST(month(d) AS INT) AS mon, round(avg(value), 6) AS mean_value, round(coalesce(stddev_samp(value), 0), 6) AS std_value
  FROM grid_obs GROUP BY 1, 2, 3""")
def a18(v):
    return v.grid_obs.groupBy("gi", "gj", F.month("d").alias("mon")).agg(
        R(F.avg("value")).alias("mean_value"), R(F.coalesce(F.stddev_samp("value"), lit(0.0))).alias("std_value"))


@query("A19_month_hour_table", """SELECT CAST(month(make_timestamp(t*1000000)) AS INT) AS mon, (t % 86400)//3600 AS hr, round(avg(mag), 6) AS mean_mag, count(*) AS n FROM quakes GROUP BY 1, 2""")
def a19(v):
    return v.quakes.groupBy(F.month(F.timestamp_seconds("t")).alias("mon"), hour_of(c("t")).alias("hr")).agg(
        R(F.avg("mag")).alias("mean_mag"), F.count(lit(1)).alias("n"))


@query("A20_cell_baseline", """WITH m AS (SELECT CAST(year(d)*100+month(d) AS INT) AS ym, gi, gj, avg(value) AS v FROM grid_obs GROUP BY 1, 2, 3),
  b AS (SELECT gi, gj, avg(v) AS mu, stddev_pop(v) AS sd FROM m GROUP BY 1, 2)
  SELECT ym, gi, gj, round(v, 6) AS v, round(mu, 6) AS mu, round(sd, 6) AS sd, 0.0 + round(v - mu, 6) AS anomaly FROM m JOIN b USING (gi, gj)""")
def a20(v):
    m = v.grid_obs.groupBy((F.year("d") * 100 + F.month("d")).alias("ym"), "gi", "gj").agg(F.avg("value").alias("v"))
    w = W.partitionBy("gi", "gj")  # months of one cell: bounded by the calendar
    return m.select("ym", "gi", "gj", R(c("v")).alias("v"), R(F.avg("v").over(w)).alias("mu"), R(F.stddev_pop("v").over(w)).alias("sd"),
                    R(c("v") - F.avg("v").over(w)).alias("anomaly"))


@query("A42_availability", """SELECT round(count(nullif(flag, 0))/count(*), 6) AS flag_share, round(count(CASE WHEN value > 100 THEN 1 END)/count(*), 6) AS value_share FROM station_obs""")
def a42(v):
    return v.station_obs.agg(R(F.count(F.nullif(c("flag"), lit(0))) / F.count(lit(1))).alias("flag_share"),
                             R(F.count(F.when(c("value") > 100, 1)) / F.count(lit(1))).alias("value_share"))


@query("A48_nonzero_rate", """WITH l AS (SELECT unnest(['disc', 'y', 'p']) AS feature, unnest([disc, CAST(y AS DOUBLE), p]) AS v FROM scores)
  SELECT feature, round(avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero_rate, CAST(max(CASE WHEN v <> 0 THEN 1 ELSE 0 END) = 0 AS INT) AS zero_hit FROM l GROUP BY feature""")
def a48(v):
    # one row per feature comes out of one aggregate row: nothing is unpivoted per input row
    feats = ["disc", "y", "p"]
    one = v.scores.agg(*[F.avg((c(f) != 0).cast("double")).alias(f) for f in feats])
    return one.unpivot([], feats, "feature", "r").select("feature", R(c("r")).alias("nonzero_rate"), (c("r") == 0).cast("int").alias("zero_hit"))


@query("A54_coverage", """SELECT kind, count(DISTINCT station) AS stations, count(DISTINCT dn) AS days, min(dn) AS first_day, max(dn) AS last_day FROM station_obs GROUP BY kind""")
def a54(v):
    # distinct (kind, station) and (kind, day) are combined before they are counted, so a hot kind spreads out
    o = v.station_obs
    s = o.select("kind", "station").distinct().groupBy("kind").agg(F.count(lit(1)).alias("stations"))
    d = o.select("kind", "dn").distinct().groupBy("kind").agg(F.count(lit(1)).alias("days"), F.min("dn").alias("first_day"), F.max("dn").alias("last_day"))
    return s.join(d, "kind")


@query("A66_resume_point", """SELECT station, CAST(max(d) + INTERVAL 1 DAY AS VARCHAR)[1:10] AS resume_day FROM daily_obs GROUP BY station""")
def a66(v):
    return v.daily_obs.groupBy("station").agg(F.date_format(F.date_add(F.coalesce(F.max("d"), lit("2011-01-01").cast("date")), 1), "yyyy-MM-dd").alias("resume_day"))


@query("A67_existing_days", """SELECT station, count(DISTINCT dn) AS days FROM station_obs GROUP BY station""")
def a67(v):
    return v.station_obs.select("station", "dn").distinct().groupBy("station").agg(F.count(lit(1)).alias("days"))


# ---- scalar functions -----------------------------------------------------------------------------------------------

@query("F01_snap_modes", """SELECT event_id, round_even(lat/2e0,0)*2e0 AS nearest_even, floor(lon/5e-1)*5e-1 + 25e-2 AS floor_center,
  CAST(floor((lat - 25e0)/5e-1) AS INT) AS idx FROM quakes""")
def f01(v):
    return v.quakes.select("event_id", sp.snap(c("lat"), 2, "nearest_even").alias("nearest_even"), sp.snap(c("lon"), 0.5, "floor_center").alias("floor_center"),
                           sp.snap(c("lat"), 0.5, "index", 25.0).alias("idx"))


@query("F02_distances", """SELECT event_id, round(sqrt(pow(lat-36e0,2) + pow((lon-140e0)*cos(radians(lat)),2)), 6) AS deg,
  round(2*6371e0*asin(sqrt(pow(sin(radians(36e0-lat)/2),2)+cos(radians(lat))*cos(radians(36e0))*pow(sin(radians(140e0-lon)/2),2))), 4) AS km,
  round((degrees(atan2(sin(radians(140e0-lon))*cos(radians(36e0)), cos(radians(lat))*sin(radians(36e0))-sin(radians(lat))*cos(radians(36e0))*cos(radians(140e0-lon))))+360e0) % 360e0, 4) AS az
  FROM quakes""")
def f02(v):
    a, o = lit(36.0), lit(140.0)
    return v.quakes.select("event_id", R(sp.degree_distance(c("lat"), c("lon"), a, o)).alias("deg"),
                           R(sp.haversine_km(c("lat"), c("lon"), a, o), 4).alias("km"), R(sp.azimuth_deg(c("lat"), c("lon"), a, o), 4).alias("az"))


@query("F09_year_fraction", """WITH q AS (SELECT event_id, t, make_timestamp(t*1000000) AS ts FROM quakes)
  SELECT event_id, round(year(ts) + (t - epoch(make_timestamp(year(ts),1,1,0,0,0.0)))/(epoch(make_timestamp(year(ts)+1,1,1,0,0,0.0)) - epoch(make_timestamp(year(ts),1,1,0,0,0.0))), 8) AS yf FROM q""")
def f09(v):
    return v.quakes.select("event_id", R(sc.year_fraction(c("t")), 8).alias("yf"))


@query("F10_time_text", """SELECT event_id, strftime(make_timestamp(t*1000000), '%Y-%m-%dT%H:00:00Z') AS hour_text, CAST(dayofyear(make_timestamp(t*1000000)) AS INT) AS doy,
  strftime(make_timestamp((t - 9*3600)*1000000), '%Y-%m-%d %H:%M:%S') AS utc_from_local FROM quakes""")
def f10(v):
    ts = F.timestamp_seconds("t")
    local = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), lit("+09:00"))
    return v.quakes.select("event_id", F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH:00:00'Z'").alias("hour_text"), F.dayofyear(ts).alias("doy"),
                           F.date_format(F.to_timestamp(local), "yyyy-MM-dd HH:mm:ss").alias("utc_from_local"))


@query("F13_sinusoidal_tile", """WITH a AS (SELECT sid, 90e0 - (CAST(network % 18 AS INT) + (sid % 2400 + 5e-1)/2400e0)*10e0 AS la, (CAST(network AS INT) + (sid*7 % 2400 + 5e-1)/2400e0)*10e0 - 180e0 AS x FROM stations)
  SELECT sid, round(la, 6) AS lat, round(x / cos(radians(la)), 4) AS lon FROM a""")
def f13(v):
    lat, lon = sp.sinusoidal_tile(c("network"), c("network") % 18, c("sid") % 2400, (c("sid") * 7) % 2400, 2400)
    return v.stations.select("sid", R(lat).alias("lat"), R(lon, 4).alias("lon"))


@query("F14_velocity", """WITH p AS (SELECT station, dn, avg(value) AS v FROM daily_obs GROUP BY 1, 2), g AS (SELECT *, lag(dn) OVER w AS pd, lag(v) OVER w AS pv FROM p WINDOW w AS (PARTITION BY station ORDER BY dn))
  SELECT station, dn, 0.0 + round((v - pv) / (dn - pd) * 36525e-2, 4) AS velocity_per_year FROM g WHERE pd IS NOT NULL""")
def f14(v):
    p = v.daily_obs.groupBy("station", "dn").agg(F.avg("value").alias("v"))
    w = W.partitionBy("station").orderBy("dn")  # days of one station
    g = p.select("station", "dn", "v", F.lag("dn").over(w).alias("pd"), F.lag("v").over(w).alias("pv")).where("pd IS NOT NULL")
    return g.select("station", "dn", R((c("v") - c("pv")) / (c("dn") - c("pd")) * lit(365.25), 4).alias("velocity_per_year"))


@query("F17_floored_scores", """SELECT station, dn, round(CASE WHEN max(value) > 0 THEN log10(greatest(max(value)/1e6, 1e-9)) ELSE -9 END, 6) AS log_flux,
  round((max(value)-avg(value))/greatest(stddev_pop(value), 1e-1), 6) AS z, round(max(value)/greatest(avg(value), 1e-2), 6) AS ratio FROM station_obs GROUP BY 1, 2""")
def f17(v):
    g = v.station_obs.groupBy("station", "dn").agg(F.max("value").alias("mx"), F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return g.select("station", "dn", R(sc.log_floor(c("mx") / lit(1e6), 1e-9)).alias("log_flux"),
                    R((c("mx") - c("mu")) / F.greatest(c("sd"), lit(0.1))).alias("z"), R(sc.ratio_floor(c("mx"), c("mu"), 0.01)).alias("ratio"))


@query("F20_norms", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings""")
def f20(v):
    sq = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), lit(0.0), lambda a, x: a + x)
    return v.table("embeddings").select("vec_id", R(F.sqrt(sq), 5).alias("norm"))
