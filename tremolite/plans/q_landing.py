"""Landing, sink and quality queries (S*, K*, U09, D*, A61-A65).

The parser queries format whole driver tables as the text a feed would deliver, inside Spark, and parse it back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import spectral as sp
from ..operators import joins as jn, quality as ql, sinks as sk
from ..sources import binary as bi, json as sj, text as st
from . import epochs as ep
from .q_basic import DAY, NOW, R
from .q_joins import CELL_SQL, bounds, catalogue_cells
from .registry import query

c, lit = F.col, F.lit


def text(df, expr):
    return df.select(expr.alias("value"))


@query("S02_geojson_events", "SELECT CAST(event_id AS VARCHAR) AS event_id, t, lat, lon, depth_km, mag FROM quakes WHERE event_id % 7 <> 0")
def s02(v):
    # one small document per event; every seventh feature lacks its third coordinate and must drop out
    q = v.quakes
    xyz = F.when(c("event_id") % 7 == 0, F.array("lon", "lat")).otherwise(F.array("lon", "lat", "depth_km"))
    doc = F.to_json(F.struct(F.array(F.struct(F.struct(c("event_id").cast("string").alias("code"), (c("t") * 1000).alias("time"), c("mag"), lit("mw").alias("magType"), lit("x").alias("place")).alias("properties"),
                                              F.struct(xyz.alias("coordinates")).alias("geometry"))).alias("features")))
    return sj.parse_geojson_events(text(q, doc)).select("event_id", F.unix_seconds("ts").alias("t"), "lat", "lon", "depth_km", "mag")


@query("S03_local_time_quakes", "SELECT CAST(event_id AS VARCHAR) AS event_id, t - 9*3600 AS t, lat, lon, mag FROM quakes")
def s03(v):
    q = v.quakes
    local = F.date_format(F.timestamp_seconds("t"), "yyyy/MM/dd HH:mm:ss")
    rec = F.struct(c("event_id").cast("string").alias("id"), local.alias("time"), F.struct(lit(30).alias("maxScale"), F.struct(lit("n").alias("name"), c("lat").alias("latitude"), c("lon").alias("longitude"), c("depth_km").alias("depth"), c("mag").alias("magnitude")).alias("hypocenter")).alias("earthquake"))
    return sj.parse_local_quakes(text(q, F.to_json(F.array(rec)))).select("event_id", F.unix_seconds("ts").alias("t"), "lat", "lon", "mag")


@query("S04_packed_bulletins", "SELECT CAST(event_id AS VARCHAR) AS event_id, round(lat, 2) AS lat, round(lon, 2) AS lon, depth_km, mag, CASE WHEN mag >= 5 THEN 45 ELSE 30 END AS max_intensity FROM quakes")
def s04(v):
    q = v.quakes
    cod = F.format_string("+%.2f+%.2f-%d/", "lat", "lon", (c("depth_km") * 1000).cast("int"))
    rec = F.struct(c("event_id").cast("string").alias("eid"), lit("2024-01-01T00:00:00+09:00").alias("at"), cod.alias("cod"), F.when(c("mag") >= 5, "5-").otherwise("3").alias("maxi"), c("mag").cast("string").alias("mag"), lit("a").alias("anm"), lit("b").alias("en_anm"))
    return sj.parse_bulletins(text(q, F.to_json(F.array(rec)))).select("event_id", "lat", "lon", "depth_km", "mag", "max_intensity")


@query("S05_station_snapshot", """SELECT CAST(id AS VARCHAR) AS station, round(value, 2) AS temp, CAST(flag AS DOUBLE) AS pressure, round(26 + (id % 60)/6e1, 6) AS lat FROM station_obs""")
def s05(v):
    o = v.station_obs
    # one snapshot document per reading; the station table is built from the same ids
    m = F.create_map(c("id").cast("string"), F.create_map(lit("temp"), F.array(F.round("value", 2), lit(0.0)), lit("pressure"), F.array(c("flag").cast("double"), lit(0.0))))
    meta = F.create_map(c("id").cast("string"), F.struct(lit("s").alias("kjName"), F.array(lit(26.0), (c("id") % 60).cast("double")).alias("lat"), F.array(lit(130.0), lit(30.0)).alias("lon")))
    return sj.parse_station_snapshot(text(o, F.to_json(m)), text(o, F.to_json(meta))).select("station", "temp", "pressure", R(c("lat")).alias("lat"))


@query("S06_header_rows", "SELECT CAST(event_id AS VARCHAR) AS time_tag, mag AS kp, CAST(NULL AS DOUBLE) AS a_running, CAST(depth_km AS INT) AS station_count FROM quakes")
def s06(v):
    rows = F.array(F.array(lit("time_tag"), lit("Kp"), lit("a_running"), lit("station_count")), F.array(c("event_id").cast("string"), c("mag").cast("string"), lit(""), c("depth_km").cast("int").cast("string")))
    return sj.parse_header_rows(text(v.quakes, F.to_json(rows)))


@query("S07_columnar_table", "SELECT CAST(dn AS VARCHAR) AS observed_at, glat AS lat, glon AS lon, CASE WHEN quality > 0 THEN quality END AS value FROM grid_obs WHERE quality > 0")
def s07(v):
    g = v.grid_obs
    row = F.array(c("dn").cast("string"), c("glat").cast("string"), c("glon").cast("string"), F.when(c("quality") > 0, c("quality")).cast("string"))
    doc = F.to_json(F.struct(F.struct(F.array(*[lit(x) for x in ("time", "latitude", "longitude", "analysed_sst")]).alias("columnNames"), F.array(row).alias("rows")).alias("table")), {"ignoreNullFields": "false"})
    return sj.parse_columnar_table(text(g, doc))


@query("S11_space_weather_text", """SELECT t - t % 3600 AS observed, CASE WHEN flag = 0 THEN NULL ELSE CAST(flag AS DOUBLE) END AS bz, round(value, 2) AS speed FROM station_obs""")
def s11(v):
    o = v.station_obs
    ts = F.timestamp_seconds("t")
    cols = [F.year(ts).cast("string"), F.dayofyear(ts).cast("string"), F.hour(ts).cast("string")] + [lit("0")] * 10
    cols += [F.when(c("flag") == 0, "9999.99").otherwise(c("flag").cast("string"))] + [lit("0")] * 9 + [F.format_string("%.2f", F.round("value", 2)), lit("999.9"), lit("0"), lit("0"), lit("99.99")] + [lit("0")] * 12 + [lit("99999")]
    return st.parse_hourly_space_weather(text(o, F.concat_ws("  ", *cols))).select(F.unix_seconds("observed_at").alias("observed"), "bz", "speed")


@query("S12_earth_rotation_text", "SELECT CAST(station AS DOUBLE) AS x, CAST(line AS DOUBLE) AS y, round(tax*1000, 6) AS lod, CAST(year(d) AS INT) AS yr FROM daily_obs")
def s12(v):
    d = v.daily_obs
    line = F.concat_ws("   ", F.year("d"), F.month("d"), F.dayofmonth("d"), lit("50000"), c("station"), c("line"), lit("0.1"), c("tax"))
    return st.parse_earth_rotation(text(d, line), 1900).select("x", "y", R(c("lod")).alias("lod"), F.year("date").alias("yr"))


@query("S13_neutron_series", "SELECT CAST(d AS VARCHAR)[1:10] AS date, qty AS counts FROM daily_obs WHERE disc > 0")
def s13(v):
    line = F.concat(F.date_format("d", "yyyy-MM-dd"), lit(" 12:00:00;"), F.when(c("disc") > 0, c("qty").cast("string")).otherwise("null"))
    return st.parse_neutron_counts(text(v.daily_obs, line))


@query("S14_wide_kp", "SELECT CAST(year(d) AS INT) AS yr, CAST(k*3 AS INT) AS hr, CAST(line AS DOUBLE) AS kp, count(*) AS n FROM daily_obs, range(8) r(k) GROUP BY 1,2,3")
def s14(v):
    line = F.concat_ws(" ", F.year("d"), F.month("d"), F.dayofmonth("d"), lit("1 2 3 4"), *[c("line")] * 8)
    k = st.parse_wide_kp(text(v.daily_obs, line), 1900)
    return k.groupBy(F.year("time_tag").alias("yr"), F.hour("time_tag").alias("hr"), "kp").agg(F.count(lit(1)).alias("n"))


@query("S15_observatory_minutes", "SELECT t - t % 60 AS t, CASE WHEN flag = 0 THEN NULL ELSE CAST(flag AS DOUBLE) END AS h, round(value, 2) AS z FROM station_obs")
def s15(v):
    ts = F.timestamp_seconds(c("t") - c("t") % 60)
    line = F.concat_ws("  ", F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss.SSS"), lit("001"), F.when(c("flag") == 0, "99999.00").otherwise(c("flag").cast("string")), lit("88888.00"), F.format_string("%.2f", F.round("value", 2)), lit("1.0"))
    return st.parse_observatory_minutes(text(v.station_obs, line), "AAA").select(F.unix_seconds("observed_at").alias("t"), "h", "z")


@query("S17_buoy_text", "SELECT t - t % 60 AS t, round(value, 2) AS water_height_m FROM station_obs WHERE flag <> 0")
def s17(v):
    ts = F.timestamp_seconds("t")
    line = F.concat_ws(" ", F.date_format(ts, "yy MM dd HH mm"), lit("1 2"), F.when(c("flag") == 0, "9999.000").otherwise(F.format_string("%.2f", F.round("value", 2))))
    return st.parse_buoy(text(v.station_obs, line)).select(F.unix_seconds("observed_at").alias("t"), "water_height_m")


@query("S18_sensor_filter", "SELECT round(value, 2) AS sea_level_m, count(*) AS n FROM station_obs WHERE kind <> 'error' GROUP BY 1")
def s18(v):
    rec = F.struct(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd HH:mm:ss").alias("stime"), F.format_string("%.2f", F.round("value", 2)).alias("slevel"), F.when(c("kind") == "error", "prt").when(c("kind") == "view", " RAD ").alias("sensor"))
    return sj.parse_sensor_records(text(v.station_obs, F.to_json(F.array(rec)))).groupBy("sea_level_m").agg(F.count(lit(1)).alias("n"))


@query("S19_grid_csv_cells", """SELECT CAST(d AS VARCHAR)[1:10] AS date, floor(glat/2e0)*2+1 AS cell_lat, floor(glon/2e0)*2+1 AS cell_lon, count(*) AS n, round(max(quality*1e1), 4) AS top FROM grid_obs WHERE quality*1e1 BETWEEN 1e-1 AND 8e-1 GROUP BY 1,2,3""")
def s19(v):
    line = F.concat_ws(",", F.date_format("d", "yyyy-MM-dd'T00:00:00Z'"), "glat", "glon", "quality")
    g = v.grid_obs
    cells = st.grid_csv_cells(text(g, line), 0.1, 0.8, 10.0)
    top = g.where((c("quality") * 10).between(0.1, 0.8)).groupBy(F.date_format("d", "yyyy-MM-dd").alias("date"), (F.floor(c("glat") / 2) * 2 + 1).cast("double").alias("cell_lat"), (F.floor(c("glon") / 2) * 2 + 1).cast("double").alias("cell_lon")).agg(R(F.max(c("quality") * 10), 4).alias("top"))
    return cells.select("date", c("cell_lat").cast("double").alias("cell_lat"), c("cell_lon").cast("double").alias("cell_lon"), "n").join(top, ["date", "cell_lat", "cell_lon"])


@query("S24_electron_daily_max", "SELECT strftime(make_timestamp(dn*86400000000), '%Y-%m-%d') AS date, max(round(value, 2)) FILTER (kind = 'view') AS electron_2mev_max, max(round(value, 2)) FILTER (kind = 'click') AS electron_800kev_max FROM station_obs GROUP BY 1")
def s24(v):
    rec = F.struct(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time_tag"), F.when(c("kind") == "view", ">=2 MeV").when(c("kind") == "click", ">= 800 keV").otherwise("other").alias("energy"), F.round("value", 2).alias("flux"))
    return sj.parse_electron_flux(text(v.station_obs, F.to_json(F.array(rec))))


@query("S29_land_temperature", "SELECT CAST(d AS VARCHAR)[1:10] AS date, round((10000 + qty*50)*2e-2, 4) AS lst_k, count(*) AS n FROM daily_obs WHERE line < 5 GROUP BY 1, 2")
def s29(v):
    s = F.struct(F.when(c("line") < 5, "LST_Day_1km").otherwise("QC_Day").alias("band"), F.date_format("d", "yyyy-MM-dd").alias("calendar_date"), F.array(lit(0.0), c("qty") * 50 + 10000, lit(65535.0)).alias("data"))
    return sj.parse_land_temperature(text(v.daily_obs, F.to_json(F.struct(F.array(s).alias("subset"))))).groupBy("date", R(c("lst_k"), 4).alias("lst_k")).agg(F.count(lit(1)).alias("n"))


@query("S34_parallel_arrays", "SELECT t, mag AS kp FROM quakes")
def s34(v):
    doc = F.to_json(F.struct(F.array(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("datetime"), F.array("mag").alias("Kp")))
    return sj.parse_parallel_arrays(text(v.quakes, doc)).select(F.unix_seconds("time_tag").alias("t"), "kp")


@query("S26_feature_tensor", "SELECT CAST(dn AS BIGINT) AS dn, mag AS f1, depth_km AS f2 FROM quakes")
def s26(v):
    doc = F.to_json(F.struct(F.array(F.array(F.array(F.array(c("dn").cast("double"), c("mag"), c("depth_km"))))).alias("tensor")))
    t = sj.parse_feature_tensor(text(v.quakes, doc))
    return t.select(c("features")[0].cast("long").alias("dn"), c("features")[1].alias("f1"), c("features")[2].alias("f2"))


@query("S27_prediction_records", "SELECT ci*2e0 AS cell_lat, cj*2e0 AS cell_lon, CAST(dn AS DOUBLE) AS t_days, mag AS prob FROM quakes")
def s27(v):
    rec = F.struct((c("ci") * 2.0).alias("cell_lat"), (c("cj") * 2.0).alias("cell_lon"), c("dn").cast("double").alias("t_days"), c("mag").alias("prob"), lit(0).alias("label"))
    return sj.parse_predictions(text(v.quakes, F.to_json(F.struct(F.array(rec).alias("predictions"))))).drop("label")


# ---- sinks ----------------------------------------------------------------------------------------------------------

@query("K01_append_new_keys", """WITH o AS (SELECT station, h, min(value) AS value FROM station_obs WHERE kind IN ('view','click') GROUP BY 1,2), n AS (SELECT station, h, arg_min(value, (t_us, id)) AS value FROM station_obs WHERE kind NOT IN ('view','click') GROUP BY 1,2)
  SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.station=n.station AND o.h=n.h)""")
def k01(v):
    path = sk.scratch(v.spark, "append")
    o = v.station_obs
    o.where("kind IN ('view', 'click')").groupBy("station", "h").agg(F.min("value").alias("value")).write.parquet(path)
    new = sk.first_per_key(o.where("kind NOT IN ('view', 'click')").select("station", "h", "value", "t_us", "id"), ["station", "h"], ["t_us", "id"]).select("station", "h", "value")
    sk.append_new(new, path, ["station", "h"], ["value"])
    sk.append_new(new, path, ["station", "h"], ["value"])  # a second run must add nothing
    return v.spark.read.parquet(path)


@query("K02_upsert", """WITH o AS (SELECT station, max(value) AS level, min(flag) AS code FROM station_obs WHERE dn < 19735 GROUP BY 1), n AS (SELECT station, arg_max(value, (t_us, id)) AS level, arg_max(flag, (t_us, id)) AS code FROM station_obs WHERE dn >= 19735 GROUP BY 1)
  SELECT coalesce(o.station, n.station) AS station, coalesce(n.level, o.level) AS level, coalesce(o.code, n.code) AS code FROM o FULL JOIN n ON o.station = n.station""")
def k02(v):
    o = v.station_obs
    old = o.where("dn < 19735").groupBy("station").agg(F.max("value").alias("level"), F.min("flag").alias("code"))
    new = o.where("dn >= 19735").select("station", c("value").alias("level"), c("flag").alias("code"), "t_us", "id")
    return sk.upsert(old, new, ["station"], ["level"], ["t_us", "id"]).select("station", "level", "code")


@query("K03_retry_counters", """SELECT station, dn, count(*) AS retry_count, max(t) AS last_failed FROM attempts WHERE failed = 1 GROUP BY 1, 2""")
def k03(v):
    a = v.attempts.where("failed = 1").select("station", "dn", lit(1).cast("long").alias("retry_count"), c("t").alias("last_failed"))
    ledger = a.where("dn < 19735").groupBy("station", "dn").agg(F.sum("retry_count").alias("retry_count"), F.max("last_failed").alias("last_failed"))
    return sk.bump_counters(ledger, a.where("dn >= 19735"), ["station", "dn"])


@query("K04_retention", f"SELECT count(*) FILTER (t >= {NOW} - 90*86400) AS kept, count(*) FILTER (t < {NOW} - 90*86400) AS deleted FROM quakes")
def k04(v):
    kept, deleted = sk.retain(v.quakes, "t", lit(NOW - 90 * DAY))
    return deleted.select(kept.select(F.count(lit(1))).scalar().alias("kept"), "deleted")


@query("K05_targeted_delete", "SELECT kind, count(*) FILTER (station IN (3, 5, 7, 11) AND dn BETWEEN 19730 AND 19740) AS n_deleted, count(*) FILTER (NOT (station IN (3, 5, 7, 11) AND dn BETWEEN 19730 AND 19740)) AS n_left FROM station_obs GROUP BY 1")
def k05(v):
    preview, left = sk.delete_matching(v.station_obs, c("station").isin(3, 5, 7, 11) & c("dn").between(19730, 19740), ["kind"])
    return left.groupBy("kind").agg(F.count(lit(1)).alias("n_left")).join(preview.withColumnRenamed("n", "n_deleted"), "kind", "left").withColumn("n_deleted", F.coalesce("n_deleted", lit(0).cast("long")))


@query("K06_json_export", "SELECT event_id, mag, CASE WHEN event_id % 5 <> 0 THEN depth_km END AS depth_km FROM quakes")
def k06(v):
    path = sk.scratch(v.spark, "json")
    q = v.quakes.select("event_id", "mag", F.when(c("event_id") % 10 == 0, lit(float("nan"))).when(c("event_id") % 10 == 5, lit(float("inf"))).otherwise(c("depth_km")).alias("depth_km"))
    sk.export_json(q, path)
    return v.spark.read.schema("event_id long, mag double, depth_km double").json(path)


@query("K07_append_metadata", "SELECT name AS feature, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS nonzero_rate FROM series GROUP BY 1")
def k07(v):
    path = sk.scratch(v.spark, "meta")
    r = v.series.groupBy(c("name").alias("feature")).agg(R(F.avg((c("value") > 50).cast("double"))).alias("nonzero_rate")).withColumn("loaded_at", F.current_timestamp())
    r.write.mode("append").parquet(path)
    return v.spark.read.parquet(path).drop("loaded_at")


@query("K08_forecast_xml")
def k08(v):
    from .q_metrics import g15
    path = sk.scratch(v.spark, "xml")
    sk.export_xml_lines(g15(v), path)
    return v.spark.read.text(path).agg(F.count_if(F.contains("value", lit("<Cell>"))).alias("n_cells"))


@query("K09_report_rows", """WITH a AS (SELECT name AS grp, CAST(count(*) AS DOUBLE) AS n, max(value) AS high FROM series GROUP BY 1) SELECT grp, 'n' AS metric, n AS value FROM a UNION ALL SELECT grp, 'high', high FROM a""")
def k09(v):
    return sk.report_rows(v.series.groupBy("name").agg(F.count(lit(1)).alias("n"), F.max("value").alias("high")), ["name"])


@query("K10_dense_tensor", f"""WITH {CELL_SQL}, b AS (SELECT ci, cj, m FROM cells, (SELECT unnest(range(0, CAST((SELECT max((dn-9131)//30) FROM quakes) AS BIGINT) + 1)) AS m)), a AS (SELECT ci, cj, (dn-9131)//30 AS m, count(*) AS n, max(mag) AS mx FROM quakes GROUP BY 1,2,3)
  SELECT ci, cj, m, [CAST(coalesce(n,0) AS DOUBLE), coalesce(mx, 0)] AS features FROM b LEFT JOIN a USING (ci, cj, m)""")
def k10(v):
    from ..operators import expand as ex
    a = v.quakes.groupBy("ci", "cj", F.floor((c("dn") - 9131) / 30).alias("m")).agg(F.count(lit(1)).alias("n"), F.max("mag").alias("mx"))
    grid = ex.with_steps(catalogue_cells(v), 0, (bounds(v)["dn1"] - 9131) // 30, 1, "m")
    return sk.dense_vectors(a, grid, ["ci", "cj", "m"], ["n", "mx"])


@query("K11_subset_export", "SELECT 'region' AS tbl, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation")
def k11(v):
    root = sk.scratch(v.spark, "subset")
    done = sk.export_tables({"region": v.table("region"), "nation": v.table("nation"), "absent": None}, root)
    parts = [v.spark.read.parquet(f"{root}/{n}").agg(F.count(lit(1)).alias("n")).select(lit(n).alias("tbl"), "n") for n in done]
    return parts[0].unionByName(parts[1])


@query("K12_partitioned_predictions", "SELECT fold, count(*) AS n, round(avg(p), 8) AS mean_p FROM scores GROUP BY 1")
def k12(v):
    path = sk.scratch(v.spark, "pred")
    v.scores.select("k", "y", "p", "fold").repartition("fold", F.pmod(F.xxhash64("k"), lit(32))).write.partitionBy("fold").parquet(path)
    return v.spark.read.parquet(path).groupBy("fold").agg(F.count(lit(1)).alias("n"), R(F.avg("p"), 8).alias("mean_p"))


@query("U09_overlay", """SELECT 'grown' AS tbl, count(*) AS n, round(sum(value), 2) AS total FROM station_obs UNION ALL SELECT 'shrunk', count(*), round(sum(value), 2) FROM station_obs WHERE dn < 19740""")
def u09(v):
    o = v.station_obs.select("id", "value", "dn")
    early, late = o.where("dn < 19740"), o.where("dn >= 19745")
    grown, shrunk = sk.overlay(early, o), sk.overlay(early, late)
    tot = lambda d, n: d.agg(F.count(lit(1)).alias("n"), R(F.sum("value"), 2).alias("total")).select(lit(n).alias("tbl"), "n", "total")
    return tot(grown, "grown").unionByName(tot(shrunk, "shrunk"))


# ---- quality --------------------------------------------------------------------------------------------------------

def report(v):
    return ql.table_report({
        "quakes": {"df": v.quakes, "day": "dn", "min_rows": 100, "expected_days": 2403},
        "station_obs": {"df": v.station_obs, "day": "dn", "min_rows": 10 ** 12, "expected_days": 60},
        "grid_obs": {"df": v.grid_obs.where("dn < 0"), "day": "dn", "min_rows": 1, "expected_days": 100},
        "radon": {"df": None}}, v.spark)


_REP = """rep AS (SELECT 'quakes' AS "table", count(*) AS rows, min(dn) AS first_day, max(dn) AS last_day, round(least((max(dn)-min(dn))/2403e0*100, 100), 1) AS coverage_pct, CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) < 100 THEN 'LOW' ELSE 'OK' END AS status FROM quakes
  UNION ALL SELECT 'station_obs', count(*), min(dn), max(dn), round(least((max(dn)-min(dn))/60e0*100, 100), 1), 'LOW' FROM station_obs UNION ALL SELECT 'grid_obs', 0, NULL, NULL, NULL, 'EMPTY' UNION ALL SELECT 'radon', 0, NULL, NULL, NULL, 'MISSING')"""


@query("D01_table_report", f"WITH {_REP} SELECT * FROM rep")
def d01(v):
    return report(v)


@query("D01b_overall_status", f"WITH {_REP} SELECT 'CRITICAL' AS status, count(*) FILTER (status='OK') AS ok, count(*) FILTER (status='LOW') AS low, count(*) FILTER (status='EMPTY') AS empty, count(*) FILTER (status='MISSING') AS missing FROM rep")
def d01b(v):
    return ql.overall(report(v), ["quakes", "grid_obs"])


@query("D02_run_over_run", """SELECT kind AS "table", count(*) FILTER (dn < 19738) AS rows, count(*) AS prev_rows, 'OK' AS status, 'OK' AS prev_status, 'rows' AS kind FROM station_obs GROUP BY 1 HAVING count(*) FILTER (dn < 19738) < count(*)*8e-1""")
def d02(v):
    o = v.station_obs
    now = o.where("dn < 19738").groupBy(c("kind").alias("table")).agg(F.count(lit(1)).alias("rows")).withColumn("status", lit("OK"))
    before = o.groupBy(c("kind").alias("table")).agg(F.count(lit(1)).alias("rows")).withColumn("status", lit("OK"))
    return ql.regressions(now, before)


@query("D03_gap_report", """WITH h AS (SELECT CAST(year(d) AS INT) AS year, count(DISTINCT d) AS days FROM daily_obs GROUP BY 1) SELECT CAST(r.y AS INT) AS year, coalesce(days, 0) AS days, round(least(coalesce(days,0)/365e0*100, 100), 2) AS coverage_pct, CAST(coalesce(days,0) = 0 AS INT) AS gap FROM range(1993, 2003) r(y) LEFT JOIN h ON h.year = r.y""")
def d03(v):
    return ql.gap_diagnosis(v.daily_obs.withColumn("yr", F.year("d")), "yr", "d", 1993, 2002)


@query("D04_table_probe", """SELECT 'quakes' AS "table", count(*) AS rows, count(DISTINCT dn) AS days FROM quakes UNION ALL SELECT 'station_obs', count(*), count(DISTINCT dn) FROM station_obs UNION ALL SELECT 'daily_obs', count(*), count(DISTINCT dn) FROM daily_obs""")
def d04(v):
    out = None
    for n in ("quakes", "station_obs", "daily_obs"):
        d = getattr(v, n).groupBy("dn").agg(F.count(lit(1)).alias("k")).agg(F.sum("k").alias("rows"), F.count(lit(1)).alias("days")).select(lit(n).alias("table"), "rows", "days")
        out = d if out is None else out.unionByName(d)
    return out


def published(v):
    o = v.station_obs
    return o.groupBy(c("kind").alias("table")).agg(F.count_if(c("dn") < 19738).alias("rows"), F.count(lit(1)).alias("published")).withColumn("min_rows", F.when(c("table") == "view", lit(10 ** 12)).otherwise(lit(1)).cast("long"))


@query("D05_publish_guard", """SELECT kind AS "table", count(*) FILTER (dn < 19738) AS rows, count(*) AS published, CASE WHEN kind = 'view' THEN 'skip_minimum' WHEN count(*) FILTER (dn < 19738)/count(*) < 5e-1 THEN 'skip_regression' ELSE 'publish' END AS decision FROM station_obs GROUP BY 1""")
def d05(v):
    return ql.publish_guard(published(v)).drop("min_rows")


@query("D06_manifest_guard", """SELECT kind AS "table", count(*) AS expected, count(*) FILTER (dn < 19750) AS rows, CAST(count(*) FILTER (dn < 19750) >= count(*)*95e-2 AS INT) AS ok FROM station_obs GROUP BY 1""")
def d06(v):
    o = v.station_obs
    n = lambda d: d.groupBy(c("kind").alias("table")).agg(F.count(lit(1)).alias("rows"))
    return ql.manifest_check(n(o.where("dn < 19750")), n(o))


@query("D07_row_manifest", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("orders", "lineitem", "events", "supplier")))
def d07(v):
    out = None
    for t in ("orders", "lineitem", "events", "supplier"):
        d = v.table(t).agg(F.count(lit(1)).alias("rows")).select(lit(t).alias("table"), "rows")
        out = d if out is None else out.unionByName(d)
    return out


@query("D08_future_rows", f"SELECT count(*) AS n, count(*) FILTER (t > {NOW}) AS n_future, max(t) FILTER (t <= {NOW}) AS last_valid FROM quakes")
def d08(v):
    return v.quakes.agg(F.count(lit(1)).alias("n"), F.count_if(c("t") > NOW).alias("n_future"), F.max(F.when(c("t") <= NOW, c("t"))).alias("last_valid"))


# ---- binary files ---------------------------------------------------------------------------------------------------

def vector_groups(v, per: int, ending: str):
    """Vectors of `per` consecutive ids as one row, so that a file holds a bounded number of them."""
    rows = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    g = rows.groupBy(F.floor(c("vec_id") / per).alias("part")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "e"))).alias("rows"))
    return g.select(F.format_string(f"part-%d.{ending}", "part").alias("name"), "rows")


def vector_grids(v, cell=lambda x: x):
    """Files of 64 vectors as a grid of 64 rows, read back by the caller from the folder this returns."""
    def grid(row):
        out = np.full((64, max(len(r["e"]) for r in row["rows"])), np.nan)
        for r in row["rows"]:
            out[r["vec_id"] % 64, :len(r["e"])] = cell(np.array(r["e"]))
        return bi.npy_bytes(out)
    root = sk.scratch(v.spark, "grids")
    bi.write_files(vector_groups(v, 64, "npy"), root, grid)
    return root


def part_number():
    return F.regexp_extract("path", r"part-(-?\d+)", 1).cast("long").alias("part")


@query("S21_binary_grids", """SELECT vec_id//64 AS part, CAST(vec_id % 64 AS DOUBLE) AS lat, CAST(i AS DOUBLE) AS lon, round(x, 6) AS value
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""")
def s21(v):
    return bi.decode_grid(v.spark, vector_grids(v)).select(part_number(), "lat", "lon", R(c("value")).alias("value"))


@query("S21b_scaled_box", """SELECT vec_id//64 AS part, 20 + (vec_id % 64)/4e0 AS lat, 120 + i/2e0 AS lon, 0.0 + round(x*5e-1 + 1, 6) AS value
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE x >= 0 AND 20 + (vec_id % 64)/4e0 BETWEEN 22 AND 33 AND 120 + i/2e0 BETWEEN 1215e-1 AND 148""")
def s21b(v):
    """Packed grids with a fill value, decoded in a box; negative cells are stored as fill."""
    root = vector_grids(v, lambda x: np.where(x < 0, -9999.0, x))
    cells = bi.decode_grid(v.spark, root, lat0=20.0, lon0=120.0, dlat=0.25, dlon=0.5, fill=-9999.0, scale=0.5, offset=1.0, bbox=(22.0, 33.0, 121.5, 148.0))
    return cells.select(part_number(), "lat", "lon", R(c("value")).alias("value"))


@query("S22_sample_files", """WITH s AS (SELECT vec_id//16 AS part, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT part, count(*) AS n, round(sum(x), 4) AS total, round(max(x), 6) AS high, 2e1 AS fs FROM s GROUP BY 1""")
def s22(v):
    root = sk.scratch(v.spark, "samples")
    bi.write_files(vector_groups(v, 16, "sac"), root, lambda row: bi.sac_bytes(np.concatenate([r["e"] for r in row["rows"]]), 20.0, 36.0, 140.0))
    w = bi.read_waveforms(v.spark, root)
    total = F.aggregate("samples", lit(0.0), lambda a, x: a + x)
    return w.select(F.regexp_extract("path", r"part-(-?\d+)", 1).cast("long").alias("part"), F.size("samples").cast("long").alias("n"), R(total, 4).alias("total"),
                    R(F.array_max("samples")).alias("high"), R(c("fs"), 3).alias("fs"))


# ---- spectral jobs --------------------------------------------------------------------------------------------------

def channel(samples, i, n=3):
    """One of n equally long parts that cover all samples; where n does not divide their number the last parts overlap by a sample or two."""
    size = F.ceil(F.size(samples) / n).cast("int")
    start = F.greatest(F.least(size * i, F.size(samples) - size), lit(0))
    return F.transform(F.slice(samples, start + 1, size), lambda x: x.cast("double"))


def long_records(v, per: int = 96):
    """Vectors of `per` consecutive ids, end to end, cut into three channels: records long enough for every band."""
    parts = v.table("embeddings").select("vec_id", F.floor(c("vec_id") / per).alias("rec"), "embedding")
    joined = parts.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("s")).select("rec", F.flatten(c("s.embedding")).alias("all"))
    return joined.select("rec", *[channel("all", i).alias(k) for i, k in enumerate("zxy")])


@query("A61_waveform_features")
def a61(v):
    f = sp.waveform_features(20.0, 100.0)
    r = long_records(v).select("rec", f("z", "x", "y").alias("f")).select("rec", "f.*")
    return r.select("rec", *[R(c(x)).alias(x) for x in r.columns[1:]])


@query("A62_ulf_features")
def a62(v):
    w = v.table("embeddings").select("vec_id", channel("embedding", 0, 2).alias("z"), channel("embedding", 1, 2).alias("h"))
    r = w.select("vec_id", sp.ulf_features()("z", "h").alias("f")).select("vec_id", "f.*")
    return r.select("vec_id", *[R(c(x)).alias(x) for x in r.columns[1:]])


_EPOCHS = """o AS (SELECT station % 10 AS station, t, flag AS z, value AS h FROM station_obs WHERE flag IS NOT NULL AND value IS NOT NULL AND (t % 86400)//3600 BETWEEN 15 AND 21),
  site AS (SELECT sid % 10 AS station, arg_min(slat, sid) AS slat, arg_min(slon, sid) AS slon FROM stations GROUP BY 1), span AS (SELECT min(t) AS t0, max(t) - min(t) + 1 AS len FROM station_obs),
  ev AS (SELECT event_id, station, t0 + t % len AS ev_t FROM quakes, site, span WHERE mag >= 45e-1 AND sqrt(pow((lat-slat)*11132e-2,2)+pow((lon-slon)*11132e-2*cos(radians(lat)),2)) <= 300),
  m AS (SELECT event_id, station, CASE WHEN t < ev_t THEN 'pre' ELSE 'post' END AS side, t, z::DOUBLE AS z, h FROM ev JOIN o USING (station) WHERE t BETWEEN ev_t - 604800 AND ev_t + 604800 AND t <> ev_t),
  r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_id, station, side) AS n FROM m WINDOW w AS (PARTITION BY event_id, station, side ORDER BY t, z, h)),
  p AS (SELECT *, z - avg(z) OVER s AS zc, h - avg(h) OVER s AS hc, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS pad FROM r WINDOW s AS (PARTITION BY event_id, station, side)),
  k AS (SELECT unnest(range(0, (SELECT max(pad)//2 FROM p))) AS k), dft AS (SELECT event_id, station, side, k, any_value(pad) AS pad, sum(zc*cos(2*pi()*(k*i % pad)/pad)) AS zr, sum(zc*sin(2*pi()*(k*i % pad)/pad)) AS zi, sum(hc*cos(2*pi()*(k*i % pad)/pad)) AS hr, sum(hc*sin(2*pi()*(k*i % pad)/pad)) AS hi
    FROM p, k WHERE k < pad/2 AND k/pad/60 BETWEEN 1e-3 AND 1e-1 GROUP BY 1, 2, 3, 4),
  pw AS (SELECT event_id, station, side, avg(zr*zr + zi*zi)/any_value(pad) AS pz, avg(hr*hr + hi*hi)/any_value(pad) AS ph FROM dft GROUP BY 1, 2, 3),
  f AS (SELECT event_id, station, side, i, z, n FROM r), st AS (SELECT unnest(range(1, 11)) AS k),
  ju AS (SELECT a.event_id, a.station, a.side, k, a.i % k AS o, any_value(a.n) AS n, sum(abs(b.z - a.z)) AS s FROM f a, st JOIN f b ON b.event_id = a.event_id AND b.station = a.station AND b.side = a.side AND b.i = a.i + k GROUP BY 1, 2, 3, 4, 5),
  le AS (SELECT event_id, station, side, k, avg(s/((n - 1 - o)//k))*any_value(n - 1)/(k*k) AS l FROM ju GROUP BY 1, 2, 3, 4 HAVING any_value(n) >= 40),
  fd AS (SELECT event_id, station, side, CASE WHEN count(*) >= 3 THEN regr_slope(ln(l), -ln(k)) END AS fd FROM le WHERE l > 0 GROUP BY 1, 2, 3),
  cn AS (SELECT event_id, station, side, count(*) AS n FROM m GROUP BY 1, 2, 3), a AS (SELECT event_id, station, side, n, pz, CASE WHEN ph >= 1e-10 THEN pz/ph END AS pol, fd FROM cn LEFT JOIN pw USING (event_id, station, side) LEFT JOIN fd USING (event_id, station, side)),
  es AS (SELECT e.event_id, e.station, e.n AS n_pre, l.n AS n_post, e.pz AS pre_power_z, l.pz AS post_power_z, e.pol AS pre_polarization, l.pol AS post_polarization, e.fd AS pre_fractal_dim, l.fd AS post_fractal_dim, CASE WHEN l.pz > 0 THEN e.pz/l.pz END AS power_ratio
    FROM a e JOIN a l ON e.event_id = l.event_id AND e.station = l.station AND e.side = 'pre' AND l.side = 'post' WHERE e.n >= 30 AND l.n >= 30)"""
_EPOCH_VALUES = ["pre_power_z", "post_power_z", "pre_polarization", "post_polarization", "pre_fractal_dim", "post_fractal_dim", "power_ratio"]
_SUMMARY_VALUES = ["mean_ratio", "share_15", "share_20", "pre_polarization", "post_polarization", "pre_fractal_dim", "post_fractal_dim"]


def epochs(v):
    """Ten sites with the observations as two components; events are moved into the time of the observations. Sides are taken whole."""
    samples = v.station_obs.select((c("station") % 10).alias("station"), "t", c("flag").alias("z"), c("value").alias("h"))
    sites = v.stations.groupBy((c("sid") % 10).alias("station")).agg(F.min_by("slat", "sid").alias("slat"), F.min_by("slon", "sid").alias("slon"))
    first, length = v.station_obs.select(F.min("t")).scalar(), v.station_obs.select(F.max("t") - F.min("t") + 1).scalar()
    events = v.quakes.where("mag >= 4.5").select("event_id", "lat", "lon", (first + c("t") % length).alias("t"))
    return ep.epoch_spectra(jn.within_km(events, sites, 300.0), ep.night_days(samples), first=None)


@query("A62b_epoch_spectra", f"WITH {_EPOCHS} SELECT event_id, station, n_pre, n_post, {', '.join(f'round({x}, 5) AS {x}' for x in _EPOCH_VALUES)} FROM es")
def a62b(v):
    return epochs(v).select("event_id", "station", "n_pre", "n_post", *[R(c(x), 5).alias(x) for x in _EPOCH_VALUES])


@query("A62c_epoch_summary", f"""WITH {_EPOCHS} SELECT station, count(*) AS n_pairs, {', '.join(f'round({x}, 5) AS {n}' for n, x in zip(_SUMMARY_VALUES, ['avg(power_ratio)', 'avg(CAST(power_ratio > 1.5 AS INT))', 'avg(CAST(power_ratio > 2 AS INT))']
  + [f'avg({x})' for x in _SUMMARY_VALUES[3:]]))} FROM es GROUP BY 1""")
def a62c(v):
    return ep.summary(epochs(v), ["station"]).select("station", "n_pairs", *[R(c(x), 5).alias(x) for x in _SUMMARY_VALUES])


@query("A65_rms_envelope", """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding)//8 AS nb FROM embeddings) SELECT vec_id, CAST(i//8 AS INT) AS bin, round(sqrt(sum(CAST(x AS DOUBLE)*x)/8e0), 6) AS rms FROM e WHERE i//8 < nb GROUP BY 1, 2""")
def a65(v):
    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return e.select("vec_id", F.posexplode(sp.rms_envelope(c("s"), 8)).alias("bin", "r")).select("vec_id", "bin", R(c("r")).alias("rms"))


@query("A65b_log_spectrum")
def a65b(v):
    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return e.select("vec_id", F.posexplode(sp.log_spectrum(100.0)("s")).alias("i", "a")).select("vec_id", "i", R(c("a"), 8).alias("amplitude"))
