"""More landing queries: block documents, CSV files and lists, built from whole driver tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks as sk
from ..sources import json as sj, text as st
from .q_basic import R
from .q_landing import text
from .registry import query

c, lit = F.col, F.lit


@query("S08_ionosphere_maps", """WITH o AS (SELECT 20 + (id % 7)*5e0 AS lat, flag FROM station_obs), r AS (SELECT lat, -180 + j*5e0 AS lon, flag + j AS v FROM o, range(73) g(j))
  SELECT lat, lon, count(*) AS n, round(max(v)*1e-1, 6) AS tec_max FROM r WHERE lon BETWEEN 120 AND 155 GROUP BY 1, 2""")
def s08(v):
    # the source is one small file here: spread it before the documents are made
    o = v.station_obs.repartition(2 * v.spark.sparkContext.defaultParallelism)
    # the 73 values are a column of their own: inside a function over the lines they would be formatted once per line
    o = o.withColumn("vals", F.transform(F.sequence(lit(0), lit(72)), lambda j: F.lpad((c("flag") + j).cast("string"), 5, " ")))
    rows = F.array_join(F.array(*[F.array_join(F.slice("vals", i * 16 + 1, 16), "") for i in range(5)]), "\n")
    band = F.concat(F.format_string("%8.1f", lit(20.0) + (c("id") % 7) * 5), lit("-180.0 180.0   5.0 450.0".ljust(52)), lit("LAT/LON1/LON2/DLON/H\n"), rows, lit("\n"))
    doc = F.concat(lit("    -1".ljust(60) + "EXPONENT\n" + " " * 60 + "END OF HEADER\n     1".ljust(60) + "START OF TEC MAP\n"), lit("  2024     1     1     2     0     0".ljust(60) + "EPOCH OF CURRENT MAP\n"), band, lit("     1".ljust(60) + "END OF TEC MAP\n"))
    return st.parse_ionosphere_maps(text(o, doc)).groupBy("lat", "lon").agg(F.count(lit(1)).alias("n"), R(F.max("tec")).alias("tec_max"))


@query("S09_position_documents", "SELECT CAST(station AS VARCHAR) AS station_id, CAST(d AS VARCHAR)[1:10] AS date, qty AS height FROM daily_obs")
def s09(v):
    line = F.concat_ws(" ", F.date_format("d", " yyyy MM dd"), lit("12:00:00 1.0 2.0 3.0 35.5 139.5"), c("qty"))
    doc = F.concat(lit("+SITE\n ID          "), c("station").cast("string"), lit("\n J_NAME      x\n-SITE\n+DATA\n*head\n"), line, lit("\n-DATA\n 2024 01 01 0 0 0 0 0 0 0\n"))
    return st.parse_position_document(text(v.daily_obs, doc)).select("station_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "height")


@query("S10_moment_tensors", "SELECT CAST(event_id AS VARCHAR) AS event_id, round(lat, 2) AS lat, round(lon, 2) AS lon, depth_km, CAST(event_id % 360 AS DOUBLE) AS strike1 FROM quakes WHERE event_id % 91 <= 90 AND event_id % 100 <= 90")
def s10(v):
    q = v.quakes
    ts = F.date_format(F.timestamp_seconds(c("t") + 504921600), "yyyy/MM/dd HH:mm:ss.0")
    l = [F.concat(lit("PDE "), ts, lit(" 1 2 3 4 5 6 X")), F.concat(c("event_id").cast("string"), lit(" B:1")),
         F.concat(lit("CENTROID: 1.0 0.1 "), F.format_string("%.2f 0.01 %.2f 0.01 %.1f 0.5 FREE S", "lat", "lon", "depth_km")), lit("25 1 2 3"),
         F.concat(lit("V10 1 2 3 4 5 6 7 8 9 2.0 "), (c("event_id") % 360).cast("string"), lit(" "), (c("event_id") % 100).cast("string"), lit(" 90 10 45 90"))]
    # dips above 90 are not valid and must drop the record
    return st.parse_moment_tensors(text(q, F.concat_ws("\n", *l))).select("event_id", "lat", "lon", "depth_km", "strike1")


@query("S16_sea_level_csv", "SELECT round(glat, 2) AS lat, count(*) AS n, max(round(value, 3)) AS top FROM grid_obs WHERE quality > 0 GROUP BY 1")
def s16(v):
    line = F.concat_ws(",", F.date_format("d", "yyyy-MM-dd'T00:00:00Z'"), F.when(c("quality") > 0, F.round("value", 3)).otherwise(-99999.0), F.round("glat", 2), F.round("glon", 2))
    return st.parse_sea_level_csv(text(v.grid_obs, line)).groupBy("lat").agg(F.count(lit(1)).alias("n"), F.max("sea_level_mm").alias("top"))


@query("S20_array_text", "SELECT 30 + line*25e-2 AS lat, 130 + k*25e-2 AS lon, qty + k AS value, count(*) AS n FROM daily_obs, (SELECT unnest([0, 2]) AS k) GROUP BY 1, 2, 3")
def s20(v):
    doc = F.concat(lit("Dataset: x\nColumnX.ColumnX[1][1][3]\nColumnX[0]["), c("line").cast("string"), lit("], "), c("qty").cast("string"), lit(", -1.2676506e+30, "), (c("qty") + 2).cast("string"), lit("\n"))
    return st.parse_array_text(text(v.daily_obs, doc), "ColumnX", 30.0, 130.0).groupBy("lat", "lon", "value").agg(F.count(lit(1)).alias("n"))


@query("S23_tracking_csv", "SELECT CAST(station AS VARCHAR) AS individual_id, count(*) AS n FROM station_obs WHERE flag <> 0 GROUP BY 1")
def s23(v):
    path = sk.scratch(v.spark, "tracking")
    v.station_obs.select(c("station").cast("string").alias("individual_id"), c("t").cast("string").alias("timestamp"), c("flag").alias("location_lat"), lit(140.5).alias("location_long")).write.option("header", True).csv(path)
    return st.read_tracking_csv(v.spark, path).groupBy("individual_id").agg(F.count(lit(1)).alias("n"))


@query("S25_event_csv", "SELECT t, round(lat, 2) AS lat, mag FROM quakes")
def s25(v):
    path = sk.scratch(v.spark, "eventcsv")
    q = v.quakes.select(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.round("lat", 2).alias("latitude"), F.round("lon", 2).alias("longitude"), lit(1).alias("depth"), "mag")
    q.write.option("header", True).csv(path)
    return st.read_event_csv(v.spark, path).select(F.unix_seconds("ts").alias("t"), "lat", "mag")


@query("S30_study_csv", "SELECT sid AS id, sname AS name FROM stations")
def s30(v):
    path = sk.scratch(v.spark, "studies")
    v.stations.select(c("sid").alias("id"), c("sname").alias("name")).write.option("header", True).csv(path)
    return st.read_study_csv(v.spark, path)


@query("S31_flux_csv", "SELECT strftime(make_timestamp(dn*86400000000), '%Y-%m-%d') AS date, max(round(value, 2)) AS electron_2mev_max FROM station_obs WHERE kind <> 'error' GROUP BY 1")
def s31(v):
    path = sk.scratch(v.spark, "flux")
    v.station_obs.select(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm").alias("time"), F.when(c("kind") == "error", -1.0).otherwise(F.round("value", 2)).alias("E2_flux")).write.option("header", True).csv(path)
    return st.read_flux_csv(v.spark, path)


@query("S32_station_list", "SELECT CAST(sid AS VARCHAR) AS code, round(slat, 2) AS lat FROM stations WHERE network % 3 <> 0 AND slat <= 40")
def s32(v):
    rec = F.struct(c("sid").cast("string").alias("Code"), c("sname").alias("Location"), F.round("slat", 2).cast("string").alias("Lat"), F.round("slon", 2).cast("string").alias("Lon"), F.when(c("network") % 3 == 0, "prt").otherwise("RAD").alias("sensor"))
    return sj.parse_station_list(text(v.stations, F.to_json(F.array(rec))), box=(20.0, 40.0, 120.0, 155.0)).select("code", "lat")


@query("S33_flare_list", "SELECT CASE WHEN value > 100 THEN 'X' ELSE 'C' END AS max_class, count(*) AS n, max(value) AS top FROM station_obs WHERE flag <> 0 GROUP BY 1")
def s33(v):
    at = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = F.struct(at.alias("begin_time"), F.when(c("flag") == 0, "").otherwise(at).alias("max_time"), at.alias("end_time"), F.when(c("value") > 100, "X").otherwise("C").alias("max_class"), c("value").alias("max_xrlong"))
    return sj.parse_flares(text(v.station_obs, F.to_json(F.array(rec)))).groupBy("max_class").agg(F.count(lit(1)).alias("n"), F.max("max_xrlong").alias("top"))
