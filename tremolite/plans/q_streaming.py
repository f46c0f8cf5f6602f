"""Streaming queries over the driver files, drained with availableNow and read back (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bucketed as bk, sinks as sk
from ..streaming import in_order as so, ingest as si
from .q_basic import R
from .registry import query
from .views import _DEFS

c, lit = F.col, F.lit


def stream_view(v, name, extra=()):
    """A view of the registry on top of the file stream of its table."""
    table, cols = _DEFS[name]
    return si.landed(v.spark, v.sf_dir, table).selectExpr(*[f"{s} AS {n}" for n, s, _ in cols], *extra)


EVENT_TS = "cast(ts as timestamp) AS ts"


def dealt(rows, by, n=3):
    """The rows dealt to n batches by a hash: each batch holds rows of all times."""
    return [rows.where(F.pmod(F.xxhash64(by), lit(n)) == i) for i in range(n)]


@query("R01_stream_dedup", "SELECT DISTINCT station, h FROM station_obs")
def r01(v):
    s = stream_view(v, "station_obs", [EVENT_TS])
    _, out = si.run_available(si.dedup(s, ["station", "h"], "ts", "60 days").select("station", "h"), name="dedup")
    return v.spark.read.parquet(out).drop("_batch")


@query("R02_stream_hourly", "SELECT h*3600 AS bucket, name, count(*) AS n, round(avg(value), 6) AS mean_value FROM series GROUP BY 1, 2")
def r02(v):
    s = stream_view(v, "series", [EVENT_TS])
    _, out = si.run_available(si.tumbling(s, ["name"], "ts", "1 hour", "value", "60 days"), "update", "hourly")
    return si.latest_rows(v.spark, out, ["bucket", "name"]).withColumn("mean_value", R(c("mean_value")))


@query("R03_stream_sliding_b", """WITH s AS (SELECT dn - k AS d0, mag FROM quakes, range(30) r(k)), g AS (SELECT d0*86400 AS start, count(*) AS n, avg(mag) AS m, min(mag) AS lo FROM s GROUP BY 1)
  SELECT start, n, round(CASE WHEN n >= 10 AND m - lo > 1e-2 THEN log10(exp(1))/(m-lo) END, 6) AS b_value FROM g""")
def r03(v):
    s = stream_view(v, "quakes").withColumn("ts", F.timestamp_seconds("t"))
    _, out = si.run_available(si.sliding_b(s, "ts", "mag", "30 days", "1 day", "4000 days"), "update", "slidingb")
    return si.latest_rows(v.spark, out, ["start"]).withColumn("b_value", R(c("b_value")))


@query("R04_stream_sessions", """WITH a AS (SELECT station, t_us, value, CASE WHEN t_us - lag(t_us) OVER w > 3600000000 THEN 1 ELSE 0 END AS f, id FROM station_obs WINDOW w AS (PARTITION BY station ORDER BY t_us, id)), b AS (SELECT *, sum(f) OVER (PARTITION BY station ORDER BY t_us, id) AS s FROM a)
  SELECT station, min(t_us) AS t_start, max(t_us) AS t_end, count(*) AS n, round(avg(value), 6) AS mean_value FROM b GROUP BY station, s""")
def r04(v):
    s = stream_view(v, "station_obs", [EVENT_TS])
    # complete mode also shows the sessions that are still open when the files end
    _, out = si.run_available(si.sessions(s, "station", "ts", "3600 seconds 1 microsecond", "value", "60 days"), "complete", "sessions")
    return si.latest_rows(v.spark, out, ["station", "t_start"]).withColumn("mean_value", R(c("mean_value")))


@query("R05_stream_rolling_alarms", """WITH a AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY name ORDER BY t_us, id ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING))
  SELECT name, id, 0.0 + round((value-m)/s, 4) AS sigma FROM a WHERE n >= 6 AND s >= 1e-10 AND abs((value-m)/s) >= 2""")
def r05(v):
    rows = v.series.select("name", "id", F.timestamp_micros("t_us").alias("ts"), "value")
    root = so.land_batches(v.spark, dealt(rows, "id"), "ts", 60, "series")
    out = so.drained(v.spark, root, lambda s: so.rolling_alarms(s, "name", "ts", "id", "value", "60 days"), "alarms")
    return out.select("name", "id", R(c("sigma"), 4).alias("sigma"))


@query("R06_stream_upsert", "SELECT station, arg_max(value, (t_us, id)) AS level FROM station_obs GROUP BY 1")
def r06(v):
    """Three batches, each with rows of all times: a row older than the one the table holds does not replace it."""
    spark, root = v.spark, sk.scratch(v.spark, "obs")
    rows = v.station_obs.select("station", c("value").alias("level"), "t_us", "id")
    for part in dealt(rows, "id"):
        part.coalesce(1).write.mode("append").parquet(f"{root}/rows.parquet")
    table = bk.BucketedTable(spark, sk.scratch(spark, "levels"), rows.schema, ["station"], ["t_us", "id"], buckets=16)
    s = si.landed(spark, root, "rows", files_per_batch=1)
    s.writeStream.option("checkpointLocation", sk.scratch(spark, "levels-state")).trigger(availableNow=True).foreachBatch(table.merge).start().awaitTermination()
    return table.read().select("station", "level")


@query("R07_stream_health", "SELECT count(*) AS rows_in, CAST(0 AS BIGINT) AS late_rows FROM station_obs")
def r07(v):
    s = stream_view(v, "station_obs", [EVENT_TS])
    q, _ = si.run_available(si.dedup(s, ["station", "h"], "ts", "60 days").select("station", "h"), name="health")
    status = v.spark.createDataFrame(si.health(q), "batch long, rows long, late_rows long, ms long")  # a row per batch
    return status.agg(F.sum("rows").alias("rows_in"), F.sum("late_rows").alias("late_rows"))


@query("R08_stream_late_rows", """WITH h AS (SELECT min(t_us) + (max(t_us) - min(t_us)) // 2 AS cut FROM station_obs), m AS (SELECT cut, max(t_us) FILTER (t_us >= cut AND id % 2 = 0) AS top FROM station_obs, h GROUP BY cut)
  SELECT count(*) AS rows_in, count(*) FILTER (t_us < cut AND t_us < top - 864000000000) AS late_rows FROM station_obs, m""")
def r08(v):
    """The newer half arrives in two batches, the older half in a third: its rows beyond the horizon are dropped and counted.
    A batch is judged by the watermark that the batch before it started with, so the first one sets the mark."""
    obs, root = v.station_obs, sk.scratch(v.spark, "late")
    low, top = obs.agg(F.min("t_us"), F.max("t_us")).first()
    cut, parts = low + (top - low) // 2, 4
    rows = obs.select("id", F.timestamp_micros("t_us").alias("ts"), "t_us")
    new = c("t_us") >= cut
    for part in (rows.where(new & (c("id") % 2 == 0)), rows.where(new & (c("id") % 2 == 1)), rows.where(~new)):
        part.repartition(parts).write.mode("append").parquet(f"{root}/obs.parquet")
    s = si.landed(v.spark, root, "obs", files_per_batch=parts)
    q, _ = si.run_available(si.dedup(s, ["id"], "ts", "10 days").select("id"), name="late")
    status = v.spark.createDataFrame(si.health(q), "batch long, rows long, late_rows long, ms long")
    return status.agg(F.sum("rows").alias("rows_in"), F.sum("late_rows").alias("late_rows"))


@query("R09_stream_static_enrichment", "SELECT network, count(*) AS n, round(avg(value), 6) AS mean_value FROM station_obs LEFT JOIN stations ON station = sid GROUP BY 1")
def r09(v):
    s = stream_view(v, "station_obs").select("station", "value")
    _, out = si.run_available(si.enrich(s, v.stations.select(c("sid").alias("station"), "network"), ["station"]), name="enrich")
    return v.spark.read.parquet(out).groupBy("network").agg(F.count(lit(1)).alias("n"), R(F.avg("value")).alias("mean_value"))


@query("R10_stream_interval_match", "SELECT a.id AS a_id, b.id AS b_id FROM station_obs a JOIN station_obs b ON a.station = b.station AND b.t_us >= a.t_us AND b.t_us <= a.t_us + 21600000000 WHERE a.kind = 'error' AND b.kind = 'purchase'")
def r10(v):
    s = lambda k, p: stream_view(v, "station_obs", [EVENT_TS]).where(c("kind") == k).select("station", c("id").alias(f"{p}_id"), c("ts").alias(f"{p}_ts"))
    _, out = si.run_available(si.follow_up(s("error", "a"), s("purchase", "b"), "station", 6, "60 days").select("a_id", "b_id"), name="match")
    return v.spark.read.parquet(out).drop("_batch")


@query("R11_stream_cycle_counts", """WITH r AS (SELECT ci, cj, event_id, mag, sum(CASE WHEN mag >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY ci, cj ORDER BY t, event_id) - CASE WHEN mag >= 5 THEN 1 ELSE 0 END AS cyc FROM quakes)
  SELECT ci, cj, max(CASE WHEN mag >= 5 THEN event_id END) AS event_id, count(*) FILTER (mag < 5) AS since_last FROM r GROUP BY ci, cj, cyc HAVING count(*) FILTER (mag >= 5) > 0""")
def r11(v):
    rows = v.quakes.select("ci", "cj", "event_id", F.timestamp_seconds("t").alias("ts"), "mag")
    root = so.land_batches(v.spark, dealt(rows, "event_id"), "ts", 4000, "quakes")
    return so.drained(v.spark, root, lambda s: so.counts_since_large(s, ["ci", "cj"], "ts", "event_id", "mag", "4000 days"), "cycles")
