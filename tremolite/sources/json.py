"""JSON feeds. Parsers take a DataFrame with the JSON text in `value` and an explicit schema, so nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c, lit = F.col, F.lit

# Seismic intensity labels and their numeric scale.
INTENSITY_SCALE = {"1": 10, "2": 20, "3": 30, "4": 40, "5-": 45, "5+": 50, "6-": 55, "6+": 60, "7": 70}
ALLOWED_SENSORS = ("rad", "enc", "pwl", "bub", "flt", "aqu", "ras", "wls", "bwl")


def parse_geojson_events(docs: DataFrame, source: str = "geojson") -> DataFrame:
    """Feature collections to events; features without an id or three coordinates are skipped, time is epoch ms."""
    schema = "features ARRAY<STRUCT<properties: STRUCT<code: STRING, time: BIGINT, mag: DOUBLE, magType: STRING, place: STRING>, geometry: STRUCT<coordinates: ARRAY<DOUBLE>>>>"
    d = docs.select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    d = d.where((F.size("f.geometry.coordinates") >= 3) & (F.length("f.properties.code") > 0))
    x = c("f.geometry.coordinates")
    return d.select(lit(source).alias("source"), c("f.properties.code").alias("event_id"), F.timestamp_millis("f.properties.time").alias("ts"), x[1].alias("lat"), x[0].alias("lon"), x[2].alias("depth_km"),
                    c("f.properties.mag").alias("mag"), c("f.properties.magType").alias("mag_type"), c("f.properties.place").alias("place"))


def parse_local_quakes(docs: DataFrame, offset: str = "+09:00") -> DataFrame:
    """Array of reports with local time text; the offset is applied, positions of 0 or NULL are skipped."""
    schema = "ARRAY<STRUCT<id: STRING, time: STRING, earthquake: STRUCT<maxScale: INT, hypocenter: STRUCT<name: STRING, latitude: DOUBLE, longitude: DOUBLE, depth: DOUBLE, magnitude: DOUBLE>>>>"
    d = docs.select(F.explode(F.from_json("value", schema)).alias("r")).select("r.*", "r.earthquake.*")
    d = d.where("hypocenter.latitude <> 0 AND hypocenter.longitude <> 0").withColumn("event_id", F.coalesce("id", "time")).where(F.length("event_id") > 0)
    ts = F.expr(f"try_to_timestamp(concat(time, '{offset}'), 'yyyy/MM/dd HH:mm:ssXXX')")
    return d.select("event_id", ts.alias("ts"), c("hypocenter.latitude").alias("lat"), c("hypocenter.longitude").alias("lon"), c("hypocenter.depth").alias("depth_km"), c("hypocenter.magnitude").alias("mag"), "maxScale", c("hypocenter.name").alias("place"))


def packed_position(cod):
    """(lat, lon, depth_km) columns of `+35.9+137.6-10000/`; NULL when the text does not match."""
    pat = r"^([+-][\d.]+)([+-][\d.]+)([+-][\d.]+)/"
    part = lambda i: F.nullif(F.regexp_extract(cod, pat, i), lit("")).cast("double")
    return part(1), part(2), F.abs(part(3)) / 1000


def parse_bulletins(docs: DataFrame) -> DataFrame:
    schema = "ARRAY<STRUCT<eid: STRING, at: STRING, cod: STRING, maxi: STRING, mag: STRING, anm: STRING, en_anm: STRING>>"
    d = docs.select(F.explode(F.from_json("value", schema)).alias("r")).select("r.*").where(F.length("eid") > 0)
    lat, lon, depth = packed_position(c("cod"))
    pairs = [lit(x) for kv in INTENSITY_SCALE.items() for x in kv]
    return d.select(c("eid").alias("event_id"), F.expr("try_to_timestamp(at)").alias("ts"), lat.alias("lat"), lon.alias("lon"), depth.alias("depth_km"), F.expr("try_cast(mag AS DOUBLE)").alias("mag"),
                    F.try_element_at(F.create_map(*pairs), c("maxi")).alias("max_intensity"), "anm", "en_anm").where("lat IS NOT NULL AND lon IS NOT NULL")


def parse_station_snapshot(docs: DataFrame, stations: DataFrame) -> DataFrame:
    """{station: {metric: [value, flag]}} joined with the station table ([deg, min] positions)."""
    d = docs.select(*[x for x in docs.columns if x != "value"], F.explode(F.from_json("value", "MAP<STRING, MAP<STRING, ARRAY<DOUBLE>>>")).alias("station", "m"))
    meta = stations.select(F.explode(F.from_json("value", "MAP<STRING, STRUCT<kjName: STRING, lat: ARRAY<DOUBLE>, lon: ARRAY<DOUBLE>>>")).alias("station", "s"))
    meta = meta.select("station", c("s.kjName").alias("station_name"), (c("s.lat")[0] + c("s.lat")[1] / 60).alias("lat"), (c("s.lon")[0] + c("s.lon")[1] / 60).alias("lon"))
    val = lambda k: F.try_element_at(F.try_element_at(c("m"), lit(k)), lit(1)).alias(k)
    return d.join(meta, "station").select(*[x for x in docs.columns if x != "value"], "station", "station_name", "lat", "lon", *[val(k) for k in ("pressure", "temp", "humidity", "wind", "windDirection", "precipitation1h")])


def parse_header_rows(docs: DataFrame) -> DataFrame:
    """[[header…], [time, kp, a, n], …]: the first row is skipped, bad numbers are NULL."""
    d = docs.select(F.explode(F.expr("slice(a, 2, size(a))")).alias("r")) if "a" in docs.columns else docs.select(F.from_json("value", "ARRAY<ARRAY<STRING>>").alias("a")).select(F.explode(F.expr("slice(a, 2, size(a))")).alias("r"))
    g = lambda i, t: F.expr(f"try_cast(nullif(r[{i}], '') AS {t})")
    return d.where("size(r) >= 4").select(c("r")[0].alias("time_tag"), g(1, "DOUBLE").alias("kp"), g(2, "DOUBLE").alias("a_running"), g(3, "INT").alias("station_count"))


def parse_columnar_table(docs: DataFrame, value: str = "analysed_sst") -> DataFrame:
    """{table: {columnNames, rows}}: positions are looked up by name, NULL values (land) are skipped."""
    t = F.from_json("value", "table STRUCT<columnNames: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>>")["table"]
    d = docs.select(t["columnNames"].alias("n"), F.explode(t["rows"]).alias("r"))
    at = lambda name: F.try_element_at("r", F.nullif(F.array_position("n", lit(name)), lit(0)).cast("int"))
    return d.select(at("time").alias("observed_at"), at("latitude").cast("double").alias("lat"), at("longitude").cast("double").alias("lon"), at(value).cast("double").alias("value")).where("value IS NOT NULL")


def parse_sensor_records(docs: DataFrame, allowed=ALLOWED_SENSORS, deny=()) -> DataFrame:
    """[{stime, slevel, sensor}] with an allow-list per record; a record without a sensor passes, bad numbers drop out."""
    d = docs.select(*[x for x in docs.columns if x != "value"], F.explode(F.from_json("value", "ARRAY<STRUCT<stime: STRING, slevel: STRING, sensor: STRING>>")).alias("r"))
    s = F.lower(F.trim("r.sensor"))
    ok = s.isNull() | (s == "") | (s.isin(*allowed) if allowed else ~s.isin(*deny))
    d = d.where(ok).select(*[x for x in docs.columns if x != "value"], F.replace(F.trim("r.stime"), lit(" "), lit("T")).alias("observed_at"), F.expr("try_cast(r.slevel AS DOUBLE)").alias("sea_level_m"))
    return d.where("length(observed_at) > 0 AND sea_level_m IS NOT NULL")


def parse_station_list(docs: DataFrame, box=(20.0, 50.0, 120.0, 155.0), allowed=ALLOWED_SENSORS, cap: int | None = None) -> DataFrame:
    """Stations inside the box with an allowed sensor; the cap (a top-k) comes after both filters."""
    schema = "ARRAY<STRUCT<Code: STRING, Location: STRING, Lat: STRING, Lon: STRING, sensor: STRING>>"
    d = docs.select(F.explode(F.from_json("value", schema)).alias("r")).select(F.trim("r.Code").alias("code"), F.coalesce(F.nullif(F.trim("r.Location"), lit("")), F.trim("r.Code")).alias("name"),
        F.expr("try_cast(r.Lat AS DOUBLE)").alias("lat"), F.expr("try_cast(r.Lon AS DOUBLE)").alias("lon"), F.lower(F.trim("r.sensor")).alias("sensor"))
    la0, la1, lo0, lo1 = box
    d = d.where(c("lat").between(la0, la1) & c("lon").between(lo0, lo1) & c("sensor").isin(*allowed) & (F.length("code") > 0))
    return d.orderBy("code").limit(cap) if cap else d


def parse_electron_flux(docs: DataFrame) -> DataFrame:
    """[{time_tag, energy, flux}] to the daily maximum per energy label; negative flux is missing."""
    d = docs.select(F.explode(F.from_json("value", "ARRAY<STRUCT<time_tag: STRING, energy: STRING, flux: DOUBLE>>")).alias("r")).select("r.*").where("flux >= 0 AND length(time_tag) >= 10")
    e = F.replace("energy", lit(" "), lit(""))
    g = d.groupBy(F.substring("time_tag", 1, 10).alias("date")).agg(F.max(F.when(F.contains(e, lit(">=2MeV")), c("flux"))).alias("electron_2mev_max"), F.max(F.when(F.contains(e, lit(">=800")), c("flux"))).alias("electron_800kev_max"))
    return g.where("electron_2mev_max IS NOT NULL")


def parse_land_temperature(docs: DataFrame) -> DataFrame:
    """Subset JSON: temperature bands only, fill values out, 0.02 K scale, 200-350 K."""
    d = docs.select(F.explode(F.from_json("value", "subset ARRAY<STRUCT<band: STRING, calendar_date: STRING, data: ARRAY<DOUBLE>>>")["subset"]).alias("s"))
    d = d.where(F.contains(F.lower("s.band"), lit("lst")) & (F.length("s.calendar_date") > 0)).select(c("s.calendar_date").alias("date"), c("s.band").alias("band"), F.explode("s.data").alias("raw"))
    return d.where("raw > 0 AND raw < 65535").withColumn("lst_k", c("raw") * lit(0.02)).where("lst_k > 200 AND lst_k < 350").select("date", "band", "lst_k")


def parse_parallel_arrays(docs: DataFrame, time: str = "datetime", value: str = "Kp") -> DataFrame:
    d = docs.select(F.from_json("value", f"`{time}` ARRAY<STRING>, `{value}` ARRAY<DOUBLE>").alias("j"))
    return d.select(F.explode(F.arrays_zip(c("j")[time].alias("t"), c("j")[value].alias("v"))).alias("z")).select(F.expr("try_to_timestamp(z.t)").alias("time_tag"), c("z.v").alias("kp")).where("time_tag IS NOT NULL AND kp IS NOT NULL")


def parse_flares(docs: DataFrame) -> DataFrame:
    d = docs.select(F.explode(F.from_json("value", "ARRAY<STRUCT<begin_time: STRING, max_time: STRING, end_time: STRING, max_class: STRING, max_xrlong: DOUBLE>>")).alias("r")).select("r.*")
    return d.where("length(max_time) > 0").withColumn("ts", F.expr("try_to_timestamp(max_time)"))


def parse_feature_tensor(docs: DataFrame) -> DataFrame:
    """{tensor: T x H x W x C} to one row per (t, i, j) with the feature vector."""
    d = docs.select(F.from_json("value", "tensor ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")["tensor"].alias("x"))
    d = d.select(F.posexplode("x").alias("t", "x")).select("t", F.posexplode("x").alias("i", "x"))
    return d.select("t", "i", F.posexplode("x").alias("j", "features"))


def parse_predictions(docs: DataFrame) -> DataFrame:
    """{predictions: [{cell_lat, cell_lon, t_days, prob, label}]} to rows."""
    return docs.select(F.explode(F.from_json("value", "predictions ARRAY<STRUCT<cell_lat: DOUBLE, cell_lon: DOUBLE, t_days: DOUBLE, prob: DOUBLE, label: INT>>")["predictions"]).alias("r")).select("r.*")
