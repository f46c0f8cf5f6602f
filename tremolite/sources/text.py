"""Whitespace, fixed-width, semicolon and block text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

c, lit = F.col, F.lit


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """`df` with new columns that are evaluated once a row: a generator of one row, below which filters on them are not moved.

    Plain columns are copied into every filter above them, and every reference evaluates them again.
    """
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(name) for name, x in cols.items()]))))


def fields(lines: DataFrame, sep: str = r"\s+", at_least: int = 1, comment: str | None = "#") -> DataFrame:
    """Trimmed lines split into `f`, without comments, blank lines and short lines."""
    d = once(lines, _l=F.trim("value")).where(F.length("_l") > 0)
    if comment:
        d = d.where(~F.startswith("_l", lit(comment)))
    return once(d, f=F.split("_l", sep)).where(F.size("f") >= at_least).drop("_l")


def num(i: int) -> Column:
    return F.expr(f"try_cast(f[{i}] AS DOUBLE)")


def whole(i: int) -> Column:
    return F.expr(f"try_cast(f[{i}] AS INT)")


def _date() -> Column:
    return F.expr("try_to_date(concat_ws('-', f[0], f[1], f[2]), 'y-M-d')")


def missing(x: Column, bad: Column) -> Column:
    """NULL where the sentinel condition holds."""
    return F.when(~bad, x)


def parse_hourly_space_weather(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """Year, day of year, hour and 41 columns; sentinels become NULL, rows after `now` are dropped."""
    d = fields(lines, at_least=41)
    hour = F.expr("make_timestamp(try_cast(f[0] AS INT), 1, 1, 0, 0, 0) + make_dt_interval(try_cast(f[1] AS INT) - 1, try_cast(f[2] AS INT), 0, 0)")
    d = d.where(whole(0).isNotNull() & whole(1).isNotNull() & whole(2).isNotNull()).select(
        hour.alias("observed_at"), missing(num(13), F.abs(num(13)) > 999).alias("bz"), missing(num(23), num(23) > 9000).alias("speed"),
        missing(num(24), num(24) > 900).alias("density"), missing(num(27), num(27) > 90).alias("pressure"), missing(num(40), F.abs(num(40)) > 9000).alias("dst"))
    return d.where(c("observed_at") <= now) if now is not None else d


def parse_proton_flux(lines: DataFrame, limit: float = 99999.0) -> DataFrame:
    """The same hourly layout with proton channels in columns 28 and 30."""
    d = fields(lines, at_least=30).where(whole(0).isNotNull() & whole(1).isNotNull() & whole(2).isNotNull())
    hour = F.expr("make_timestamp(try_cast(f[0] AS INT), 1, 1, 0, 0, 0) + make_dt_interval(try_cast(f[1] AS INT) - 1, try_cast(f[2] AS INT), 0, 0)")
    return d.select(hour.alias("observed_at"), missing(num(27), num(27) > limit).alias("p10"), missing(num(29), num(29) > limit).alias("p60"))


def parse_earth_rotation(lines: DataFrame, first_year: int = 2011) -> DataFrame:
    """Space-separated pole and length-of-day series; length of day goes from seconds to milliseconds."""
    d = fields(lines, at_least=8).where(whole(0) >= first_year)
    d = once(d, date=_date(), x=num(4), y=num(5), dut1=num(6), lod=num(7) * 1000)
    return d.select("date", "x", "y", "dut1", "lod").where("date IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND dut1 IS NOT NULL AND lod IS NOT NULL")


def parse_rotation_bulletin(lines: DataFrame, first_year: int = 2011) -> DataFrame:
    """Fixed-width bulletin: predicted rows dropped, blanks NULL, length of day already in milliseconds."""
    part = lambda a, n: F.expr(f"try_cast(nullif(trim(substring(value, {a + 1}, {n})), '') AS DOUBLE)")
    yy = F.expr("try_cast(trim(substring(value, 1, 2)) AS INT)")
    d = lines.where(F.length("value") >= 80).where(F.trim(F.substring("value", 17, 1)) != "P")
    d = d.withColumn("_y", F.when(yy >= 70, 1900 + yy).otherwise(2000 + yy)).where(c("_y") >= first_year)
    day = F.expr("try_to_date(concat_ws('-', _y, trim(substring(value, 3, 2)), trim(substring(value, 5, 2))), 'y-M-d')")
    return d.select(day.alias("date"), part(18, 9).alias("x"), part(37, 9).alias("y"), part(58, 10).alias("dut1"), part(79, 7).alias("lod")).where("date IS NOT NULL")


def parse_neutron_counts(lines: DataFrame) -> DataFrame:
    """Semicolon series; header, comments and null values are skipped."""
    d = fields(lines, sep=";", at_least=2).where(F.rlike(F.trim(F.element_at("f", 1)), lit(r"^\d{4}-\d{2}-\d{2}")))
    return d.select(F.substring(F.trim(F.element_at("f", 1)), 1, 10).alias("date"), F.expr("try_cast(trim(f[1]) AS DOUBLE)").alias("counts")).where("counts IS NOT NULL")


def parse_wide_kp(lines: DataFrame, first_year: int = 2011, first: int = 7) -> DataFrame:
    """Eight three-hour values per line become eight rows."""
    d = fields(lines, at_least=first + 8).where(whole(0) >= first_year)
    slots = F.transform(F.sequence(lit(0), lit(7)), lambda i: F.struct((i * 3).alias("hour"), F.try_element_at("f", i + first + 1).alias("raw")))
    d = once(d, date=_date()).select("date", F.explode(slots).alias("s"))
    return d.select(F.expr("make_timestamp(year(date), month(date), day(date), s.hour, 0, 0)").alias("time_tag"), F.expr("try_cast(s.raw AS DOUBLE)").alias("kp")).where("kp IS NOT NULL AND time_tag IS NOT NULL")


def parse_observatory_minutes(lines: DataFrame, station: str) -> DataFrame:
    """Date, time, day of year and four components; 99999 and 88888 are missing."""
    d = fields(lines, at_least=7).where(F.rlike(F.element_at("f", 1), lit(r"^\d{4}-\d{2}-\d{2}$")))
    ok = lambda i: missing(num(i), F.abs(num(i)) >= 88888)
    return d.select(lit(station).alias("station"), F.expr("try_to_timestamp(concat(f[0], 'T', substring(f[1], 1, 8)))").alias("observed_at"), ok(3).alias("h"), ok(4).alias("d"), ok(5).alias("z"), ok(6).alias("f_total"))


def parse_buoy(lines: DataFrame) -> DataFrame:
    """Two- or four-digit year, minute resolution, heights outside 0..9000 dropped."""
    d = fields(lines, at_least=8)
    yy = whole(0)
    year = F.when(yy >= 100, yy).when(yy < 80, 2000 + yy).otherwise(1900 + yy)
    d = d.withColumn("_y", year)
    at = F.expr("try_make_timestamp(_y, try_cast(f[1] AS INT), try_cast(f[2] AS INT), try_cast(f[3] AS INT), try_cast(f[4] AS INT), 0)")
    return d.select(at.alias("observed_at"), num(7).alias("water_height_m"), whole(6).alias("measurement_type")).where("observed_at IS NOT NULL AND water_height_m BETWEEN 0 AND 9000 AND measurement_type IS NOT NULL")


def parse_position_document(docs: DataFrame) -> DataFrame:
    """Station header plus a +DATA / -DATA section, one row per data line."""
    d = docs.select(F.regexp_extract("value", r"(?m)^ ID\s+.*?(\S+)\s*$", 1).alias("station_id"), F.trim(F.regexp_extract("value", r"(?m)^ J_NAME\s+(.*)$", 1)).alias("station_name"),
                    F.regexp_extract("value", r"(?s)\n\+DATA[^\n]*\n(.*?)(?:\n-DATA|$)", 1).alias("_b"))
    d = d.select("station_id", "station_name", F.explode(F.split("_b", r"\r?\n")).alias("value"))
    d = fields(d, at_least=10, comment="*")
    d = once(d, date=_date(), x=num(4), height=num(9))
    return d.select("station_id", "station_name", "date", "x", num(5).alias("y"), num(6).alias("z"), num(7).alias("lat"), num(8).alias("lon"), "height").where("date IS NOT NULL AND x IS NOT NULL AND height IS NOT NULL")


def parse_moment_tensors(docs: DataFrame, first_year: int = 2011, bbox=(20.0, 50.0, 120.0, 155.0)) -> DataFrame:
    """Five-line records: centroid, both nodal planes, moment and Mw = 2/3 log10(M0) - 6.07."""
    d = docs.select(F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0).alias("ln"))
    n = F.floor(F.size("ln") / 5).cast("int")
    d = d.where(F.size("ln") >= 5).select("ln", F.explode(F.sequence(lit(0), n - 1)).alias("i"))
    tok = lambda k: F.split(F.trim(F.element_at("ln", c("i") * 5 + k)), r"\s+")
    d = d.select(*[tok(k).alias(f"l{k}") for k in (1, 2, 3, 4, 5)]).where("size(l1) >= 6 AND size(l2) >= 2 AND size(l3) >= 8 AND size(l4) >= 2 AND size(l5) >= 17")
    off = F.when(F.startswith(F.upper(F.element_at("l3", 1)), lit("CENTROID")), 1).otherwise(0)
    d = d.withColumn("o", off)
    g = lambda e: F.expr(f"try_cast({e} AS DOUBLE)")
    d = d.select(c("l2")[0].alias("event_id"), F.expr("try_to_timestamp(concat(l1[1], ' ', substring(l1[2], 1, 8)), 'yyyy/MM/dd HH:mm:ss')").alias("occurred_at"),
                 g("l3[o + 2]").alias("lat"), g("l3[o + 4]").alias("lon"), g("l3[o + 6]").alias("depth_km"), g("l4[0]").alias("_e"), g("l5[10]").alias("_m"),
                 *[g(f"l5[{11 + i}]").alias(nm) for i, nm in enumerate(("strike1", "dip1", "rake1", "strike2", "dip2", "rake2"))])
    moment = c("_m") * F.pow(lit(10.0), c("_e")) * lit(1e-7)
    d = d.withColumn("moment_nm", moment).withColumn("magnitude", F.bround(lit(2.0 / 3.0) * F.log10(F.greatest("moment_nm", lit(1e10))) - lit(6.07), 1)).drop("_e", "_m")
    la0, la1, lo0, lo1 = bbox
    return d.where(c("dip1").between(0, 90) & c("dip2").between(0, 90) & (F.year("occurred_at") >= first_year) & c("lat").between(la0, la1) & c("lon").between(lo0, lo1))


def parse_ionosphere_maps(docs: DataFrame, bbox=(20.0, 50.0, 120.0, 155.0)) -> DataFrame:
    """Maps of latitude bands with an exponent scale; 9999 is missing, only bands and columns of the box are kept."""
    la0, la1, lo0, lo1 = bbox
    expo = F.expr(r"coalesce(try_cast(nullif(trim(regexp_extract(value, '(?m)^(.{6}).*EXPONENT', 1)), '') AS INT), -1)")
    d = docs.select(expo.alias("expo"), F.split("value", "START OF TEC MAP").alias("p"))
    d = d.select("expo", F.explode(F.slice("p", lit(2), F.greatest(F.size("p") - 1, lit(0)))).alias("m"))
    # up to the line of the end mark; a pattern for that line would be tried from every character of every line
    head = F.substring_index("m", "END OF TEC MAP", 1)
    before = F.left(head, F.length(head) - F.length(F.substring_index(head, "\n", -1)))
    d = d.withColumn("m", F.when(F.contains("m", lit("END OF TEC MAP")), before).otherwise(c("m")))
    ep = F.split(F.trim(F.regexp_extract("m", r"(?m)^[ \t]*(\d{4}(?:[ \t]+\d+){5})", 1)), r"\s+")
    band = r"(?m)^(.{8}.{6}.{6}.{6}).*LAT/LON1/LON2/DLON/H[^\n]*\n((?:[ \t]*-?\d+(?:[ \t]+-?\d+)*[ \t]*\r?(?:\n|$))+)"
    # the pattern is passed as a literal column so that its backslashes reach the regex engine unchanged
    whole_band = F.regexp_extract_all("m", lit(band), lit(0))
    d = d.withColumn("e", ep).where(F.size("e") == 6).select(
        "expo", F.expr("try_make_timestamp(try_cast(e[0] AS INT), try_cast(e[1] AS INT), try_cast(e[2] AS INT), try_cast(e[3] AS INT), try_cast(e[4] AS INT), try_cast(e[5] AS DECIMAL(8,3)))").alias("epoch"),
        F.explode(whole_band).alias("b"))
    cut = lambda a, n: F.expr(f"try_cast(trim(substring(b, {a + 1}, {n})) AS DOUBLE)")
    d = d.select("expo", "epoch", cut(0, 8).alias("lat"), cut(8, 6).alias("lon1"), cut(20, 6).alias("dlon"), F.split(F.trim(F.expr(r"substring(b, instr(b, '\n') + 1)")), r"\s+").alias("t")).where(c("lat").between(la0, la1))
    d = d.select("expo", "epoch", "lat", "lon1", "dlon", F.posexplode("t").alias("j", "raw")).withColumn("lon", c("lon1") + c("j") * c("dlon"))
    v = F.expr("try_cast(raw AS INT)")
    return d.where(c("lon").between(lo0, lo1) & (v != 9999)).select("epoch", "lat", "lon", (v * F.pow(lit(10.0), c("expo"))).alias("tec"))


def parse_array_text(docs: DataFrame, variable: str, lat0: float, lon0: float, step: float = 0.25) -> DataFrame:
    """Array listing `name[i][j], v, v, …`: the last index is the row, positions are columns, fill values are dropped."""
    d = docs.select(*[x for x in docs.columns if x != "value"], F.explode(F.split("value", r"\r?\n")).alias("value"))
    pat = rf"^\s*(?:{variable})?(?:\[\d+\])*\[(\d+)\]\s*,(.*)$"
    d = d.withColumn("i", F.expr("1").cast("int")).withColumn("i", F.regexp_extract("value", pat, 1)).where("i <> ''")
    d = d.select(*[x for x in docs.columns if x != "value"], c("i").cast("int").alias("i"), F.posexplode(F.split(F.regexp_extract("value", pat, 2), ",")).alias("j", "raw"))
    v = F.expr("try_cast(trim(raw) AS DOUBLE)")
    return d.withColumn("v", v).where(c("v").between(-999, 1000)).select(
        *[x for x in docs.columns if x != "value"], (lit(lat0) + c("i") * step).alias("lat"), (lit(lon0) + c("j") * step).alias("lon"), F.round("v", 4).alias("value"))


def _csv(lines: DataFrame, names: list[str]) -> DataFrame:
    """Columns by name from comma lines; the schema is given, so no header state has to travel with the rows."""
    d = lines.select(F.split("value", ",").alias("f")).where(F.size("f") >= len(names))
    return d.select(*[F.trim(F.element_at("f", i + 1)).alias(n) for i, n in enumerate(names)])


def parse_sea_level_csv(lines: DataFrame) -> DataFrame:
    """time, level, lat, lon with a name row and a units row, which fail the casts and drop out."""
    d = _csv(lines, ["time", "level", "lat", "lon"])
    d = d.select(F.expr("try_to_timestamp(time)").alias("observed_at"), *[F.expr(f"try_cast({x} AS DOUBLE)").alias(x) for x in ("level", "lat", "lon")])
    return d.where("observed_at IS NOT NULL AND level BETWEEN -9000 AND 90000 AND lat IS NOT NULL AND lon IS NOT NULL").withColumnRenamed("level", "sea_level_mm")


def parse_station_csv(lines: DataFrame) -> DataFrame:
    d = _csv(lines, ["name", "station_id", "lat", "lon"])
    return d.select("name", *[F.expr(f"try_cast({x} AS {t})").alias(x) for x, t in (("station_id", "INT"), ("lat", "DOUBLE"), ("lon", "DOUBLE"))]).where("station_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def grid_csv_cells(lines: DataFrame, low: float, high: float, scale: float = 1.0, cell: float = 2.0) -> DataFrame:
    """time, lat, lon, value lines straight to the mean per (date, floor-centred cell)."""
    d = _csv(lines, ["time", "lat", "lon", "v"]).select(F.substring("time", 1, 10).alias("date"), *[F.expr(f"try_cast({x} AS DOUBLE)").alias(x) for x in ("lat", "lon", "v")])
    d = d.withColumn("v", c("v") * scale).where(c("v").isNotNull() & ~F.isnan("v") & c("v").between(low, high) & c("lat").isNotNull() & c("lon").isNotNull())
    mid = lambda x: F.floor(c(x) / cell) * cell + cell / 2
    return d.groupBy("date", mid("lat").alias("cell_lat"), mid("lon").alias("cell_lon")).agg(F.round(F.avg("v"), 4).alias("value"), F.count(lit(1)).alias("n"))


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV with a header: time, latitude, longitude, mag by name."""
    d = spark.read.option("header", True).csv(path)
    return d.select(F.expr("try_to_timestamp(time)").alias("ts"), *[F.expr(f"try_cast({a} AS DOUBLE)").alias(b) for a, b in (("latitude", "lat"), ("longitude", "lon"), ("mag", "mag"))]).where("ts IS NOT NULL AND mag IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def read_tracking_csv(spark: SparkSession, path: str) -> DataFrame:
    """Animal positions by column name; zero or missing coordinates and empty times are dropped."""
    d = spark.read.option("header", True).csv(path)
    d = d.select("individual_id", c("timestamp").alias("ts_text"), F.expr("try_cast(location_lat AS DOUBLE)").alias("lat"), F.expr("try_cast(location_long AS DOUBLE)").alias("lon"))
    return d.where("ts_text IS NOT NULL AND ts_text <> '' AND lat <> 0 AND lon <> 0")


def read_study_csv(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("header", True).csv(path)
    return d.select(F.expr("try_cast(id AS BIGINT)").alias("id"), *[x for x in d.columns if x != "id"]).where("id IS NOT NULL")


def read_flux_csv(spark: SparkSession, path: str, pattern: str = "(?i)(e2|2.?mev)") -> DataFrame:
    """Electron flux CSV whose value column is found by a name pattern; daily maximum."""
    import re
    d = spark.read.option("header", True).csv(path)
    value = next(x for x in d.columns if re.search(pattern, x))
    d = d.select(F.substring(c(d.columns[0]), 1, 10).alias("date"), F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("flux")).where("flux >= 0")
    return d.groupBy("date").agg(F.max("flux").alias("electron_2mev_max"))
