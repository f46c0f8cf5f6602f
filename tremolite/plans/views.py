"""Deterministic views over the driver tables, written once per dialect, so that every operator has events, stations,
series, grids and scores to run on. All of them read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

_LAT = "26 + ((o_orderkey*7 + o_custkey*13) % 2001)/1e2"
_LON = "128 + ((o_custkey*131 + o_orderkey*17) % 2001)/1e2"
_MAG = "round(3 - ln(((o_orderkey*7919 + o_custkey*104729) % 9973 + 5e-1)/9973)/23e-1, 2)"
_GLAT = "26 + ((l_suppkey*7919) % 401)/2e1"
_GLON = "128 + ((l_suppkey*104729) % 401)/2e1"
_P = "((l_partkey*37 + l_suppkey*11 + l_linenumber*7) % 900 + (CASE WHEN l_returnflag='R' THEN 50 ELSE 0 END))/1e3"

# name -> (table, [(column, spark expression, duckdb expression)])
_DEFS = {
    "quakes": ("orders", [
        ("event_id", "o_orderkey", None),
        ("t", "unix_seconds(cast(o_orderdate as timestamp)) + (o_orderkey*7919) % 86400",
         "CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey*7919) % 86400"),
        ("lat", _LAT, None), ("lon", _LON, None), ("mag", _MAG, None),
        ("depth_km", "CAST(o_orderkey % 90 AS DOUBLE)", None),
        ("ci", f"CAST(bround(({_LAT})/2e0) AS INT)", f"CAST(round_even(({_LAT})/2e0, 0) AS INT)"),
        ("cj", f"CAST(bround(({_LON})/2e0) AS INT)", f"CAST(round_even(({_LON})/2e0, 0) AS INT)"),
        ("dn", "(unix_seconds(cast(o_orderdate as timestamp)) + (o_orderkey*7919) % 86400) div 86400",
         "(CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey*7919) % 86400) // 86400"),
    ]),
    "series": ("events", [
        ("id", "event_id", None), ("name", "event_type", None),
        ("t_us", "unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
        ("h", "unix_micros(cast(ts as timestamp)) div 3600000000", "epoch_us(ts) // 3600000000"),
        ("value", "value", None),
    ]),
    "station_obs": ("events", [
        ("id", "event_id", None), ("station", "user_id", None),
        ("t", "unix_seconds(cast(ts as timestamp))", "CAST(floor(epoch(ts)) AS BIGINT)"),
        ("t_us", "unix_micros(cast(ts as timestamp))", "epoch_us(ts)"),
        ("dn", "unix_seconds(cast(ts as timestamp)) div 86400", "epoch_us(ts) // 86400000000"),
        ("h", "unix_micros(cast(ts as timestamp)) div 3600000000", "epoch_us(ts) // 3600000000"),
        ("kind", "event_type", None), ("value", "value", None),
        ("flag", "CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract(props, '$.k') AS INT)"),
    ]),
    "stations": ("supplier", [
        ("sid", "s_suppkey", None),
        ("slat", "26 + ((s_suppkey*379) % 2001)/1e2", None), ("slon", "128 + ((s_suppkey*757) % 2001)/1e2", None),
        ("sname", "s_name", None), ("elevation", "s_acctbal", None), ("network", "s_nationkey", None),
    ]),
    "mechanisms": ("customer", [
        ("mid", "c_custkey", None),
        ("mi", "CAST(260 + (c_custkey*11) % 201 AS INT)", None), ("mj", "CAST(1280 + (c_custkey*29) % 201 AS INT)", None),
        ("strike", "CAST((c_custkey*37) % 360 AS DOUBLE)", None), ("dip", "CAST(10 + (c_custkey*7) % 80 AS DOUBLE)", None),
        ("rake", "CAST((c_custkey*53) % 360 - 180 AS DOUBLE)", None),
    ]),
    "scores": ("lineitem", [
        ("k", "l_orderkey*8 + l_linenumber", None),
        ("y", "CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END", None), ("p", _P, None),
        ("fold", "CAST(l_orderkey % 5 AS INT)", None), ("qty", "l_quantity", None), ("price", "l_extendedprice", None),
        ("disc", "l_discount", None), ("ship", "CAST(l_shipdate AS DATE)", None), ("status", "l_linestatus", None),
    ]),
    "daily_obs": ("lineitem", [
        ("station", "l_suppkey", None), ("d", "CAST(l_shipdate AS DATE)", None),
        ("dn", "unix_seconds(cast(l_shipdate as timestamp)) div 86400", "epoch_us(l_shipdate) // 86400000000"),
        ("value", "sqrt(l_extendedprice)", None), ("qty", "l_quantity", None), ("disc", "l_discount", None),
        ("tax", "l_tax", None), ("line", "l_linenumber", None),
    ]),
    "grid_obs": ("lineitem", [
        ("d", "CAST(l_shipdate AS DATE)", None),
        ("dn", "unix_seconds(cast(l_shipdate as timestamp)) div 86400", "epoch_us(l_shipdate) // 86400000000"),
        ("glat", _GLAT, None), ("glon", _GLON, None), ("value", "sqrt(l_extendedprice)", None), ("quality", "l_discount", None),
        ("gi", f"CAST(bround(({_GLAT})/2e0) AS INT)", f"CAST(round_even(({_GLAT})/2e0, 0) AS INT)"),
        ("gj", f"CAST(bround(({_GLON})/2e0) AS INT)", f"CAST(round_even(({_GLON})/2e0, 0) AS INT)"),
    ]),
    "attempts": ("events", [
        ("station", "user_id", None), ("dn", "unix_seconds(cast(ts as timestamp)) div 86400", "epoch_us(ts) // 86400000000"),
        ("t", "unix_seconds(cast(ts as timestamp))", "CAST(floor(epoch(ts)) AS BIGINT)"),
        ("failed", "CASE WHEN event_type='error' THEN 1 ELSE 0 END", None), ("id", "event_id", None),
    ]),
}

VIEW_SQL = {
    name: "SELECT " + ", ".join(f"{duck or spark} AS {col}" for col, spark, duck in cols) + f" FROM {table}"
    for name, (table, cols) in _DEFS.items()
}


class Views:
    """Lazily opened tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _DEFS:
            table, cols = _DEFS[name]
            return self.table(table).selectExpr(*[f"{spark} AS {col}" for col, spark, _ in cols])
        raise AttributeError(name)
