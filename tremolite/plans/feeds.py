"""Features of optional feeds, one line each. The text of a feature is plain SQL over a small daily frame, so the same line runs in
any dialect; frames hold one row per day, per (cell, day) or per (cell, month), and every window is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

c, lit = F.col, F.lit


def _over(part: str, back: int, to: str = "1 PRECEDING") -> str:
    return f"OVER ({part} ORDER BY dn ROWS BETWEEN {back} PRECEDING AND {to})"


def anomaly(x: str, floor: str, part: str = "", back: int = 30, test: str = "> 0") -> str:
    """Deviation from the rows before, in their standard deviations; 0 where the feed has no value."""
    w = _over(part, back)
    return (f"CASE WHEN {x} {test} THEN ({x} - coalesce(avg({x}) {w}, {x})) / greatest(CASE WHEN count({x}) {w} >= 2 THEN stddev_pop({x}) {w} ELSE 1e0 END, {floor}) "
            "ELSE 0e0 END")


def step(x: str, part: str = "") -> str:
    return f"coalesce({x} - lag({x}) OVER ({part} ORDER BY dn), 0e0)"


def decade(x: str, least: str) -> str:
    return f"log10(greatest({x}, {least}))"


CELL = "PARTITION BY ci, cj"
# Feature, its text, the value where a feed has no row. Columns v, q, s, x of the daily frame stand for a feed each.
DAILY = {
    "cosmic_ray_rate": ("v", 0), "cosmic_ray_anomaly": (anomaly("v", "1e-3", back=27), 0),
    "cosmic_ray_trend_15d": (f"coalesce(regr_slope(v, dn - 9000) {_over('', 14, 'CURRENT ROW')}, 0e0)", 0),
    "geomag_ulf_power": ("q", 0), "geomag_polarization": ("s * 10", 1), "geomag_fractal_dim": ("1 + x * 10", 1.5),
    "lod_rate": (step("x"), 0), "polar_motion_speed": (f"sqrt(pow({step('s')}, 2) + pow({step('x')}, 2))", 0),
    "sw_bz_min_24h": ("low", 0), "sw_pressure_max_24h": ("high", 0), "dst_min_24h": ("-high", 0),
    "tide_residual_anomaly": (anomaly("v", "1e-1", test="<> 0"), 0), "xray_flux_max_24h": (decade("s / 1e6", "1e-9"), -9),
    "proton_flux_max_24h": (decade("v / 1e4", "1e-2"), -2), "tidal_shear_stress": ("q", 0), "tidal_stress_rate": (step("q"), 0),
    "particle_precip_rate": (decade("high", "1e-1"), -1), "dart_pressure_anomaly": (anomaly("q", "1e-3"), 0), "dart_pressure_rate": (step("q"), 0),
    "ioc_sealevel_anomaly": (anomaly("s", "1e-3", test="<> 0"), 0),
    **{f"snet_{n}_anomaly": (anomaly(x, "1e-3", test="<> 0"), 0) for n, x in (("rms", "v"), ("hv_ratio", "q"), ("lf_power", "s"), ("hf_power", "x"), ("spectral_slope", "low"))},
    "snet_spatial_gradient": ("(high - low) / greatest(v, 1e-3)", 0), "snet_segment_max_anomaly": (anomaly("high", "1e-3", test="<> 0"), 0),
    **{f"snet_{n}": (anomaly(x, "1e-3", test="<> 0"), 0) for n, x in (("vlf_power_anomaly", "v"), ("vlf_hv_ratio_anomaly", "x"), ("velocity_rms_anomaly", "q"), ("highgain_snr_anomaly", "high"), ("spectral_slope_velocity", "low"))},
    "snet_vlf_hf_ratio": ("s / greatest(x, 1e-3)", 0), "snet_accel_velocity_coherence": (f"coalesce(corr(v, q) {_over('', 29, 'CURRENT ROW')}, 0e0)", 0),
    "snet_vlf_spatial_gradient": ("(high - low) / greatest(q, 1e-3)", 0),
}
DAILY_CELL = {
    "lightning_count_7d": (f"sum(q) OVER ({CELL} ORDER BY dn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)", 0),
    "lightning_anomaly": (f"CASE WHEN sum(q) OVER ({CELL} ORDER BY dn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) > 0 THEN (sum(q) OVER ({CELL} ORDER BY dn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) - 7e0) / 7e0 ELSE 0e0 END", 0),
    "olr_anomaly": (anomaly("v", "1e-1", CELL), 0), "gravity_anomaly_rate": (step("v", CELL), 0), "so2_column_anomaly": (f"v - avg(v) OVER ({CELL})", 0),
    "soil_moisture_anomaly": (anomaly("q", "1e-3", CELL), 0), "ocean_color_anomaly": (anomaly("q", "1e-2", CELL), 0), "cloud_fraction_anomaly": (anomaly("high", "1e-2", CELL), 0),
    "nightlight_anomaly": (anomaly("v", "1e-2", CELL, 180), 0), "insar_deformation_rate": (f"high - avg(high) OVER ({CELL})", 0),
}
MONTHLY = {
    f"{feed}{suffix}": (text.format(x=x, w=f"OVER ({CELL}, mon)"), 0)
    for feed, x in (("lis_otd_flash_rate", "q"), ("wwlln_thunder_hours", "high"))
    for suffix, text in (("", "{x}"), ("_zscore", "CASE WHEN {x} > 0 AND stddev_pop({x}) {w} > 1e-9 THEN ({x} - avg({x}) {w}) / greatest(stddev_pop({x}) {w}, 1e-6) ELSE 0e0 END"),
                         ("_ratio", "CASE WHEN {x} > 0 AND avg({x}) {w} > 0 THEN {x} / greatest(avg({x}) {w}, 1e-6) ELSE 0e0 END"))
}
FEATURES = [*DAILY, *DAILY_CELL, *MONTHLY]
_DAY = "avg(value) AS v, avg(qty) AS q, avg(disc) AS s, avg(tax) AS x, min(value) AS low, max(value) AS high"
_GRID = "avg(value) AS v, sum(quality) AS q, max(value) AS high"


def _columns(spec: dict) -> str:
    return ", ".join(f"{text} AS {name}" for name, (text, _) in spec.items())


def feed_table(v, grid):
    """All feed features for every (ci, cj, step) of `grid`; a feed without a row gives its stated value."""
    day = v.daily_obs.groupBy("dn").agg(*[F.expr(x) for x in _DAY.split(", ")])
    cell = v.grid_obs.groupBy(c("gi").alias("ci"), c("gj").alias("cj"), "dn").agg(*[F.expr(x) for x in _GRID.split(", ")])
    month = v.grid_obs.groupBy(c("gi").alias("ci"), c("gj").alias("cj"), (F.year("d") * 12 + F.month("d")).alias("ym"), F.month("d").alias("mon")).agg(*[F.expr(x) for x in _GRID.split(", ")])
    of = lambda frame, keys, spec: frame.selectExpr(*keys, *[f"{text} AS {n}" for n, (text, _) in spec.items()])
    date = F.date_from_unix_date(c("step").cast("int"))
    out = grid.withColumn("ym", F.year(date) * 12 + F.month(date))
    out = out.join(of(day, ["dn AS step"], DAILY), "step", "left")
    out = out.join(of(cell, ["ci", "cj", "dn AS step"], DAILY_CELL), ["ci", "cj", "step"], "left")
    out = out.join(of(month, ["ci", "cj", "ym"], MONTHLY), ["ci", "cj", "ym"], "left").drop("ym")
    return out.withColumns({n: F.coalesce(c(n).cast("double"), lit(float(d))) for spec in (DAILY, DAILY_CELL, MONTHLY) for n, (_, d) in spec.items()})


def feed_sql(grid_sql: str, digits: int = 6) -> str:
    """The same table as SQL text, rounded; the billionth keeps exact halves from falling either way."""
    pick = ", ".join(f"0.0 + round(coalesce(CAST({n} AS DOUBLE), {float(d)!r}) + 1e-9, {digits}) AS {n}" for spec in (DAILY, DAILY_CELL, MONTHLY) for n, (_, d) in spec.items())
    return f"""WITH {grid_sql}, day AS (SELECT dn, {_DAY} FROM daily_obs GROUP BY dn), cel AS (SELECT gi AS ci, gj AS cj, dn, {_GRID} FROM grid_obs GROUP BY 1, 2, 3),
      mth AS (SELECT gi AS ci, gj AS cj, year(d) * 12 + month(d) AS ym, month(d) AS mon, {_GRID} FROM grid_obs GROUP BY 1, 2, 3, 4),
      fd AS (SELECT dn, {_columns(DAILY)} FROM day), fc AS (SELECT ci, cj, dn, {_columns(DAILY_CELL)} FROM cel), fm AS (SELECT ci, cj, ym, {_columns(MONTHLY)} FROM mth),
      bd AS (SELECT *, year(DATE '1970-01-01' + CAST(step AS INT)) * 12 + month(DATE '1970-01-01' + CAST(step AS INT)) AS ym FROM base)
      SELECT bd.ci, bd.cj, bd.step, {pick} FROM bd LEFT JOIN fd ON fd.dn = bd.step LEFT JOIN fc ON fc.ci = bd.ci AND fc.cj = bd.cj AND fc.dn = bd.step
      LEFT JOIN fm ON fm.ci = bd.ci AND fm.cj = bd.cj AND fm.ym = bd.ym"""
