"""Table reports, run-over-run checks and publish guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c, lit = F.col, F.lit
RANK = {"OK": 3, "LOW": 2, "EMPTY": 1, "MISSING": 0}


def table_report(tables: dict[str, dict], spark) -> DataFrame:
    """One row per expected table: rows, first and last day, coverage of the expected days and a status.

    tables[name] = {df or None, day, min_rows, expected_days}; each table is one aggregation over two columns.
    """
    parts = []
    for name, spec in tables.items():
        if spec.get("df") is None:
            parts.append(spark.range(1).select(lit(name).alias("table"), lit(0).cast("long").alias("rows"), lit(None).cast("long").alias("first_day"), lit(None).cast("long").alias("last_day"),
                                               lit(None).cast("double").alias("coverage_pct"), lit("MISSING").alias("status")))
            continue
        a = spec["df"].agg(F.count(lit(1)).alias("rows"), F.min(spec["day"]).cast("long").alias("first_day"), F.max(spec["day"]).cast("long").alias("last_day"))
        cov = F.least((c("last_day") - c("first_day")) / lit(float(spec["expected_days"])) * 100, lit(100.0))
        st = F.when(c("rows") == 0, "EMPTY").when(c("rows") < spec["min_rows"], "LOW").otherwise("OK")
        parts.append(a.select(lit(name).alias("table"), "rows", "first_day", "last_day", F.when(c("last_day").isNotNull(), F.round(cov, 1)).alias("coverage_pct"), st.alias("status")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall(report: DataFrame, critical: list[str]) -> DataFrame:
    n = lambda s: F.count_if(c("status") == s)
    a = report.agg(F.count_if(c("table").isin(*critical) & (c("status") != "OK")).alias("crit"), n("OK").alias("ok"), n("LOW").alias("low"), n("EMPTY").alias("empty"), n("MISSING").alias("missing"))
    st = F.when(c("crit") > 0, "CRITICAL").when((c("missing") > 5) | (c("empty") > 10), "DEGRADED").when(c("low") > 5, "WARNING").otherwise("HEALTHY")
    return a.select(st.alias("status"), "ok", "low", "empty", "missing")


def regressions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Tables whose status fell, or whose rows dropped by more than a fifth at the same status."""
    rank = F.create_map(*[lit(x) for kv in RANK.items() for x in kv])
    j = now.select("table", "rows", "status").join(before.select("table", c("rows").alias("prev_rows"), c("status").alias("prev_status")), "table")
    fell = rank[c("status")] < rank[c("prev_status")]
    drop = (c("prev_rows") > 0) & (c("rows") > 0) & (c("rows") < c("prev_rows") * 0.8) & (c("status") == c("prev_status"))
    return j.where(fell | drop).withColumn("kind", F.when(fell, "status").otherwise("rows"))


def publish_guard(counts: DataFrame, threshold: float = 0.5, force: bool = False) -> DataFrame:
    """Skip a publish that falls below its minimum or below the share of what is published (the boundary passes)."""
    low = c("rows") < c("min_rows")
    shrunk = (c("published") > 0) & (c("rows") / F.greatest(c("published"), lit(1)) < threshold)
    d = F.when(low, "skip_minimum").when(shrunk & lit(not force), "skip_regression").otherwise("publish")
    return counts.withColumn("decision", d)


def manifest_check(now: DataFrame, manifest: DataFrame, keep: float = 0.95) -> DataFrame:
    """Row counts against the manifest; a table that is gone or below `keep` fails."""
    j = manifest.select("table", c("rows").alias("expected")).join(now.select("table", "rows"), "table", "left")
    return j.withColumn("rows", F.coalesce("rows", lit(0).cast("long"))).withColumn("ok", (c("rows") >= c("expected") * keep).cast("int"))


def gap_diagnosis(df: DataFrame, year: str, day: str, first_year: int, last_year: int, cadence: int = 1) -> DataFrame:
    """Distinct days per expected year with cadence-aware coverage; years without data appear with 0."""
    have = df.select(year, day).distinct().groupBy(c(year).alias("year")).agg(F.count(lit(1)).alias("days"))
    want = df.sparkSession.range(first_year, last_year + 1).select(c("id").cast("int").alias("year"))
    j = want.join(have, "year", "left").withColumn("days", F.coalesce("days", lit(0).cast("long")))
    return j.withColumn("coverage_pct", F.round(F.least(c("days") * cadence / lit(365.0) * 100, lit(100.0)), 2)).withColumn("gap", (c("days") == 0).cast("int"))
