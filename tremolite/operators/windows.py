"""Rolling baselines, trends and displacement windows.

`rolling_anomaly` works on raw rows and splits hot series; the others take one row per (key, day or hour), where a group
is bounded by the calendar, and use plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import rolling


def rolling_anomaly(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: str, back: int = 72,
                    min_points: int = 6, sigma: float = 2.0) -> DataFrame:
    """Rows whose distance from the mean of the `back` preceding rows is at least `sigma` standard deviations."""
    def make(frame):
        w = frame(-back, -1)
        return {"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w), "_n": F.count(value).over(w)}
    out = rolling(df, keys, order, ties, back, 0, make).where((F.col("_n") >= min_points) & (F.col("std") >= 1e-10))
    out = out.withColumn("sigma", (F.col(value) - F.col("mean")) / F.col("std")).drop("_n")
    return out.where(F.abs("sigma") >= F.lit(float(sigma))).withColumn(
        "direction", F.when(F.col("sigma") > 0, "high").otherwise("low"))


def series_anomaly(df: DataFrame, keys: Sequence[str], order: str, value: str, back: int = 72, min_points: int = 6,
                   sigma: float = 2.0) -> DataFrame:
    """The same rule for one row per (key, epoch)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-back, -1)
    out = df.withColumns({"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w), "_n": F.count(value).over(w)})
    out = out.where((F.col("_n") >= min_points) & (F.col("std") >= 1e-10))
    out = out.withColumn("sigma", (F.col(value) - F.col("mean")) / F.col("std")).drop("_n")
    return out.where(F.abs("sigma") >= F.lit(float(sigma)))


def baseline(df: DataFrame, keys: Sequence[str], order: str, value: str, back: int = 30, floor: float = 0.1,
             skip_zero: bool = False, single_std: float = 1.0) -> DataFrame:
    """Mean and floored std of the `back` rows before; the value itself and `single_std` where there is no history."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-back, -1)
    v = F.nullif(F.col(value), F.lit(0.0)) if skip_zero else F.col(value)
    n = F.count(v).over(w)
    mean = F.coalesce(F.avg(v).over(w), F.col(value))
    need = 1 if skip_zero else 2
    std = F.when(n >= need, F.stddev_pop(v).over(w)).otherwise(F.lit(single_std))
    return df.withColumns({f"{value}_mean": mean, f"{value}_std": F.greatest(std, F.lit(floor))})


def rolling_mean_std(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int) -> DataFrame:
    """Mean and std of the last `window` rows (current included), NULL when less than half of them hold a value."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    ok = F.count(value).over(w) >= window // 2
    return df.withColumns({"roll_mean": F.when(ok, F.avg(value).over(w)), "roll_std": F.when(ok, F.stddev_pop(value).over(w))})


def frame_slope(value: Column, x: Column, w, min_count: int) -> Column:
    """OLS slope over a frame, 0 below `min_count` points (a one-row slope is undefined)."""
    return F.when(F.count(value).over(w) >= min_count, F.coalesce(F.regr_slope(value, x).over(w), F.lit(0.0))).otherwise(F.lit(0.0))


def tail_split_sigma(df: DataFrame, key: str, epoch: str, value: str, tail: int = 8, min_epochs: int = 6) -> DataFrame:
    """Last `tail` epochs of each event window against the earlier ones: means, sample size and distance in std."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc(epoch)))
    r = df.withColumn("_rn", rn)
    late, early = F.when(F.col("_rn") <= tail, F.col(value)), F.when(F.col("_rn") > tail, F.col(value))
    g = r.groupBy(key).agg(F.count(F.lit(1)).alias("n_epochs"), F.avg(late).alias("precursor"), F.avg(early).alias("base"),
                           F.stddev_pop(early).alias("base_std")).where(F.col("n_epochs") >= min_epochs)
    return g.withColumn("sigma", F.when(F.col("base_std") > 0.1, (F.col("precursor") - F.col("base")) / F.col("base_std")).otherwise(
        F.when(F.col("base").isNotNull(), F.lit(0.0))))


def gap_list(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Missing stretches between consecutive observed days (day numbers)."""
    d = df.select(*keys, day).distinct()
    nxt = F.lead(day).over(W.partitionBy(*keys).orderBy(day))
    return d.withColumn("next_day", nxt).withColumn("missing", F.col("next_day") - F.col(day) - 1).where("missing > 0")


def islands(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Runs of consecutive integers per key."""
    d = df.select(*keys, n).distinct()
    g = F.col(n) - F.row_number().over(W.partitionBy(*keys).orderBy(n))
    return d.withColumn("_g", g).groupBy(*keys, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def average_rank(df: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """Ascending rank with ties averaged; ranks come from the distinct scores, not from the rows."""
    from .ordered import running
    g = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    r = running(g, keys, "_s", {"_cum": F.col("_c")})
    r = r.select(*keys, F.col("_s").alias(score), (F.col("_cum") - (F.col("_c") - 1) / F.lit(2.0)).alias(name))
    return df.join(r, [*keys, score])
