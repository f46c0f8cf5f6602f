"""Row expansion: grids, calendars, fills and systematic samples. Every expansion has a fixed factor per input row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .ordered import ranked


def cell_grid(spark: SparkSession, i: tuple[int, int], j: tuple[int, int]) -> DataFrame:
    """All (ci, cj) of a closed index box."""
    return (spark.range(i[0], i[1] + 1).select(F.col("id").cast("int").alias("ci"),
            F.explode(F.sequence(F.lit(j[0]), F.lit(j[1]))).alias("cj")))


def with_steps(df: DataFrame, first, last, step: int, name: str = "step") -> DataFrame:
    """Repeat each row for every step of [first, last]; the bounds are plan-time numbers or columns."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(int(x)).cast("long")
    return df.withColumn(name, F.explode(F.sequence(lit(first), lit(last), F.lit(step).cast("long"))))


def with_values(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Repeat each row for every value of a short literal list (thresholds, leads, window lengths)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def day_window(df: DataFrame, day: str, back: int, ahead: int, name: str = "d") -> DataFrame:
    """Days around an anchor date."""
    return df.withColumn(name, F.explode(F.sequence(F.date_sub(day, back), F.date_add(day, ahead))))


def period_days(df: DataFrame, day: str, unit: str, name: str = "d") -> DataFrame:
    """A month or year value repeated for each day of its period."""
    start = F.trunc(day, unit)
    end = F.last_day(day) if unit == "month" else F.date_sub(F.add_months(start, 12), 1)
    return df.withColumn(name, F.explode(F.sequence(start, end)))


def forward_fill_days(df: DataFrame, keys: Sequence[str], day: str, limit: int, name: str = "d") -> DataFrame:
    """Repeat each observation until the day before the next one, at most `limit` days on."""
    nxt = F.lead(day).over(W.partitionBy(*keys).orderBy(day))
    stop = F.least(F.date_add(day, limit), F.coalesce(F.date_sub(nxt, 1), F.date_add(day, limit)))
    return df.withColumn("_stop", stop).withColumn(name, F.explode(F.sequence(F.col(day), F.col("_stop")))).drop("_stop")


def systematic_sample(df: DataFrame, order: str, ties: Sequence[str], n: int) -> DataFrame:
    """n rows evenly spread over the order: ranks floor(i * N / n), all rows when N <= n."""
    r = ranked(df, [], order, ties, "_rk", total="_n")
    pos = F.col("_rk") - 1
    # rank p is picked when some integer i has floor(i*N/n) = p
    i = F.ceil(pos * F.lit(n) / F.col("_n"))
    picked = (F.col("_n") <= n) | ((i < n) & (F.floor(i * F.col("_n") / F.lit(n)) == pos))
    return r.where(picked).drop("_rk", "_n")
