"""Snapshot, session, summary and magnitude-frequency aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import physics as ph
from .ordered import exact_quantiles, ranked


def tumbling(df: DataFrame, t: str, seconds: int, keys: Sequence[str], *aggs: Column, name: str = "bucket") -> DataFrame:
    """Fixed windows over epoch seconds; `bucket` is the window start."""
    start = (F.floor(F.col(t) / F.lit(seconds)) * F.lit(seconds)).cast("long").alias(name)
    return df.groupBy(*keys, start).agg(*aggs)


def latest_snapshot(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the newest timestamp; the maximum is a scalar subquery, so nothing is sorted or shuffled."""
    return df.where(F.col(ts) == df.select(F.max(ts)).scalar())


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One newest row per key, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m"))
            .select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest]))


def sessions(df: DataFrame, key: str, t: str, gap: int, value: str, chunk: int = 86400, extra: dict[str, tuple] | None = None) -> DataFrame:
    """Gap sessions (a pause longer than `gap` starts a new one) with count, span, mean, std, min and max.

    extra = {name: (column, F.min | F.max | F.sum)} adds further measures of a session.

    Rows become pieces inside (key, chunk of time). Only the first and the last piece of a chunk can go on in another
    chunk: those are merged per key, at most two rows per chunk whatever the key holds; all others are sessions as they are.
    """
    more = extra or {}
    rows = df.withColumn("_chunk", F.floor(F.col(t) / F.lit(chunk)))
    w = W.partitionBy(key, "_chunk").orderBy(t)
    rows = rows.withColumn("_new", (F.col(t) - F.lag(t).over(w) > F.lit(gap)).cast("int"))
    rows = rows.withColumn("_piece", F.sum(F.coalesce("_new", F.lit(0))).over(w.rangeBetween(W.unboundedPreceding, 0)))
    v = F.col(value)
    pieces = rows.groupBy(key, "_chunk", "_piece").agg(
        F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"),
        F.sum(v * v).alias("_q"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), *[fn(x).alias(name) for name, (x, fn) in more.items()])
    edge = (F.col("_piece") == 0) | (F.col("_piece") == F.max("_piece").over(W.partitionBy(key, "_chunk")))
    # lane: all edges of a key together, the others by chunk, where each piece starts anew
    pieces = pieces.withColumn("_lane", F.when(edge, F.lit(-(1 << 62))).otherwise(F.col("_chunk").cast("long")))
    w2 = W.partitionBy(key, "_lane").orderBy("_t0")
    pieces = pieces.withColumn("_new", (F.col("_t0") - F.lag("_t1").over(w2) > F.lit(gap)).cast("int"))
    pieces = pieces.withColumn("_sid", F.sum(F.coalesce("_new", F.lit(0))).over(w2))
    n, s, q = F.sum("_n"), F.sum("_s"), F.sum("_q")
    return pieces.groupBy(key, "_lane", "_sid").agg(
        F.min("_t0").alias("t_start"), F.max("_t1").alias("t_end"), n.alias("n"), (s / n).alias("mean"),
        F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("std"),
        F.min("_lo").alias("low"), F.max("_hi").alias("high"), *[fn(name).alias(name) for name, (_, fn) in more.items()]).drop("_lane", "_sid")


def passes(df: DataFrame, key: str, t: str, gap: int, lat: str, lon: str, value: str, vector: Sequence[str]) -> DataFrame:
    """Passes of a moving sensor: sessions of at least two samples with duration, bounding box, mean and sample deviation of
    `value` (null below one or two values) and mean and largest length of `vector`, over the samples that hold all its components."""
    parts = [F.col(x).cast("double") for x in vector]
    whole = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in parts])
    length = F.when(whole, F.sqrt(reduce(lambda a, b: a + b, [x * x for x in parts])))
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    extra = {"lat_min": (F.col(lat), F.min), "lat_max": (F.col(lat), F.max), "lon_min": (F.col(lon), F.min), "lon_max": (F.col(lon), F.max),
             "_vn": (v.isNotNull().cast("long"), F.sum), "_vs": (v, F.sum), "_vq": (v * v, F.sum),
             "_ln": (length.isNotNull().cast("long"), F.sum), "_ls": (length, F.sum), "residual_max": (length, F.max)}
    s = sessions(df, key, t, gap, value, extra=extra).where("n >= 2")
    n = F.col("_vn")
    spread = F.greatest(F.col("_vq") - F.col("_vs") * F.col("_vs") / n, F.lit(0.0)) / (n - 1)
    return s.select(key, "t_start", (F.col("t_end") - F.col("t_start")).alias("duration_s"), "n", "lat_min", "lat_max", "lon_min", "lon_max",
                    F.when(n > 0, F.col("_vs") / n).alias("value_mean"), F.when(n > 1, F.sqrt(spread)).alias("value_std"),
                    F.when(F.col("_ln") > 0, F.col("_ls") / F.col("_ln")).alias("residual_mean"), "residual_max")


def summary(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], shares: dict[str, Column] | None = None
            ) -> DataFrame:
    """Count, mean, exact percentiles and shares of rows for which a condition holds, per key."""
    q = exact_quantiles(df, keys, value, probs)
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), *[F.avg(c.cast("double")).alias(n) for n, c in (shares or {}).items()])
    if keys:
        return q.join(base, list(keys))
    k = F.lit(1).alias("_k")
    return q.select("*", k).join(base.select("*", k), "_k").drop("_k")


def magnitude_stats(mag: str) -> list[Column]:
    """The four numbers every b-value form needs; they merge map-side."""
    return [F.count(mag).alias("n"), F.avg(mag).alias("m_mean"), F.min(mag).alias("m_min"), F.var_samp(mag).alias("m_var")]


def sliding_b(df: DataFrame, day: str, mag: str, window: int) -> DataFrame:
    """b- and a-value of every `window`-day window that starts on a day of the catalogue and ends inside it.

    Days are summed first, so an event is never repeated; a window adds `window` day rows.
    """
    days = df.groupBy(F.col(day).alias("_d")).agg(F.count(mag).alias("_n"), F.sum(mag).alias("_s"), F.min(mag).alias("_lo"))
    first, last = df.select(F.min(day)).scalar(), df.select(F.max(day)).scalar()
    spread = days.select("*", F.explode(F.sequence(F.col("_d") - (window - 1), F.col("_d"))).alias("start"))
    spread = spread.where((F.col("start") >= first) & (F.col("start") + window <= last))
    g = spread.groupBy("start").agg(F.sum("_n").alias("n_events"), (F.sum("_s") / F.sum("_n")).alias("m_mean"),
                                    F.min("_lo").alias("m_min"))
    b = ph.b_min(F.col("n_events"), F.col("m_mean"), F.col("m_min"), 10)
    g = g.withColumn("b_value", b).where(F.col("b_value").isNotNull())
    return g.withColumn("a_value", F.log10(F.col("n_events").cast("double")) + F.col("b_value") * F.col("m_min"))


def kappa1(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], mag: str, min_n: int = 6) -> DataFrame:
    """Natural-time variance per key: rank / N weighted by 10^(1.5 M)."""
    r = ranked(df, keys, order, ties, "_k", total="_n")
    q = ph.p10(F.lit(1.5) * F.col(mag))
    chi = F.col("_k") / F.col("_n")
    g = r.groupBy(*keys).agg(F.max("_n").alias("n"), F.sum(q).alias("_q"), F.sum(q * chi).alias("_q1"),
                             F.sum(q * chi * chi).alias("_q2")).where(F.col("n") >= min_n)
    m = F.col("_q1") / F.col("_q")
    return g.select(*keys, "n", (F.col("_q2") / F.col("_q") - m * m).alias("kappa1"))
