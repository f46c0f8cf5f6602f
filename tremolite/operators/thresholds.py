"""Top-k rows of a neighbourhood without forming all pairs.

Counts per (time bin, cell, rank class) first give every left row a class that its k-th best row cannot fall below: bins that lie
wholly inside its window hold at least k rows of that class or a better one. Only right rows of that class or better then meet the
left row. Left rows that share their inner bins share one bound, so the counting is bounded by grid and calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import joins as jn

c, lit = F.col, F.lit
PARTS = 4  # bins per reach: a window of 2 x reach always holds 2 * PARTS - 1 whole bins per axis
TIMES = 12  # time bins per window


def _first_inside(low: Column, width: float) -> Column:
    return F.ceil((low + lit(jn.EDGE)) / lit(width)).cast("long")


def _last_inside(high: Column, width: float) -> Column:
    return (F.floor((high - lit(jn.EDGE)) / lit(width)) - 1).cast("long")


def _slide(bins: DataFrame, axis: str, keys: Sequence[str]) -> DataFrame:
    """Counts of the 2 * PARTS - 1 bins from `axis` on."""
    many = 2 * PARTS - 1
    spread = bins.withColumn("_a", F.explode(F.sequence(c(axis) - (many - 1), c(axis)))).drop(axis).withColumnRenamed("_a", axis)
    return spread.groupBy(*keys).agg(F.sum("_n").alias("_n"))


def class_bounds(left: DataFrame, right: DataFrame, k: int, time: tuple, box: tuple, rank: str, width: float) -> DataFrame:
    """`left` with `_bound`: the best class known to hold the k-th row or better ones; null where the inner bins hold fewer than k."""
    lt, rt, back = time
    la, lo, ra, ro, r = box
    hs, ht = float(r) / PARTS, float(back) / TIMES
    bins = right.where(c(rank).isNotNull()).groupBy(
        jn._bucket(c(rt), ht).alias("_bt"), jn._bucket(c(ra), hs).alias("_by"), jn._bucket(c(ro), hs).alias("_bx"),
        jn._bucket(c(rank), width).alias("_cls")).agg(F.count(lit(1)).alias("_n"))
    keys = ["_bt", "_by", "_bx", "_cls"]
    blocks = _slide(_slide(bins, "_by", keys), "_bx", keys)
    left = left.withColumns({"_by": _first_inside(c(la) - lit(r), hs), "_bx": _first_inside(c(lo) - lit(r), hs),
                             "_t0": _first_inside(c(lt) - lit(back), ht), "_t1": _last_inside(c(lt), ht)})
    place = ["_by", "_bx", "_t0", "_t1"]
    probes = left.select(*place).distinct().where("_t0 <= _t1")
    met = probes.withColumn("_bt", F.explode(F.sequence("_t0", "_t1"))).join(blocks, ["_bt", "_by", "_bx"]).groupBy(*place, "_cls").agg(F.sum("_n").alias("_n"))
    best_first = W.partitionBy(*place).orderBy(F.desc("_cls"))  # one row per class of a probe
    bounds = met.withColumn("_m", F.sum("_n").over(best_first)).where(c("_m") >= k).groupBy(*place).agg(F.max("_cls").alias("_bound"))
    return left.join(bounds, place, "left").drop(*place)


def candidates(left: DataFrame, right: DataFrame, k: int, time: tuple, box: tuple, rank: str, width: float) -> DataFrame:
    """Pairs inside the window that can belong to the k rows of largest `rank` of a left row.

    time = (left_t, right_t, back): left_t - back <= right_t < left_t. box as in `joins.range_join`. Rows of equal rank all stay, so the caller may break
    ties as it likes; right rows of null rank never count. Where `rank` is the right time itself, the bound shortens the window instead of adding a class key.
    """
    lt, rt, back = time
    la, lo, ra, ro, r = box
    right = right.where(c(rank).isNotNull())
    bounded = class_bounds(left, right, k, time, box, rank, width)
    cover = lambda x, reach: F.explode(F.sequence(jn._bucket(c(x) - lit(reach + jn.EDGE), reach), jn._bucket(c(x) + lit(reach + jn.EDGE), reach)))
    inside = (F.abs(c(la) - c(ra)) <= lit(float(r))) & (F.abs(c(lo) - c(ro)) <= lit(float(r))) & (c(rt) >= c(lt) - lit(back)) & (c(rt) < c(lt))
    if rank == rt:
        low, high = F.greatest(F.coalesce(c("_bound"), jn._bucket(c(lt) - lit(back), width)), jn._bucket(c(lt) - lit(back), width)), jn._bucket(c(lt), width)
    else:
        ends = right.select(F.min(rank).alias("a"), F.max(rank).alias("b"))
        end = lambda x: ends.select(jn._bucket(c(x), width)).scalar()
        low, high = F.coalesce(c("_bound"), end("a")), end("b")
    probe = bounded.select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("_cls")).drop("_bound")
    keys = ["_cls", "_cy", "_cx"]
    probe = probe.select("*", cover(la, float(r)).alias("_cy")).select("*", cover(lo, float(r)).alias("_cx"))
    other = right.withColumns({"_cls": jn._bucket(c(rank), width), "_cy": jn._bucket(c(ra), float(r)), "_cx": jn._bucket(c(ro), float(r))})
    if rank != rt:
        probe = probe.select("*", F.explode(F.sequence(jn._bucket(c(lt) - lit(back), back), jn._bucket(c(lt), back))).alias("_ct"))
        other, keys = other.withColumn("_ct", jn._bucket(c(rt), back)), [*keys, "_ct"]
    return probe.join(other, keys).where(inside).drop(*keys)


def top_k_within(left: DataFrame, right: DataFrame, ids: Sequence[str], k: int, time: tuple, box: tuple, rank: str, width: float, ties: Sequence[Column] = ()) -> DataFrame:
    """The k right rows of largest `rank` (then `ties`) inside each left row's window, with their place `rk` from 1.

    `width` is the width of a rank class: small enough that a class holds few rows of a window, wide enough that there are few classes.
    Left rows without a row in their window are absent. Before the shuffle Spark keeps at most k rows per left row and task.
    """
    order = W.partitionBy(*ids).orderBy(F.desc(rank), *ties)
    return candidates(left, right, k, time, box, rank, width).withColumn("rk", F.row_number().over(order)).where(c("rk") <= k)
