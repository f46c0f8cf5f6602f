"""Range, existence, as-of, nearest and neighbour joins.

A bare range condition is planned as a nested loop. These helpers turn it into an equi join on coarse keys (one bucket
per row on the right, the covered buckets per row on the left) with the exact condition as the residual filter.
No helper asks for a broadcast: Spark picks one only when the measured size allows it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import spatial as sp
from .ordered import carry_forward

EDGE = 1e-9


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def _cover(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(_bucket(lo, width), _bucket(hi, width)))


def _between(x: Column, lo: Column, hi: Column, closed: str) -> Column:
    left = x >= lo if closed in ("both", "left") else x > lo
    right = x <= hi if closed in ("both", "right") else x < hi
    return left & right


def range_join(left: DataFrame, right: DataFrame, *, on: Sequence[str] = (), time: tuple | None = None,
               closed: str = "both", box: tuple | None = None, salt: int = 1, time_bucket: float | None = None,
               residual: Column | None = None) -> DataFrame:
    """Inner join of left and right rows that are close in time and/or space.

    time = (left_t, right_t, lo, hi): left_t + lo .. left_t + hi holds right_t (bounds per `closed`).
    box  = (left_lat, left_lon, right_lat, right_lon, r): both differences at most r.
    salt > 1 splits a hot right bucket over that many tasks and repeats the left rows for it.
    Column names of the two sides must differ except for `on`.
    """
    keys, conds = list(on), []
    if time:
        lt, rt, lo, hi = time
        width = time_bucket or max(float(hi) - float(lo), 1e-9)
        left = left.select("*", _cover(F.col(lt) + F.lit(lo), F.col(lt) + F.lit(hi), width).alias("_bt"))
        right = right.withColumn("_bt", _bucket(F.col(rt), width))
        keys.append("_bt")
        conds.append(_between(F.col(rt), F.col(lt) + F.lit(lo), F.col(lt) + F.lit(hi), closed))
    if box:
        la, lo_, ra, ro, r = box
        for tag, lc, rc in (("_by", la, ra), ("_bx", lo_, ro)):
            left = left.select("*", _cover(F.col(lc) - F.lit(r + EDGE), F.col(lc) + F.lit(r + EDGE), r).alias(tag))
            right = right.withColumn(tag, _bucket(F.col(rc), r))
            keys.append(tag)
            conds.append(F.abs(F.col(lc) - F.col(rc)) <= F.lit(float(r)))
    if salt > 1:
        left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt"))
        right = right.withColumn("_salt", F.pmod(F.xxhash64(*right.columns), F.lit(salt)).cast("int"))
        keys.append("_salt")
    out = left.join(right, keys)
    if residual is not None:
        conds.append(residual)
    if conds:
        out = out.where(reduce(lambda a, b: a & b, conds))
    return out.drop("_bt", "_by", "_bx", "_salt")


def exists_within(left: DataFrame, right: DataFrame, ids: Sequence[str], *, time: tuple, box: tuple,
                  closed: str = "both", weight: tuple | None = None) -> DataFrame:
    """Ids of left rows that have at least one right row in their time window and box.

    weight = (left_col, right_col) adds right_col >= left_col. Two steps keep crowded places cheap: a table of
    small bins with their largest weight answers every row that has a sufficient bin wholly inside its window;
    only the rows left open meet single right rows. Both steps are exact, so is their union.
    """
    lt, rt, lo, hi = time
    la, lo_, ra, ro, r = box
    lw, rw = weight or (None, None)
    r = float(r)
    hs, ht = r / 2, (hi - lo) / 2
    wt = F.col(rw) if rw else F.lit(0.0)
    bins = (right.select(_bucket(F.col(rt), ht).alias("_bt"), _bucket(F.col(ra), hs).alias("_by"),
                         _bucket(F.col(ro), hs).alias("_bx"), wt.alias("_w"))
            .groupBy("_bt", "_by", "_bx").agg(F.max("_w").alias("_w")))

    def inside(c: Column, low: Column, high: Column, width: float) -> Column:
        first = F.ceil((low + F.lit(EDGE)) / F.lit(width)).cast("long")
        last = (F.floor((high - F.lit(EDGE)) / F.lit(width)) - 1).cast("long")
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    probe = left.select(*ids, *( [F.col(lw).alias("_thr")] if lw else []), F.col(lt).alias("_t"),
                        F.col(la).alias("_y"), F.col(lo_).alias("_x"))
    probe = probe.select("*", inside(F.col("_t"), F.col("_t") + F.lit(lo), F.col("_t") + F.lit(hi), ht).alias("_bt"))
    for tag, c in (("_by", "_y"), ("_bx", "_x")):
        probe = probe.select("*", inside(F.col(c), F.col(c) - F.lit(r), F.col(c) + F.lit(r), hs).alias(tag))
    sure = probe.join(bins, ["_bt", "_by", "_bx"])
    if lw:
        sure = sure.where(F.col("_w") >= F.col("_thr"))
    sure = sure.select(*ids).distinct()
    open_rows = left.join(sure, list(ids), "left_anti")
    names = {c: f"_r_{c}" for c in right.columns}
    other = right.select(*[F.col(c).alias(n) for c, n in names.items()])
    pairs = range_join(open_rows, other, time=(lt, names[rt], lo, hi), closed=closed,
                       box=(la, lo_, names[ra], names[ro], r),
                       residual=F.col(names[rw]) >= F.col(lw) if lw else None)
    return sure.unionByName(pairs.select(*ids)).distinct()


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_t: str, right_t: str, cols: Sequence[str],
              strict: bool = False, tolerance: float | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Each left row with the latest right row at or before it (strictly before with `strict`)."""
    payload = F.struct(F.col(right_t).alias("t"), *[F.col(c).alias(c) for c in cols])
    keep = [c for c in left.columns if c not in by and c != left_t]
    a = left.select(*by, F.col(left_t).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
                    F.struct(*[F.col(c).alias(c) for c in keep]).alias("_left") if keep else F.lit(1).alias("_left"))
    b = right.select(*by, F.col(right_t).alias("_t"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    done = carry_forward(both, by, "_t", ["_side"], {"_hit": F.col("_right")}).where(F.col("_left").isNotNull())
    hit = F.col("_hit")
    if tolerance is not None:
        hit = F.when(F.col("_t") - hit["t"] <= F.lit(tolerance), hit)
    return done.select(*by, F.col("_t").alias(left_t), *[F.col("_left")[c].alias(c) for c in keep],
                       hit["t"].alias(right_t), *[hit[c].alias(c) for c in cols])


def neighbours(df: DataFrame, i: str = "ci", j: str = "cj", k: int = 1, include_self: bool = False) -> DataFrame:
    """Each row repeated for the cells around it; `ni`, `nj` name the neighbour."""
    offs = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if include_self or (a, b) != (0, 0)]
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offs])
    return (df.withColumn("_o", F.explode(arr))
            .withColumn("ni", F.col(i) + F.col("_o.a")).withColumn("nj", F.col(j) + F.col("_o.b")).drop("_o"))


def nearest_join(left: DataFrame, right: DataFrame, ids: Sequence[str], left_pos: tuple, right_pos: tuple,
                 right_id: str, max_distance: float, metric, how: str = "inner") -> DataFrame:
    """Nearest right row within `max_distance` degrees; ties go to the smaller id.

    Equal positions on the right are collapsed to the smallest id before the join.
    """
    la, lo = left_pos
    ra, ro = right_pos
    spots = right.groupBy(ra, ro).agg(F.min(right_id).alias(right_id))
    # the metric shrinks longitude by cos(lat) of the left row: its reach in longitude grows towards the poles
    width = float(max_distance)
    reach = F.least(F.lit(width) / F.greatest(F.cos(F.radians(F.col(la))), F.lit(1e-9)), F.lit(360.0))
    probe = left.select(*ids, la, lo)
    probe = probe.select("*", _cover(F.col(la) - F.lit(width), F.col(la) + F.lit(width), width).alias("_by"))
    probe = probe.select("*", _cover(F.col(lo) - reach, F.col(lo) + reach, width).alias("_bx"))
    spots = spots.withColumn("_by", _bucket(F.col(ra), width)).withColumn("_bx", _bucket(F.col(ro), width))
    d = metric(F.col(la), F.col(lo), F.col(ra), F.col(ro))
    best = (probe.join(spots, ["_by", "_bx"]).withColumn("_d", d).where(F.col("_d") <= F.lit(width))
            .groupBy(*ids).agg(F.min(F.struct(F.col("_d").alias("distance"), F.col(right_id))).alias("_m"))
            .select(*ids, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.distance").alias("distance")))
    return left.join(best, list(ids), how)


def within_km(events: DataFrame, stations: DataFrame, km: float) -> DataFrame:
    """(event, station) pairs, positions lat, lon and slat, slon, at most `km` apart. Every event has its own reach in longitude, which grows with its latitude."""
    deg = km / sp.DEG_KM
    wide = F.least(F.lit(deg) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-9)), F.lit(360.0))
    band = lambda x, r: F.sequence(F.floor((x - r) / F.lit(deg) - F.lit(1e-9)).cast("long"), F.floor((x + r) / F.lit(deg) + F.lit(1e-9)).cast("long"))
    e = events.select("*", F.explode(band(F.col("lat"), F.lit(deg))).alias("_y")).select("*", F.explode(band(F.col("lon"), wide)).alias("_x"))
    s = stations.withColumns({"_y": F.floor(F.col("slat") / F.lit(deg)).cast("long"), "_x": F.floor(F.col("slon") / F.lit(deg)).cast("long")})
    return e.join(s, ["_y", "_x"]).withColumn("km", sp.flat_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))).where(F.col("km") <= km).drop("_y", "_x")


def _reach(left: DataFrame, spots: DataFrame, ids: Sequence[str], k: int, km: float, box: tuple, pos: tuple, grid: float, levels: int) -> DataFrame:
    """`left` with `_km`: a distance within which k spots are known to lie, `km` where none is known.

    Whole cells of `grid` degrees inside the limits give a bound per cell of the left side. Where a left row's own cell is crowded, the finest
    halving of it that still holds k spots gives a closer one. Parallels are longest at the equator, so the corners of cells bound what they hold.
    """
    la, lo, ra, ro = pos
    col, lit, deg = F.col, F.lit, math.radians(sp.EARTH_RADIUS_KM)
    cells = spots.groupBy(_bucket(col(ra), grid).alias("_y"), _bucket(col(ro), grid).alias("_x")).agg(F.count(lit(1)).alias("_n"))
    left = left.withColumns({"_cy": _bucket(col(la), grid), "_cx": _bucket(col(lo), grid)})
    met = left.select("_cy", "_cx").distinct()
    for at, step, b in (("_cy", "_dy", box[0]), ("_cx", "_dx", box[1])):
        most = int(min(b, km / deg) / grid + EDGE) - 1
        met = met.withColumn(step, F.explode(F.sequence(lit(-most), lit(most))))
    met = met.withColumn("_d", lit(deg * grid) * F.hypot(F.abs("_dy") + 1, F.abs("_dx") + 1)).where(col("_d") <= lit(float(km)))
    met = met.withColumns({"_y": col("_cy") + col("_dy"), "_x": col("_cx") + col("_dx")}).join(cells, ["_y", "_x"])
    outwards = W.partitionBy("_cy", "_cx").orderBy("_d")  # the cells around one cell: bounded by the grid
    own = F.when((col("_dy") == 0) & (col("_dx") == 0), col("_n"))
    met = met.withColumn("_m", F.sum("_n").over(outwards)).groupBy("_cy", "_cx").agg(F.min(F.when(col("_m") >= k, col("_d"))).alias("_km"), F.max(own).alias("_own"))
    left = left.join(met, ["_cy", "_cx"], "left")
    place = lambda y, x: F.inline(F.array(*[F.struct(lit(i).alias("_l"), _bucket(col(y), grid / 2 ** i).alias("_y"), _bucket(col(x), grid / 2 ** i).alias("_x")) for i in range(1, levels + 1)]))
    crowds = spots.select(place(ra, ro)).groupBy("_l", "_y", "_x").agg(F.count(lit(1)).alias("_n")).where(col("_n") >= k).drop("_n")
    row = [*ids, la, lo]
    fine = left.where(col("_own") >= 4 * k).select(*row, place(la, lo)).join(crowds, ["_l", "_y", "_x"], "left_semi").groupBy(*row).agg(F.max("_l").alias("_l"))
    diagonal = lit(deg * grid * math.sqrt(2.0)) / F.pow(lit(2.0), col("_l"))
    return left.join(fine, row, "left").withColumn("_km", F.least("_km", diagonal, lit(float(km)))).drop("_cy", "_cx", "_own", "_l")


def nearest_k(left: DataFrame, right: DataFrame, ids: Sequence[str], k: int, km: float, box: tuple, pos: tuple, right_id: str,
              grid: float = 0.25, levels: int = 8) -> DataFrame:
    """The k nearest right rows (great circle, ties to the smaller id) of each left row, at most `km` and `box` degrees away, with `km` and their place `rk`.

    box = (latitude, longitude), pos = (left_lat, left_lon, right_lat, right_lon). Left rows without a right row in reach are absent. A first bound
    on the k-th distance decides how far a row searches and in cells of which size, so crowded places cost no more than others.
    """
    la, lo, ra, ro = pos
    col, lit = F.col, F.lit
    same = W.partitionBy(ra, ro).orderBy(right_id)  # of rows at one position only the first k can be among the nearest
    spots = right.withColumn("_same", F.row_number().over(same)).where(col("_same") <= k).drop("_same")
    probe = _reach(left, spots, ids, k, km, box, pos, grid, levels)
    wide, angle = float(max(box)), (col("_km") + lit(1e-6)) / lit(sp.EARTH_RADIUS_KM)
    up = F.least(F.degrees(angle), lit(float(box[0]))) + lit(EDGE)
    slant = F.sin(angle) / F.greatest(F.cos(F.radians(col(la))), lit(1e-12))
    side = F.least(F.when((F.abs(F.radians(col(la))) + angle < lit(math.pi / 2)) & (slant < 1), F.degrees(F.asin(F.least(slant, lit(1.0))))).otherwise(lit(float(box[1]))), lit(float(box[1]))) + lit(EDGE)
    finest = math.ceil(math.log2(wide / grid)) + levels
    probe = probe.withColumns({"_up": up, "_side": side, "_l": F.least(F.greatest(F.floor(F.log2(lit(wide) / up)), lit(0)), lit(finest)).cast("int")})
    size = lambda: lit(wide) / F.pow(lit(2.0), col("_l"))
    for tag, x, r in (("_y", la, "_up"), ("_x", lo, "_side")):
        cell = lambda v: F.floor(v / size()).cast("long")
        probe = probe.withColumn(tag, F.explode(F.sequence(cell(col(x) - col(r)), cell(col(x) + col(r)))))
    spots = spots.withColumn("_l", F.explode(F.sequence(lit(0), lit(finest)))).withColumns({tag: F.floor(col(x) / size()).cast("long") for tag, x in (("_y", ra), ("_x", ro))})
    near = (F.abs(col(la) - col(ra)) <= lit(float(box[0]))) & (F.abs(col(lo) - col(ro)) <= lit(float(box[1])))
    pairs = probe.join(spots, ["_l", "_y", "_x"]).where(near & (F.abs(col(la) - col(ra)) <= col("_up")) & (F.abs(col(lo) - col(ro)) <= col("_side")))
    pairs = pairs.withColumn("km", sp.haversine_km(col(la), col(lo), col(ra), col(ro))).where(col("km") <= lit(float(km)))
    order = W.partitionBy(*ids).orderBy("km", right_id)  # Spark keeps at most k rows per left row and task before the shuffle
    return pairs.withColumn("rk", F.row_number().over(order)).where(col("rk") <= k).drop("_l", "_y", "_x", "_up", "_side", "_km")
