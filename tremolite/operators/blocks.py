"""Sums over all events near a target in time and place, without a row per pair.

Targets and events are filed under coarse cells of time and place and packed into array rows of bounded size. A target goes to every cell its
window touches, an event to its own. Blocks of one cell meet in a join; pairs live only as small matrices inside a task, and one row of sums per
target and block leaves it. Sums of blocks add up, so a crowded cell is simply several blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import spatial as sp

c, lit = F.col, F.lit
DAY = 86400
EDGE = 1e-9
BLOCK = 8192
CHUNK = 128


def _packed(rows: DataFrame, cells: list[str], first: str, block: int) -> DataFrame:
    """One row per cell and block, every column an array; a block is in the order of `first`."""
    cols = [first, *[x for x in rows.columns if x not in (*cells, first)]]
    count = rows.groupBy(*cells).agg(F.ceil(F.count(lit(1)) / lit(float(block))).alias("_nb"))
    rows = rows.join(count, cells).withColumn("_blk", F.pmod(F.xxhash64(*cols), c("_nb")))
    packed = rows.groupBy(*cells, "_blk").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_r"))
    return packed.select(*cells, *[c(f"_r.{x}").alias(x) for x in cols])


def _meetings(targets: DataFrame, events: DataFrame, days: float, radius: float, block: int) -> DataFrame:
    """Blocks of targets (their columns) beside the blocks of events (prefix e_) that their windows may reach."""
    cells = ["_bt", "_by", "_bx"]
    wide, step = days * DAY / 2, radius / 2
    at = lambda x, w: F.floor(x / lit(float(w))).cast("long")
    cover = lambda lo, hi, w: F.explode(F.sequence(at(lo, w), at(hi, w)))
    e = events.select(*[c(x).alias(f"e_{x}") for x in events.columns])
    e = e.withColumns({"_bt": at(c("e_t"), wide), "_by": at(c("e_lat"), step), "_bx": at(c("e_lon"), step)})
    # cells without an event get no targets
    used = e.select(*cells).distinct()
    t = targets.select("*", cover(c("t") - lit(days * DAY), c("t"), wide).alias("_bt"))
    for tag, x in (("_by", "lat"), ("_bx", "lon")):
        t = t.select("*", cover(c(x) - lit(radius + EDGE), c(x) + lit(radius + EDGE), step).alias(tag))
    t = t.join(used, cells, "left_semi")
    return _packed(t, cells, "t", block).join(_packed(e, cells, "e_t", block), cells).drop(*cells)


def _span(at: np.ndarray, values: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place in the sorted `values` that is within `radius` of each `at`, by the rounded difference as SQL takes it."""
    a, b = np.searchsorted(values, at - radius - EDGE), np.searchsorted(values, at + radius + EDGE)
    while True:
        far = a < b
        far[far] = at[far] - values[a[far]] > radius
        if not far.any():
            break
        a += far
    while True:
        far = a < b
        far[far] = values[b[far] - 1] - at[far] > radius
        if not far.any():
            break
        b -= far
    return a, b


class _Box:
    """Which events of a block lie in the boxes of some targets: comparisons of small whole numbers, the places among the distinct values."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, e_lat: np.ndarray, e_lon: np.ndarray, radius: float):
        kind = np.uint16 if len(e_lat) < 65535 else np.uint32
        self.whole, self.none, self.sides = True, False, []
        for at, x in ((lat, e_lat), (lon, e_lon)):
            values, place = np.unique(x, return_inverse=True)
            a, b = _span(at, values, radius)
            self.whole = self.whole & (a == 0) & (b == len(values))
            self.none = self.none | (a >= b)
            self.sides.append((place.astype(kind), a.astype(kind), (b - a).astype(kind)))

    def mask(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        # wrapped around, a place before the first is a large number
        one, two = ((place[None, lo:hi] - a[rows, None]) < n[rows, None] for place, a, n in self.sides)
        return one & two


def _classes(edges: np.ndarray, values: Sequence[np.ndarray], n: np.ndarray, sums: list, least: list) -> None:
    """Adds up the runs between neighbouring `edges` (one row per target, not decreasing), run by run into n, sums and least."""
    k, w = edges.shape
    n += np.diff(edges, axis=1)
    empty = np.diff(edges, axis=1) == 0
    flat = edges.ravel()
    for i, x in enumerate(values):
        padded = np.append(x, 0.0)  # the last edge may be the end
        for f, none, into in ((np.add, 0.0, sums[i]), (np.minimum, np.inf, least[i])):
            got = f.reduceat(padded, flat).reshape(k, w)[:, :-1]
            into[...] = f(into, np.where(empty, none, got))


def _window_kernel(ids: Sequence[str], windows: Sequence[float], radius: float, values: Sequence[str]):
    back = np.array([d * DAY for d in sorted(windows, reverse=True)] + [0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                t, e_t = np.asarray(row.t), np.asarray(row.e_t)
                vals = [np.asarray(getattr(row, f"e_{x}"), dtype=float) for x in values]
                box = _Box(*(np.asarray(x) for x in (row.lat, row.lon, row.e_lat, row.e_lon)), radius)
                edges = np.searchsorted(e_t, t[:, None] - back[None, :])  # before t, at or after t - window
                k, w = edges.shape
                n, sums, least = np.zeros((k, w - 1), dtype=np.int64), np.zeros((len(vals), k, w - 1)), np.full((len(vals), k, w - 1), np.inf)
                some = ~box.none & (edges[:, 0] < edges[:, -1])
                for rows in np.array_split(np.flatnonzero(some & box.whole), max(1, len(t) // CHUNK)):
                    part = n[rows], [s[rows] for s in sums], [m[rows] for m in least]
                    _classes(edges[rows], vals, *part)
                    n[rows] = part[0]
                    for i in range(len(vals)):
                        sums[i, rows], least[i, rows] = part[1][i], part[2][i]
                cut = np.flatnonzero(some & ~box.whole)  # in the order of time, so a chunk reads a stretch of the block
                for rows in (cut[i:i + CHUNK] for i in range(0, len(cut), CHUNK)):
                    lo, hi = int(edges[rows, 0].min()), int(edges[rows, -1].max())
                    mask = box.mask(rows, lo, hi)
                    hits = np.flatnonzero(mask)
                    place = np.searchsorted(hits, (np.arange(len(rows)) * (hi - lo))[:, None] + edges[rows] - lo)
                    part = n[rows], [s[rows] for s in sums], [m[rows] for m in least]
                    _classes(place, [np.broadcast_to(x[lo:hi], mask.shape)[mask] for x in vals], *part)
                    n[rows] = part[0]
                    for i in range(len(vals)):
                        sums[i, rows], least[i, rows] = part[1][i], part[2][i]
                # the runs end at t, so a window is the sum of its runs; windows from the shortest
                n, found = np.cumsum(n[:, ::-1], axis=1), np.flatnonzero(n.any(axis=1))
                out = {x: np.asarray(getattr(row, x))[found] for x in ids}
                for j in range(w - 1):
                    out[f"n{j}"] = n[found, j]
                for i in range(len(vals)):
                    total, low = np.cumsum(sums[i][:, ::-1], axis=1), np.minimum.accumulate(least[i][:, ::-1], axis=1)
                    for j in range(w - 1):
                        out[f"s{i}_{j}"], out[f"m{i}_{j}"] = total[found, j], low[found, j]
                yield pd.DataFrame(out)
    return run


def window_sums(targets: DataFrame, events: DataFrame, ids: Sequence[str], windows: Sequence[float], radius: float, values: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Per target, and for each window of days before it, the events in [t - days, t) at most `radius` degrees away in latitude and in longitude.

    Targets have t, lat, lon and the key `ids`; events t, lat, lon and the doubles `values`. The result has `ids`, n<days> and per value
    sum_<value><days> and min_<value><days> (null where n<days> is 0). Targets without an event in the longest window are absent.
    """
    days = sorted(windows)
    types = dict(targets.dtypes)
    schema = [f"{x} {types[x]}" for x in ids] + [f"n{j} long" for j in range(len(days))]
    schema += [f"{k}{i}_{j} double" for i in range(len(values)) for j in range(len(days)) for k in "sm"]
    met = _meetings(targets.select(*ids, "t", "lat", "lon"), events, float(days[-1]), float(radius), block)
    parts = met.mapInPandas(_window_kernel(list(ids), days, float(radius), list(values)), ", ".join(schema))
    aggs = [F.sum(f"n{j}").alias(f"n{d}") for j, d in enumerate(days)]
    for i, x in enumerate(values):
        for j, d in enumerate(days):
            any_ = F.sum(f"n{j}") > 0
            aggs += [F.when(any_, F.sum(f"s{i}_{j}")).alias(f"sum_{x}{d}"), F.when(any_, F.min(f"m{i}_{j}")).alias(f"min_{x}{d}")]
    return parts.groupBy(*ids).agg(*aggs)


def _stress_kernel(ids: Sequence[str], days: float, radius: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                t, lat, lon, depth = (np.asarray(x) for x in (row.t, row.lat, row.lon, row.depth_km))
                e_t, e_lat, e_lon, e_depth, e_mag = (np.asarray(x) for x in (row.e_t, row.e_lat, row.e_lon, row.e_depth_km, row.e_mag))
                box = _Box(lat, lon, e_lat, e_lon, radius)
                metres = sp.DEG_KM * np.cos(np.radians(e_lat)) * 1000.0
                size = np.power(10.0, 1.5 * e_mag + 9.05) / (8 * math.pi) / 1000.0
                a, b = np.searchsorted(e_t, t - days * DAY), np.searchsorted(e_t, t)
                n, kpa = np.zeros(len(t), dtype=np.int64), np.zeros(len(t))
                some = np.flatnonzero(~box.none & (a < b))
                for rows in (some[i:i + CHUNK] for i in range(0, len(some), CHUNK)):
                    # columns in slices that stay in the cache
                    for lo in range(int(a[rows].min()), int(b[rows].max()), 1024):
                        hi = min(lo + 1024, int(b[rows].max()))
                        place = np.arange(lo, hi)
                        near = box.mask(rows, lo, hi) & (place >= a[rows, None]) & (place < b[rows, None])
                        n[rows] += near.sum(axis=1)
                        dx = (lon[rows, None] - e_lon[None, lo:hi]) * metres[None, lo:hi]
                        dy = (lat[rows, None] - e_lat[None, lo:hi]) * (sp.DEG_KM * 1000.0)
                        dz = (depth[rows, None] - e_depth[None, lo:hi]) * 1000.0
                        square = dx * dx + dy * dy + dz * dz
                        r = np.sqrt(square)
                        near &= r >= 500
                        kpa[rows] += np.divide(size[None, lo:hi], square * r, out=np.zeros_like(r), where=near).sum(axis=1)
                found = np.flatnonzero(n)
                yield pd.DataFrame({**{x: np.asarray(getattr(row, x))[found] for x in ids}, "n_sources": n[found], "kpa": kpa[found]})
    return run


def stress_sums(targets: DataFrame, sources: DataFrame, ids: Sequence[str], max_km: float = 500.0, max_years: float = 10.0, block: int = BLOCK) -> DataFrame:
    """Per target the number of earlier sources in its box and the sum of their stress changes in kPa (`physics.stress_change`)."""
    types, days, radius = dict(targets.dtypes), max_years * 365.25, max_km / sp.DEG_KM
    where = ["t", "lat", "lon", "depth_km"]
    met = _meetings(targets.select(*ids, *where), sources.select(*where, "mag", *[x for x in ["event_id"] if x in sources.columns]), days, radius, block)
    parts = met.mapInPandas(_stress_kernel(list(ids), days, radius), ", ".join([*[f"{x} {types[x]}" for x in ids], "n_sources long", "kpa double"]))
    return parts.groupBy(*ids).agg(F.sum("n_sources").alias("n_sources"), F.sum("kpa").alias("kpa"))
