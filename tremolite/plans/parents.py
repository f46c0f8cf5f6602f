"""Nearest parent of every event by branch and bound over blocks of the catalogue.

The rescaled distance of a child to an earlier event is dt * r^d_frac * 10^(-b M). Events lie in blocks (time bucket,
magnitude class, cells between quantiles of time, latitude and longitude) of about `size` events, and neighbouring blocks of a
bucket form groups of at most about `group` events. A block's corners and its largest magnitude bound the distance from below,
a few large events per bucket bound it from above; only blocks that some block of a group cannot rule out move to the group,
once for all its children. There the candidates lie in slabs of consecutive events, longer with age, each with boxes
over its places and magnitudes; a child opens only boxes that its best so far cannot rule out. Bounds are over all events:
nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import spatial as sp
from ..operators import sinks as sk

c, lit = F.col, F.lit
DAY = 86400
CUTS = 16  # quantiles per axis, so a bucket and class has up to 4,096 cells
SEEDS = 128  # events per bucket that give the first upper bounds
GROUP = 1 << 18  # children of a task's group
BATCH = 1 << 20  # candidates that a task holds at once
LEAF, FAN = 16, 4  # events of a smallest box, boxes in the next larger one
CHILDREN, BOXES = 512, 4096  # children searched together, smallest boxes opened together
SLACK = 1 - 1e-9  # a bound and a distance may round differently

_ROWS = ["t", "event_id", "lat", "lon", "mag"]
_FOUND = "event_id long, eta double, parent_t double, parent_id long, parent_mag double, dt_days double, dist_km double, evaluated long"
_BOX = ["t0", "t1", "lat0", "lat1", "lon0", "lon1", "top"]


def _quantiles(df: DataFrame, keys: list[str], axes: list[str], side) -> DataFrame:
    """Rows with their place between quantiles of each axis, `side` places per axis and key."""
    cuts = [F.percentile_approx(x, [i / CUTS for i in range(1, CUTS)], 1000).alias(f"q_{x}") for x in axes]
    place = lambda x: F.floor(F.size(F.filter(f"q_{x}", lambda q: q < c(x))) * c("side") / lit(CUTS))
    j = df.join(df.groupBy(*keys).agg(*cuts, F.least(F.ceil(side), lit(CUTS)).alias("side")), keys)
    return j.select(*df.columns, *[place(x).alias(f"c_{x}") for x in axes])


def _dealt(df: DataFrame, cell: list[str], weight, limit: int, key: str) -> DataFrame:
    """A cell that is still crowded (one spot, one moment) is dealt by a hash."""
    parts = df.groupBy(*cell).agg(F.ceil(F.sum(weight) / lit(float(limit))).alias("parts"))
    # the quantiles may come out otherwise when they are computed again: a cell unknown there stays whole
    return df.join(parts, cell, "left").withColumn("part", F.pmod(F.xxhash64(key), F.coalesce("parts", lit(1)))).drop("parts")


def _blocks(events: DataFrame, width: float, size: int) -> DataFrame:
    """One row per block: its events as arrays in time order, its corners and its largest event."""
    e = events.select("event_id", *[F.nanvl(c(x).cast("double"), lit(None)).alias(x) for x in ("t", "lat", "lon", "mag")]).dropna(subset=["t", "lat", "lon"])
    e = e.withColumns({"tb": F.floor(c("t") / lit(width)), "mc": F.coalesce(F.floor("mag"), lit(-99))})
    e = _quantiles(e, ["tb", "mc"], ["t", "lat", "lon"], F.cbrt(F.count(lit(1)) / lit(float(size))))
    cell = ["tb", "mc", "c_t", "c_lat", "c_lon"]
    e = _dealt(e, cell, lit(1), size, "event_id")
    span = [f(x).alias(f"{x}{n}") for x in ("t", "lat", "lon") for n, f in ((0, F.min), (1, F.max))]
    g = e.groupBy(*cell, "part").agg(F.sort_array(F.collect_list(F.struct(*_ROWS))).alias("r"), *span, F.max("mag").alias("top"),
                                     F.max(F.struct("mag", "t", "event_id", "lat", "lon")).alias("largest"))
    return g.select("tb", F.monotonically_increasing_id().alias("block"), c("r.t").alias("t"), c("r.event_id").alias("id"), c("r.lat").alias("lat"), c("r.lon").alias("lon"), c("r.mag").alias("mag"),
                    *_BOX, "largest")


def _groups(blocks: DataFrame, group: int) -> DataFrame:
    """The group of each block: neighbours in latitude and longitude within a bucket. Groups whose hash is equal become one."""
    b = blocks.select("tb", "block", F.size("t").alias("n"), ((c("lat0") + c("lat1")) / 2).alias("lat"), ((c("lon0") + c("lon1")) / 2).alias("lon"), *_BOX)
    b = _quantiles(b, ["tb"], ["lat", "lon"], F.sqrt(F.ceil(F.sum("n") / lit(float(group)))))
    cell = ["tb", "c_lat", "c_lon"]
    return _dealt(b, cell, c("n"), group, "block").select("tb", "block", F.xxhash64(*cell, "part").alias("grp"), *_BOX)


class _Rescaled:
    """The rescaled distance between arrays of children and arrays of parents, and its bounds for boxes."""

    def __init__(self, max_days: float, b: float, d_frac: float):
        self.max_days, self.b, self.d_frac = max_days, b, d_frac

    def pairs(self, t, lat, lon, p_t, p_lat, p_lon, p_mag):
        dt = (t - p_t) / DAY
        dy = (lat - p_lat) * sp.DEG_KM
        dx = (lon - p_lon) * sp.DEG_KM * np.cos(np.radians(lat))
        r = np.sqrt(dy * dy + dx * dx) + 0.1
        eta = np.where((dt > 0) & (dt <= self.max_days), np.abs(dt) * r ** self.d_frac * 10.0 ** (-self.b * p_mag), np.inf)
        return eta, dt, r

    def least(self, child, box):
        """For each child box and box of candidates: no pair is nearer than this; infinite where all are too late or too old."""
        t0, t1, lat0, lat1, lon0, lon1, _ = (x[:, None] for x in child)
        b_t0, b_t1, b_lat0, b_lat1, b_lon0, b_lon1, top = (x[None, :] for x in box)
        dt = np.maximum(0.0, (t0 - b_t1) / DAY)
        dy = np.maximum(0.0, np.maximum(b_lat0 - lat1, lat0 - b_lat1)) * sp.DEG_KM
        narrow = np.minimum(np.cos(np.radians(lat0)), np.cos(np.radians(lat1)))
        dx = np.maximum(0.0, np.maximum(b_lon0 - lon1, lon0 - b_lon1)) * sp.DEG_KM * narrow
        low = dt * (np.sqrt(dy * dy + dx * dx) + 0.1) ** self.d_frac * 10.0 ** (-self.b * top) * SLACK
        return np.where((t1 > b_t0) & (dt * SLACK <= self.max_days), low, np.inf)

    def most(self, child, t, lat, lon, mag):
        """For each child box: every child has a parent at most this far among the given events; infinite where none serves all."""
        t0, t1, lat0, lat1, lon0, lon1, _ = (x[:, None] for x in child)
        dt = (t1 - t) / DAY
        dy = np.maximum(np.abs(lat0 - lat), np.abs(lat1 - lat)) * sp.DEG_KM
        wide = np.cos(np.radians(np.where(lat0 * lat1 < 0, 0.0, np.minimum(np.abs(lat0), np.abs(lat1)))))
        dx = np.maximum(np.abs(lon0 - lon), np.abs(lon1 - lon)) * sp.DEG_KM * wide
        high = dt * (np.sqrt(dy * dy + dx * dx) + 0.1) ** self.d_frac * 10.0 ** (-self.b * mag) / SLACK
        return np.where((t < t0) & (dt <= self.max_days * SLACK), high, np.inf).min(axis=1, initial=np.inf)


def _routed(kernel: _Rescaled):
    """Pairs (group, block of another group) that some block of the group cannot rule out, with the smallest bound."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.grp == r.p_grp:
                    continue
                box, seeds = [getattr(r, f"p_{x}") for x in _BOX], (r.s_t, r.s_lat, r.s_lon, r.s_mag)
                least = np.full(len(r.p_block), np.inf)
                for lo in range(0, len(r.t0), 256):
                    child = [getattr(r, x)[lo:lo + 256] for x in _BOX]
                    low = kernel.least(child, box)
                    least = np.minimum(least, np.where(low <= kernel.most(child, *seeds)[:, None], low, np.inf).min(axis=0))
                hit = np.isfinite(least)
                yield pd.DataFrame({"grp": np.full(hit.sum(), r.grp), "block": r.p_block[hit], "low": least[hit]})
    return run


def _spread(x):
    """Bits of 16-bit numbers at every second place."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << shift)) & mask
    return x


class _Slabs:
    """Candidates in time order. Level j cuts them into slabs of LEAF * FAN^(j+1) events; inside a slab they lie by magnitude
    class and along a curve through the map, and boxes of LEAF, LEAF * FAN, ... events hold corners and the least weight."""

    def __init__(self, kernel: _Rescaled, t, ids, lat, lon, mag):
        by_time = np.lexsort((ids, t))
        self.kernel, (self.t, self.id, self.lat, self.lon, self.mag) = kernel, (x[by_time] for x in (t, ids, lat, lon, mag))
        n = len(t)
        rank = lambda x: np.argsort(np.argsort(x, kind="stable"), kind="stable")
        curve = _spread(rank(self.lat) * 65535 // n) | (_spread(rank(self.lon) * 65535 // n) << 1)
        place = rank((np.clip(np.floor(self.mag / 2), -500, 500).astype(np.int64) << 32) + curve)
        weight = 10.0 ** (-kernel.b * self.mag / kernel.d_frac)
        self.levels, size = [], LEAF * FAN
        while True:
            order = np.argsort(np.arange(n) // size * n + place, kind="stable").astype(np.int32)
            cut = lambda x, fill: np.concatenate([x[order], np.full(-n % size, fill)]).reshape(-1, LEAF)
            events = np.stack([cut(self.lat, np.inf), cut(self.lon, np.inf), cut(weight, np.inf)], axis=1)
            boxes = [np.stack([events[:, 0].min(1), cut(self.lat, -np.inf).max(1), events[:, 1].min(1), cut(self.lon, -np.inf).max(1), events[:, 2].min(1)], axis=1)]
            while len(boxes[-1]) * LEAF * FAN ** (len(boxes) - 1) // size < len(boxes[-1]):
                parts = boxes[-1].reshape(-1, FAN, 5)
                boxes.append(np.stack([parts[:, :, 0].min(1), parts[:, :, 1].max(1), parts[:, :, 2].min(1), parts[:, :, 3].max(1), parts[:, :, 4].min(1)], axis=1))
            self.levels.append((size, order, events, boxes))
            if size >= n:
                return
            size *= FAN

    def best(self, t, lat, lon, limit):
        """Children that have a parent no farther than `limit`: their numbers, the parent's number and distance; and the evaluated events per child.
        Of equal distances the last candidate wins. `limit` falls to the distance found."""
        k, n, inverse = self.kernel, len(self.t), 1 / self.kernel.d_frac
        seen, found, narrow = np.zeros(len(t), dtype=np.int64), [], np.cos(np.radians(lat))

        def evaluate(child, at):
            eta = k.pairs(t[child], lat[child], lon[child], self.t[at], self.lat[at], self.lon[at], self.mag[at])[0]
            np.minimum.at(limit, child, eta)
            np.add.at(seen, child, 1)
            keep = (eta <= limit[child]) & np.isfinite(eta)
            found.append((child[keep], at[keep], eta[keep]))

        before, oldest = np.searchsorted(self.t, t, "left"), np.searchsorted(self.t, t - k.max_days * DAY - 1e-3, "left")
        size = LEAF * FAN
        at = before[:, None] - 1 - np.arange(size)[None, :]
        child, young = np.nonzero(at >= oldest[:, None])
        evaluate(child, at[child, young])  # the youngest, which the finest slabs need not hold
        end = before // size
        for level, (size, order, events, boxes) in enumerate(self.levels):
            # four to seven slabs of each level, so that a slab is no longer than twice its distance in time; the last level takes the rest
            start = np.maximum(end // FAN - 1, 0) * FAN if level + 1 < len(self.levels) else np.zeros_like(end)
            first = np.maximum(start, oldest // size)
            count = np.maximum(end - first, 0)
            child = np.repeat(np.arange(len(t)), count)
            node = np.arange(len(child)) - np.repeat(np.cumsum(count) - count, count) + first[child]
            end = start // FAN
            if not len(child):
                continue
            age = (t[child] - self.t[np.minimum((node + 1) * size, n) - 1]) / DAY
            reach = (limit[child] / age) ** inverse / SLACK
            for height in range(len(boxes) - 1, -1, -1):
                box, y, x = boxes[height][node], lat[child], lon[child]
                dy = np.maximum(np.maximum(box[:, 0] - y, y - box[:, 1]), 0.0) * sp.DEG_KM
                dx = np.maximum(np.maximum(box[:, 2] - x, x - box[:, 3]), 0.0) * sp.DEG_KM * narrow[child]
                r = reach / box[:, 4] - 0.1 * SLACK
                open_ = (dy * dy + dx * dx <= r * r) & (r >= 0)
                child, node, reach = child[open_], node[open_], reach[open_]
                if height:
                    child, reach, node = np.repeat(child, FAN), np.repeat(reach, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
            for lo in range(0, len(child), BOXES):
                who, leaf = child[lo:lo + BOXES], node[lo:lo + BOXES]
                e = events[leaf]
                dy, dx = (e[:, 0] - lat[who][:, None]) * sp.DEG_KM, (e[:, 1] - lon[who][:, None]) * (sp.DEG_KM * narrow[who])[:, None]
                r = reach[lo:lo + BOXES, None] / e[:, 2] - 0.1 * SLACK
                i, slot = np.nonzero((dy * dy + dx * dx <= r * r) & (r >= 0))
                evaluate(who[i], order[leaf[i] * LEAF + slot])
        child, at, eta = (np.concatenate(x) for x in zip(*found))
        win = np.flatnonzero(eta <= limit[child])
        win = win[np.lexsort((at[win], child[win]))]
        win = win[np.append(child[win][1:] != child[win][:-1], True)] if len(win) else win
        return child[win], at[win], eta[win], seen


class _Visit:
    """The children of one group and the best parents met so far."""

    def __init__(self, kernel: _Rescaled):
        self.kernel, self.own, self.rows, self.held, self.child = kernel, [], [], 0, None

    def add(self, row) -> None:
        if row.low < 0:
            self.own.append(row)
        self.rows.append(row)
        self.held += len(row.t)
        if self.held >= BATCH and row.low >= 0:
            self.meet()

    def meet(self) -> None:
        """Search the candidates held for all children."""
        join = lambda rows: [np.concatenate([getattr(r, x) for r in rows]) for x in ("t", "id", "lat", "lon", "mag")]
        if self.child is None:
            t, ids, lat, lon, _ = join(self.own)
            by_time = np.argsort(t, kind="stable")
            self.child, self.own, n = [x[by_time] for x in (t, ids, lat, lon)], None, len(t)
            self.limit, self.seen, self.eta = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.full(n, np.inf)
            self.p_t, self.p_id, self.p_lat, self.p_lon, self.p_mag = np.full(n, -np.inf), np.full(n, -1, dtype=np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
        held = join(self.rows)
        self.rows, self.held = [], 0
        known = np.isfinite(held[4])  # without a magnitude no event is a parent
        if not known.any():
            return
        slabs = _Slabs(self.kernel, *[x[known] for x in held])
        t, _, lat, lon = self.child
        for lo in range(0, len(t), CHILDREN):
            part = slice(lo, lo + CHILDREN)
            with np.errstate(invalid="ignore", divide="ignore"):
                i, at, eta, seen = slabs.best(t[part], lat[part], lon[part], self.limit[part])
            self.seen[part] += seen
            i = i + lo
            later = (slabs.t[at] > self.p_t[i]) | ((slabs.t[at] == self.p_t[i]) & (slabs.id[at] > self.p_id[i]))
            win = (eta < self.eta[i]) | ((eta == self.eta[i]) & later)
            i, at = i[win], at[win]
            self.eta[i], self.p_t[i], self.p_id[i] = eta[win], slabs.t[at], slabs.id[at]
            self.p_lat[i], self.p_lon[i], self.p_mag[i] = slabs.lat[at], slabs.lon[at], slabs.mag[at]

    def result(self) -> pd.DataFrame:
        if self.rows:
            self.meet()
        t, ids, lat, lon = self.child
        got = np.isfinite(self.eta)
        blank = lambda x: np.where(got, x, np.nan)
        with np.errstate(invalid="ignore"):
            _, dt, r = self.kernel.pairs(t, lat, lon, self.p_t, self.p_lat, self.p_lon, self.p_mag)
        return pd.DataFrame({"event_id": ids, "eta": blank(self.eta), "parent_t": blank(self.p_t), "parent_id": self.p_id, "parent_mag": blank(self.p_mag),
                             "dt_days": blank(dt), "dist_km": blank(r), "evaluated": self.seen})


def _visited(kernel: _Rescaled):
    """Rows arrive per group: its own blocks first, then candidate blocks by rising bound."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, now = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if now is None or r.grp != group:
                    if now is not None:
                        yield now.result()
                    group, now = r.grp, _Visit(kernel)
                now.add(r)
        if now is not None:
            yield now.result()
    return run


def parent_search(events: DataFrame, max_days: float = 30.0, b: float = 1.0, d_frac: float = 1.6, size: int = 256, slots: int = 3, group: int = GROUP) -> DataFrame:
    """One row per event: its nearest parent (`eta` null where no event of the last `max_days` precedes it) and the number of
    candidates whose distance was evaluated (those that place and magnitude alone rule out are not counted). Equal distances go
    to the latest parent, then to the largest id."""
    kernel = _Rescaled(max_days, b, d_frac)
    blocks = sk.materialized(_blocks(events, max_days * DAY / slots, size), "blocks")
    heads = sk.materialized(_groups(blocks, group), "groups")
    reach = F.explode(F.sequence(c("tb"), c("tb") + lit(slots).cast("long"))).alias("tb")
    few = blocks.where("top IS NOT NULL").groupBy("tb", F.pmod(F.xxhash64("block"), lit(SEEDS)).alias("h")).agg(F.max("largest").alias("s")).select(reach, "s")
    seeds = few.groupBy("tb").agg(*[F.collect_list(f"s.{x}").alias(f"s_{x}") for x in ("t", "lat", "lon", "mag")])  # SEEDS * (slots + 1) at most
    some = F.array().cast("array<double>")
    child = heads.groupBy("tb", "grp").agg(*[F.collect_list(F.coalesce(x, lit(float("nan")))).alias(x) for x in _BOX])
    child = child.join(seeds, "tb", "left").select("tb", "grp", *_BOX, *[F.coalesce(f"s_{x}", some).alias(f"s_{x}") for x in ("t", "lat", "lon", "mag")])
    tables = heads.where("top IS NOT NULL").groupBy("tb", "grp").agg(F.collect_list("block").alias("p_block"), *[F.collect_list(x).alias(f"p_{x}") for x in _BOX])
    pairs = child.join(tables.select(reach, c("grp").alias("p_grp"), "p_block", *[f"p_{x}" for x in _BOX]), "tb").drop("tb").mapInPandas(
        _routed(kernel), "grp long, block long, low double")
    moved = heads.select("grp", "block", lit(-1.0).alias("low")).unionByName(pairs)
    rows = moved.join(blocks.select("block", "t", "id", "lat", "lon", "mag"), "block").drop("block")
    return rows.repartition("grp").sortWithinPartitions("grp", "low").mapInPandas(_visited(kernel), _FOUND)


def bounded_parents(events: DataFrame, max_days: float = 30.0, b: float = 1.0, d_frac: float = 1.6, size: int = 256, slots: int = 3) -> DataFrame:
    """The columns of `seismicity.nearest_parents`, found by the search."""
    found = parent_search(events, max_days, b, d_frac, size, slots).where("eta IS NOT NULL")
    return found.select("event_id", "parent_id", "eta", F.log10(F.greatest(c("eta"), lit(1e-20))).alias("log_eta"), "parent_mag", "dt_days", "dist_km")
