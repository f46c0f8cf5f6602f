"""Maximum-likelihood fit of the triggering model per zone, over all events and all their predecessors.

The conditional rate at an event is mu + sum of K exp(alpha (m - mc)) (age + c)^-p over all earlier events of its zone. Summing pairs would
take the square of the catalogue, so time is cut into cells of 2^level widths: predecessors in the event's own cell and the two before it count one
by one, older ones through the power moments of their cell, at the level where the cell is 3 to 5 widths away. There the moments become a power
series about the middle of the event's cell, series move down to smaller cells, and an event evaluates one series for all its older
predecessors. Both cells are seen under a fifth of the distance that remains, so ORDER terms give the sum to about 1e-8. Events are written once as
blocks of cells, each with the end of the block before it, so a pass only maps over them: small cells are handled inside the block; the moments of
the COARSE largest cells or fewer are gathered first, and their series sent to all tasks. A pass shuffles no events. It yields the likelihood, its
gradient and the information matrix of every zone; 21 numbers per zone and task reach the driver, which takes a damped scoring step inside the bounds
for all zones at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import moments as mo
from ..session import checkpoint_root

c, lit = F.col, F.lit
ORDER, NEAR, PER_CELL, BLOCK_LEVELS = 12, 3, 8, 9
COARSE = 1 << 14  # cells, over all zones, whose moments pass through the driver
# Starting point and bounds of (ln mu, ln K, alpha, ln c, p), least events and days of a fit, completeness.
START = (0.3, 0.04, 1.0, 0.01, 1.1)
LOW = np.array([math.log(0.001), math.log(0.001), 0.1, math.log(0.0001), 1.001])
HIGH = np.array([math.log(100.0), math.log(1.0), 2.5, math.log(1.0), 2.0])
MIN_EVENTS, MIN_DAYS, MC = 100, 30.0, 3.0
NAMES = ("mu", "K", "alpha", "c", "p")
UPPER = np.triu_indices(5)


def zone_spans(events: DataFrame) -> dict[str, tuple[int, float, float]]:
    """zone -> (events, first day, last day): one row per zone."""
    rows = events.groupBy("zone").agg(F.count(lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last")).collect()
    return {r["zone"]: (r["n"], r["first"], r["last"]) for r in rows}


def start_point(n: int, days: float) -> np.ndarray:
    share, k, alpha, cc, p = START
    return np.clip([math.log(max(share * n / max(days, 1e-9), 1e-300)), math.log(k), alpha, math.log(cc), p], LOW, HIGH)


class Likelihood:
    """The events of the fitted zones, cut into cells and blocks once, and passes over them for given parameters."""

    def __init__(self, events: DataFrame, spans: dict[str, tuple[int, float, float]]):
        self.spans = spans
        longest = max(last - first for _, first, last in spans.values())
        self.width = 2.0 ** math.floor(math.log2(max(min(PER_CELL * (b - a) / n for n, a, b in spans.values()), 1e-6)))
        first = F.create_map(*[x for z, (_, a, _) in sorted(spans.items()) for x in (lit(z), lit(float(a)))])
        own = events.where(c("zone").isin(sorted(spans))).select("zone", (c("day") - first[c("zone")]).alias("t"), c("mag").cast("double").alias("mag"))
        # bursts: narrower cells until the mean event shares its cell with about PER_CELL others
        counts = own.groupBy("zone", F.floor(c("t") / self.width).alias("cell")).agg(F.count(lit(1)).alias("n"))
        shared = counts.agg(F.sum(c("n") * c("n").cast("double")) / F.sum("n")).first()[0]
        self.width = max(self.width * 2.0 ** -max(0, math.ceil(math.log2(shared / (2 * PER_CELL)))), 2.0 ** -20)
        self.levels = max(1, math.ceil(math.log2(max(longest / self.width, 2.0))) + 1)
        cells = sum((b - a) / self.width + 1 for _, a, b in spans.values())
        # cells below this level are handled inside a block of 8 of its own halves, from the block and the last 5 halves of the one before
        self.coarse = max(BLOCK_LEVELS - 2, math.ceil(math.log2(cells / COARSE)))
        cell = F.floor(c("t") / self.width)
        home = F.shiftright(cell, self.coarse + 2)
        late = F.shiftright(cell, self.coarse - 1) - home * 8 >= 3
        both = own.select("zone", "t", "mag", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))).alias("block"))
        rows = both.groupBy("zone", "block").agg(F.sort_array(F.collect_list(F.struct("t", "mag"))).alias("e"))
        rows = rows.select("zone", "block", *[c(f"e.{x}").alias(x) for x in ("t", "mag")]).where(F.floor(F.element_at("t", -1) / self.width) >= c("block") * (1 << (self.coarse + 2)))
        checkpoint_root(events.sparkSession)
        # small tasks of mixed zones: every pass takes as long as its slowest core
        tasks = min(4 * events.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(n for n, _, _ in spans.values()) / 16384))
        self.blocks = rows.repartition(tasks).checkpoint()

    def _far(self, blocks: DataFrame, points: dict[str, np.ndarray]) -> dict[str, list]:
        """zone -> per level (cells, moments, moments times magnitude), None below the coarse level: at most COARSE rows are gathered."""
        got = blocks.mapInPandas(_moments(points, self.width, self.coarse), "zone string, cell long, moments array<double>").toPandas()
        out = {}
        for zone, g in got.groupby("zone"):
            g = g.sort_values("cell")
            cells, m = g["cell"].to_numpy(), np.stack(g["moments"].to_list()).reshape(-1, 2, ORDER)
            levels = [None] * self.levels
            for level in range(self.coarse, self.levels):
                levels[level] = cells, m[:, 0], m[:, 1]
                cells, m = mo.parents(cells, m)
            out[zone] = levels
        return out

    def __call__(self, points: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
        """zone -> (log-likelihood, gradient, information) at its point; zones left out are not visited."""
        blocks = self.blocks.where(c("zone").isin(sorted(points)))
        far = self._far(blocks, points) if self.coarse < self.levels else {}
        series = {z: (rows[self.coarse][0], _series(rows, [r and r[0] for r in rows], points[z], self.width, self.coarse, None)) for z, rows in far.items()}
        sums = blocks.mapInPandas(_block(points, self.spans, self.width, self.levels, self.coarse, series), "zone string, i int, x double")
        got: dict[str, np.ndarray] = {}
        for r in sums.collect():  # 21 numbers per zone from each task
            got.setdefault(r["zone"], np.zeros(6 + len(UPPER[0])))[r["i"]] += r["x"]
        out = {}
        for zone, x in got.items():
            _, a, b = self.spans[zone]
            background = math.exp(points[zone][0]) * (b - a)
            info = np.zeros((5, 5))
            info[UPPER] = x[6:]
            out[zone] = x[0] - background, x[1:6] - np.array([background, 0, 0, 0, 0]), info + np.triu(info, 1).T
        return out


@lru_cache(512)  # a pass asks for three per level and zone, in every block
def _kernels(back: int, size: float, log_c: float, p: float) -> np.ndarray:
    """Matrix from the moments of a cell to the series of the kernel, and of its derivative by p, in a cell `back` cells later."""
    k = np.arange(2 * ORDER - 1)
    harmonic = np.r_[0.0, np.cumsum(1 / (p + k[:-1]))]
    # the age is that of the middles plus half a cell times (place in the later cell plus place in the earlier one)
    x = back * size + math.exp(log_c)
    series = x ** -p * mo.binomials(p, len(k)) * (size / 2 / x) ** k
    i = np.arange(ORDER)
    comb = np.array([[math.comb(a + b, a) for b in i] for a in i], float)
    both = i[:, None] + i[None, :]
    return np.hstack([comb * series[both], comb * (series * (harmonic - math.log(x)))[both]])


def _series(moments, targets, theta, width: float, bottom: int, above: np.ndarray | None) -> np.ndarray:
    """Series (target of the bottom level, kernel | times magnitude | by p, ORDER) of all predecessors NEAR cells away or more.

    `moments` and `targets` go by level, targets are cells in order, `above` is the series of the targets one level above the last.
    """
    upper = None
    for level in range(len(targets) - 1, bottom - 1, -1):
        at = targets[level]
        out = np.zeros((len(at), 3, ORDER)) if above is None else mo.by_half(at, above if upper is None else above[np.searchsorted(upper, at >> 1)], mo.shifts(-1.0, 1.0, ORDER))
        cells, m, a = moments[level]
        for back in range(NEAR, 2 * NEAR):
            b = at - back
            place = np.minimum(np.searchsorted(cells, b), len(cells) - 1)
            hit = np.flatnonzero((cells[place] == b) & ((at >> 1) - (b >> 1) < NEAR))
            if not len(hit):
                continue
            kernel = _kernels(back, width * 2.0 ** level, float(theta[3]), float(theta[4]))
            add = np.empty((len(hit), 3, ORDER))
            add[:, ::2] = (m[place[hit]] @ kernel).reshape(-1, 2, ORDER)
            add[:, 1] = a[place[hit]] @ kernel[:, :ORDER]
            out[hit] += add
        above, upper = out, at
    return above


def _near_sums(at: int, t, cell, weight, rel, theta, out) -> None:
    """Predecessors in the last NEAR cells of the events from place `at` on: the latest of each event, then the one before it, and so on."""
    log_c, p = theta[3:]
    cc = math.exp(log_c)
    high = np.searchsorted(t, t[at:], "left")
    count = np.maximum(high - np.searchsorted(cell, cell[at:] - (NEAR - 1), "left"), 0)
    turn = np.argsort(-count, kind="stable")
    last, when = high[turn], t[at:][turn] + cc
    left = len(turn) - np.cumsum(np.bincount(count))  # events with more than d predecessors
    sums = np.zeros((4, len(turn)))
    for d, n in enumerate(left[:-1]):
        j = last[:n] - (d + 1)
        x = when[:n] - t[j]
        log_x = np.log(x)
        f = weight[j] * np.exp(-p * log_x)
        sums[0, :n] += f
        sums[1, :n] += f * rel[j]
        sums[2, :n] -= f / x
        sums[3, :n] -= f * log_x
    sums[2] *= p
    out[:, turn] += sums


def _far_sums(t, cell, cells, series, width: float, out) -> None:
    """Older predecessors by the series of each event's cell."""
    place = np.searchsorted(cells, cell)
    x = (t - (cell + 0.5) * width) / (width / 2)
    plain, by_mag, by_p = np.ascontiguousarray(series.transpose(1, 2, 0))
    s, slope, s_mag, s_p = np.zeros((4, len(t)))
    for k in range(ORDER - 1, -1, -1):
        slope *= x
        slope += s
        for total, row in ((s, plain), (s_mag, by_mag), (s_p, by_p)):
            total *= x
            total += row[k][place]
    out += np.stack([s, s_mag, slope / (width / 2), s_p])


def _moments(points, width: float, level: int):
    """Moments of one level, each cell from the block that owns it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                cell = np.floor(r.t / width).astype(np.int64)
                at = np.searchsorted(cell, r.block << (level + 2))
                rel = r.mag[at:] - MC
                weight = np.exp(points[r.zone][2] * rel)
                cells, m = mo.cell_moments(r.t[at:], cell[at:], np.stack([weight, weight * rel]), width, level, ORDER)
                yield pd.DataFrame({"zone": r.zone, "cell": cells, "moments": list(m.reshape(len(cells), -1))})
    return run


def _block(points, spans, width: float, levels: int, coarse: int, series):
    def one(zone: str, block: int, t, rel) -> np.ndarray:
        theta = points[zone]
        log_mu, log_k, alpha, log_c, p = theta
        mu, k, cc = math.exp(log_mu), math.exp(log_k), math.exp(log_c)
        cell = np.floor(t / width).astype(np.int64)
        start = block << (coarse + 2)
        at = int(np.searchsorted(cell, start))
        weight = np.exp(alpha * rel)
        cells, m = mo.cell_moments(t, cell, np.stack([weight, weight * rel]), width, 0, ORDER)
        moments, targets = [], []
        for level in range(min(coarse, levels)):
            if level:
                cells, m = mo.parents(cells, m)
            moments.append((cells, m[:, 0], m[:, 1]))
            targets.append(cells[cells >= start >> level])
        above = None
        if series:
            large, rows = series[zone]
            above = rows[np.searchsorted(large, targets[-1] >> 1)]
        sums = np.zeros((4, len(t) - at))
        _near_sums(at, t, cell, weight, rel, theta, sums)
        _far_sums(t[at:], cell[at:], targets[0], _series(moments, targets, theta, width, 0, above), width, sums)
        s, s_alpha, s_c, s_p = sums
        rate = mu + k * s
        score = np.stack([np.full(len(s), mu), k * s, k * s_alpha, k * cc * s_c, k * s_p]) / rate
        # expected triggered count of each event up to the end of its zone
        n, first, last = spans[zone]
        x = np.maximum(last - first - t[at:], 0.0) + cc
        weight, u, rel = k * weight[at:], 1 - p, rel[at:]
        log_x = np.log(x)
        hi, lo = np.exp(u * log_x), cc ** u
        body = (hi - lo) / u
        d_u = (hi * log_x - lo * log_c) / u - body / u
        expected = weight * body
        drop = np.array([0.0, expected.sum(), (expected * rel).sum(), (weight * cc * (hi / x - lo / cc)).sum(), (-weight * d_u).sum()])
        info = score @ score.T
        return np.r_[np.log(rate).sum() - expected.sum(), score.sum(1) - drop, info[UPPER]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, np.ndarray] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                got[r.zone] = got.get(r.zone, 0.0) + one(r.zone, r.block, r.t, r.mag - MC)
        for zone, row in got.items():
            yield pd.DataFrame({"zone": zone, "i": np.arange(len(row)), "x": row})
    return run


def _step(theta, gradient, info, damping):
    """A damped scoring step inside the bounds; a parameter that leans against its bound stays there."""
    free = ~(((theta <= LOW) & (gradient < 0)) | ((theta >= HIGH) & (gradient > 0)))
    move = np.zeros(5)
    if free.any():
        b = info[np.ix_(free, free)]
        b = b + np.diag(damping * np.diag(b) + 1e-9 * max(np.trace(b), 1.0))
        move[free] = np.clip(np.linalg.solve(b, gradient[free]), -1.5, 1.5)
    return np.clip(theta + move, LOW, HIGH)


def fit_zones(events: DataFrame, passes: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """One row per zone of `events` (zone, day, mag): fitted, mu, K, alpha, c, p, nll, aic, branching_ratio, n_events, duration_days, passes.

    Zones with under MIN_EVENTS events or MIN_DAYS days are not fitted and carry nulls. A fit ends when a pass improves the likelihood
    by less than `tolerance` of itself; one that has not ended after `passes` passes is not fitted. Every event counts with all its predecessors;
    of events at the same time none triggers the other. An empty table gives no rows.
    """
    spark = events.sparkSession
    spans = zone_spans(events)
    able = {z: x for z, x in spans.items() if x[0] >= MIN_EVENTS and x[2] - x[1] >= MIN_DAYS}
    best, done = {}, {}
    if able:
        likelihood = Likelihood(events, able)
        theta = {z: start_point(n, b - a) for z, (n, a, b) in able.items()}
        best = {z: (theta[z], *r) for z, r in likelihood(theta).items()}
        damping, calm = dict.fromkeys(able, 1e-2), dict.fromkeys(able, 0)
        for used in range(2, passes + 1):
            tried = {z: _step(*best[z][:1], *best[z][2:], damping[z]) for z in able if z not in done}
            for z in [z for z, x in tried.items() if np.array_equal(x, best[z][0])]:
                done[z] = used - 1
                del tried[z]
            if not tried:
                break
            for z, r in likelihood(tried).items():
                gain = r[0] - best[z][1]
                small = abs(gain) <= tolerance * max(abs(r[0]), abs(best[z][1]), 1.0)
                if gain > 0:
                    best[z], damping[z] = (tried[z], *r), max(damping[z] / 10, 1e-6)
                else:
                    damping[z] *= 10
                calm[z] = calm[z] + 1 if small else 0
                if calm[z] and gain >= 0 or calm[z] >= 2 or damping[z] > 1e8:
                    done[z] = used
    rows = []
    for z, (n, a, b) in sorted(spans.items(), key=lambda x: str(x[0])):
        if z not in done:
            rows.append((z, False, *[None] * 8, n, round(b - a, 1), None))
            continue
        at, value = best[z][0], best[z][1]
        p = [math.exp(at[0]), math.exp(at[1]), float(at[2]), math.exp(at[3]), float(at[4])]
        rows.append((z, True, *p, -float(value), 10 - 2 * float(value), round(1 - p[0] * (b - a) / n, 3), n, round(b - a, 1), done[z]))
    schema = "zone string, fitted boolean, " + ", ".join(f"{x} double" for x in NAMES) + ", nll double, aic double, branching_ratio double, n_events long, duration_days double, passes int"
    return spark.createDataFrame(rows, schema)


def zone_parameters(fits: DataFrame) -> dict[str, dict[str, float]]:
    """zone -> K, alpha, c, p, mc of the fitted zones, for `features.triggering_expected`: one row per zone."""
    return {r["zone"]: {"K": r["K"], "alpha": r["alpha"], "c": r["c"], "p": r["p"], "mc": MC} for r in fits.where("fitted").collect()}


def likelihood_at_start(events: DataFrame) -> DataFrame:
    """(zone, n_events, nll and its five derivatives) at the starting point of the fit."""
    spark = events.sparkSession
    able = {z: x for z, x in zone_spans(events).items() if x[0] >= MIN_EVENTS and x[2] - x[1] >= MIN_DAYS}
    got = Likelihood(events, able)({z: start_point(n, b - a) for z, (n, a, b) in able.items()}) if able else {}
    rows = [(z, able[z][0], -float(v), *[float(-x) for x in g]) for z, (v, g, _) in sorted(got.items())]
    return spark.createDataFrame(rows, "zone string, n_events long, nll double, d_ln_mu double, d_ln_k double, d_alpha double, d_ln_c double, d_p double")
