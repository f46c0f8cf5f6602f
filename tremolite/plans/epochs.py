"""Spectra of station records before and after events: one row per (event, station) with both sides.

Samples of a station are numbered in their order, and the four ends of an event's sides take their place in the same numbering. A side is then
a number and a count; it lies in one of the pages into which the numbered samples are cut, and pages are at least as long as the longest side. Sides
that hold the same samples are transformed once, many sides of a page in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import spectral as spec
from ..operators import ordered as od, sinks as sk

c, lit = F.col, F.lit
DAY = 86400
POWER, FRACTAL, LEAST = 60, 120, 30  # first samples of a side for power and dimension where only an hour and two are asked for, least samples of a side
VALUES = ("power_z", "polarization", "fractal_dim")
TOGETHER = 1 << 27  # samples that the sides transformed by one task hold, counted once per side


def night_days(samples: DataFrame, first_hour: int = 15, last_hour: int = 21) -> DataFrame:
    """(station, t, z, h): samples of the night hours (UTC) with both components."""
    hour = F.floor(F.pmod(c("t"), lit(DAY)) / 3600)
    return samples.where(hour.between(first_hour, last_hour) & c("h").isNotNull() & c("z").isNotNull()).select("station", "t", "z", "h")


def _placed(pairs: DataFrame, samples: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Samples with their number `i` (from 0) in the order (t, z, h) of their station; (event_id, station, at, side, start, n) per side with samples."""
    # `turn` places an end before (0) or behind (2) the samples of its second (1)
    ends = [("pre", "start", -span, 0), ("pre", "stop", 0, 0), ("post", "start", 0, 2), ("post", "stop", span, 2)]
    ends = F.inline(F.array(*[F.struct(lit(side).alias("side"), lit(end).alias("end"), (c("t") + lit(by)).alias("t"), lit(turn).alias("turn")) for side, end, by, turn in ends]))
    probes = pairs.where(c("t").isNotNull()).select("event_id", "station", c("t").alias("at"), "t").select("event_id", "station", "at", ends)
    both = samples.withColumns({"turn": lit(1), "one": lit(1)}).unionByName(probes.withColumn("one", lit(0)), allowMissingColumns=True)
    both = sk.materialized(od.running(sk.materialized(both, "epoch-rows"), ["station"], "t", {"upto": c("one").cast("long")}, ["turn", "z", "h"]), "epoch-places")
    at = {end: F.max(F.when(c("end") == end, c("upto"))) for end in ("start", "stop")}
    sides = both.where(c("turn") != 1).groupBy("event_id", "station", "at", "side").agg(at["start"].alias("start"), (at["stop"] - at["start"]).alias("n"))
    return both.where(c("turn") == 1).select("station", (c("upto") - 1).alias("i"), "z", "h"), sides


def _measures(measure: Callable[[pd.Series, pd.Series], pd.DataFrame], first: tuple[int, int] | None):
    """(station, start, n, power, ratio of powers, dimension) of sides; rows of a page and some of its sides in."""
    def one(z: np.ndarray, h: np.ndarray, start: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        def cut(x, size):
            return pd.Series([x[a:b] for a, b in zip(start, start + size)], dtype=object)
        if first is None:
            return measure(cut(z, n), cut(h, n))[list(VALUES)]
        short, long = (measure(*[cut(x, np.minimum(n, k)) for x in (z, h)]) for k in first)
        return short[["power_z", "polarization"]].join(long["fractal_dim"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                z, h = np.asarray(r.z, np.float64), np.asarray(r.h, np.float64)
                start, n = np.asarray(r.start), np.asarray(r.n)
                # sides of about a million samples at a time
                turn = (np.cumsum(n) - n) >> 20
                for at in np.split(np.arange(len(n)), np.flatnonzero(np.diff(turn)) + 1):
                    values = one(z, h, start[at] - r.page * r.size, n[at])
                    values[["station", "start", "n"]] = pd.DataFrame({"station": r.station, "start": start[at], "n": n[at]})
                    yield values[["station", "start", "n", *VALUES]]
    return run


def epoch_spectra(pairs: DataFrame, samples: DataFrame, back: int = 7, fs: float = 1 / 60.0, first: tuple[int, int] | None = (POWER, FRACTAL)) -> DataFrame:
    """Band power, polarisation and fractal dimension before [t - back days, t) and after (t, t + back days] each (event_id, station, t).

    `first` gives the samples from which power and dimension of a side are taken, None takes all of them. Pairs with fewer than 30 samples
    on a side are left out. Measures are null where a side is too short for them.
    """
    numbered, sides = _placed(pairs, samples, back * DAY)
    place = ["event_id", "station", "at"]
    ns = sides.groupBy(*place).agg(*[F.max(F.when(c("side") == k, c("n"))).alias(f"n_{k}") for k in ("pre", "post")])
    ns = ns.where((c("n_pre") >= LEAST) & (c("n_post") >= LEAST))
    whole = sk.materialized(sides.join(ns, place).withColumn("n", c("n") if first is None else F.least("n", lit(max(first)))), "epoch-sides")
    longest = whole.agg(F.max("n")).scalar()
    size = F.greatest(lit(FRACTAL), F.coalesce(longest, lit(0)))
    # a page holds its own samples and those of the next, so that a side lies in one page; a page goes to each part of its sides
    own = whole.select("station", "start", "n").distinct().withColumn("page", F.floor(c("start") / size))
    part = F.floor(F.pmod(F.xxhash64("start", "n"), lit(1 << 20)) * c("parts") / (1 << 20))
    parts = own.groupBy("station", "page").agg(F.ceil(F.sum("n") / TOGETHER).alias("parts"))
    dealt = own.join(parts, ["station", "page"]).withColumn("part", part).groupBy("station", "page", "part").agg(F.collect_list(F.struct("start", "n")).alias("s"))
    page = F.floor(c("i") / size)
    pages = numbered.withColumn("page", F.explode(F.array(page, page - 1))).join(parts.select("station", "page"), ["station", "page"], "left_semi")
    pages = pages.groupBy("station", "page").agg(F.sort_array(F.collect_list(F.struct("i", "z", "h"))).alias("rows"))
    pages = pages.join(parts, ["station", "page"]).withColumn("part", F.explode(F.sequence(lit(0).cast("bigint"), c("parts") - 1)))
    met = dealt.join(pages.select("station", "page", "part", c("rows.z").cast("array<double>").alias("z"), c("rows.h").cast("array<double>").alias("h")), ["station", "page", "part"])
    met = met.select("station", "page", size.cast("long").alias("size"), "z", "h", c("s.start").alias("start"), c("s.n").alias("n"))
    station = samples.select("station").schema[0].dataType.simpleString()
    alike = met.mapInPandas(_measures(spec.ulf_features(fs).func, first), f"station {station}, start long, n long, " + ", ".join(f"{x} double" for x in VALUES))
    g = whole.join(alike, ["station", "start", "n"]).groupBy(*place, "n_pre", "n_post").agg(
        *[F.max(F.when(c("side") == k, c(x))).alias(f"{k}_{x}") for k in ("pre", "post") for x in VALUES]).drop("at")
    return g.withColumn("power_ratio", F.when(c("post_power_z") > 0, c("pre_power_z") / c("post_power_z")))


def summary(spectra: DataFrame, by: list[str]) -> DataFrame:
    """Per group: pairs, mean power ratio with its shares above 1.5 and 2, mean polarisation and dimension per side."""
    share = lambda cond: F.avg(F.when(c("power_ratio").isNotNull(), cond.cast("double")))
    return spectra.groupBy(*by).agg(
        F.count(lit(1)).alias("n_pairs"), F.avg("power_ratio").alias("mean_ratio"), share(c("power_ratio") > 1.5).alias("share_15"), share(c("power_ratio") > 2).alias("share_20"),
        *[F.avg(f"{k}_{x}").alias(f"{k}_{x}") for k in ("pre", "post") for x in ("polarization", "fractal_dim")])
