"""Bootstrap and shuffle nulls without drawing index lists: every replicate weight comes from a hash of (row, replicate)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .ordered import ranked
from .sinks import materialized

# Cumulative Poisson(1) probabilities.
POISSON1 = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]


def modular_uniform(k: Column, b: Column) -> Column:
    """Pseudo-random number in [0, 1) from plain integer arithmetic, the same in every SQL dialect.

    Cubing is a permutation modulo 10007, so every replicate is a fresh scatter of the row numbers.
    """
    x = (k * 7919 + b * 5381 + b * b * 31) % 10007
    return (x * x % 10007 * x % 10007) / F.lit(10007.0)


def poisson_weight(u: Column) -> Column:
    return sum(((u >= F.lit(t)).cast("int") for t in POISSON1[1:]), (u >= F.lit(POISSON1[0])).cast("int"))


def bootstrap(df: DataFrame, keys: Sequence[str], row_id: str, replicates: int) -> DataFrame:
    """Rows repeated per replicate with their resampling weight `w` (0 rows dropped); aggregate by (keys, b) right after,
    so that only partial sums are shuffled."""
    b = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    b = b.withColumn("w", poisson_weight(modular_uniform(F.col(row_id), F.col("b"))))
    return b.where("w > 0")


def bootstrap_mean(df: DataFrame, keys: Sequence[str], row_id: str, value: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """Confidence interval of the mean per key."""
    m = bootstrap(df, keys, row_id, replicates).groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("_m"))
    lo = (1 - level) / 2
    return m.groupBy(*keys).agg(F.percentile("_m", F.lit(lo)).alias("ci_low"), F.percentile("_m", F.lit(1 - lo)).alias("ci_high"), F.avg("_m").alias("boot_mean"))


#: Points up to which a key's slopes are listed in its row; points of a block, thresholds per pass and slopes listed at the end beyond that.
LISTED, BLOCK, THRESHOLDS, REMAINDER = 512, 2048, 31, 200_000


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, listed: int | None = None) -> DataFrame:
    """(keys, slope, n_pairs): the median of the slopes of all pairs of points with different x; 0 without such a pair.

    A key of few points lists its slopes in its row. For one with more, pairs whose slope is below a threshold are counted as
    inversions of y - threshold * x between blocks of points, many thresholds a pass, until few slopes are left between two of them.
    The result is the same.
    """
    limit = LISTED if listed is None else listed
    pts = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    large = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    some = [tuple(r[k] for k in keys) for r in large.select(*keys, "_n").toLocalIterator()]
    if not some:
        return _listed_slopes(pts, keys)
    hot = large.drop("_n")
    on = [F.col(f"_k.{k}").eqNullSafe(F.col(f"_p.{k}")) for k in keys]
    beside = lambda how: pts.alias("_p").join(hot.alias("_k"), on, how).select(*[f"_p.{c}" for c in pts.columns]) if keys else pts.limit(0) if how == "left_anti" else pts
    return _listed_slopes(beside("left_anti"), keys).where("n_pairs IS NOT NULL").unionByName(_counted_slopes(beside("left_semi"), keys)) if keys else _counted_slopes(pts, keys)


def _listed_slopes(pts: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = pts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("_p"))
    slopes = F.flatten(F.transform("_p", lambda a: F.transform(F.filter("_p", lambda q: q["x"] > a["x"]), lambda q: (q["y"] - a["y"]) / (q["x"] - a["x"]))))
    g = g.withColumn("_s", F.sort_array(slopes)).withColumn("_n", F.size("_s"))
    mid = F.floor((F.col("_n") - 1) / 2).cast("int")
    med = (F.try_element_at("_s", mid + 1) + F.try_element_at("_s", F.col("_n") - mid)) / 2
    return g.select(*keys, F.when(F.col("_n") > 0, med).otherwise(0.0).alias("slope"), F.col("_n").cast("long").alias("n_pairs"))


def _below(a, b, slope, same: bool) -> np.ndarray:
    """Per pair of a block a and a later block b: is its slope below? Points are in (x, y) order, so equal x never count."""
    ra, rb = a[1] - slope * a[0], b[1] - slope * b[0]
    out = rb[None, :] < ra[:, None]
    return np.triu(out, 1) if same else out


def _count_below(a, b, slope, same: bool) -> int:
    return _inversions(a[1] - slope * a[0]) if same else _crossed(a[1] - slope * a[0], b[1] - slope * b[0])


def _crossed(ra: np.ndarray, rb: np.ndarray) -> int:
    """Pairs whose later residual is smaller; both sides sorted, so the search walks forward."""
    return int(len(ra) * len(rb) - np.searchsorted(np.sort(ra), np.sort(rb), "right").sum())


def _inversions(r: np.ndarray) -> int:
    if len(r) <= 64:
        return int(np.triu(r[None, :] < r[:, None], 1).sum())
    half = len(r) // 2
    return _inversions(r[:half]) + _inversions(r[half:]) + _crossed(r[:half], r[half:])


def _pairs(batches):
    """Block pairs as (key, a, b, same) with arrays of x and y."""
    for t in batches:
        cols = {name: t.column(name) for name in ("key", "a", "b", "ax", "ay", "bx", "by")}
        point = lambda s, i: tuple(cols[s + z][i].values.to_numpy() for z in "xy")
        for i in range(t.num_rows):
            yield cols["key"][i].as_py(), point("a", i), point("b", i), cols["a"][i] == cols["b"][i]


def _counts(thresholds: dict):
    def run(batches):
        total: dict = {}
        for key, a, b, same in _pairs(batches):
            for i, s in enumerate(thresholds.get(key, ())):
                total[key, i] = total.get((key, i), 0) + _count_below(a, b, s, same)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int64()), pa.array([i for _, i in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["key", "i", "n"])
    return run


def _between(brackets: dict):
    def run(batches):
        for key, a, b, same in _pairs(batches):
            if key in brackets:
                low, high = brackets[key]
                i, j = np.nonzero(_below(a, b, high, same) & ~_below(a, b, low, same))
                slopes = (b[1][j] - a[1][i]) / (b[0][j] - a[0][i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), key)), pa.array(slopes)], names=["key", "slope"])
    return run


def _counted_slopes(pts: DataFrame, keys: Sequence[str]) -> DataFrame:
    spark = pts.sparkSession
    r = ranked(pts.withColumn("_tie", F.monotonically_increasing_id()), keys, "x", ["y", "_tie"], "_rk")
    key = F.xxhash64(*keys).alias("key") if keys else F.lit(0).cast("long").alias("key")
    blocks = r.groupBy(*keys, key, F.floor((F.col("_rk") - 1) / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))
    blocks = materialized(blocks.select(*keys, "key", "b", F.col("p.x").alias("bx"), F.col("p.y").alias("by")), "slope-blocks")
    first = blocks.select("key", F.col("b").alias("a"), F.col("bx").alias("ax"), F.col("by").alias("ay"))
    met = blocks.select("key", "b", "bx", "by", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("a")).join(first, ["key", "a"])
    # pairs with different x, and the scale that spreads slopes evenly over angles
    same_x = pts.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("m")).groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("t"))
    spread = pts.groupBy(*keys).agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    info = same_x.join(spread, [F.lit(True)] if not keys else list(keys)) if keys else same_x.crossJoin(spread)
    facts = {x["key"]: x for x in info.select(*keys, key, "n", "t", "sx", "sy").collect()}  # a row per large key
    pairs = {k: f["n"] * (f["n"] - 1) // 2 - f["t"] for k, f in facts.items()}
    scale = {k: (f["sy"] / f["sx"] if f["sx"] and f["sy"] else 1.0) for k, f in facts.items()}
    half = math.pi / 2
    bracket = {k: [-half, half, 0, n] for k, n in pairs.items() if n > 0}  # angles, slopes below the lower, slopes below the upper
    answer = dict.fromkeys([k for k, n in pairs.items() if n <= 0], 0.0)
    while todo := [k for k, (lo, hi, a, b) in bracket.items() if b - a > REMAINDER and hi - lo > 1e-15]:
        angles = {k: np.linspace(*bracket[k][:2], THRESHOLDS + 2)[1:-1] for k in todo}
        n = {}
        for x in met.mapInArrow(_counts({k: np.tan(v) * scale[k] for k, v in angles.items()}), "key long, i long, n long").groupBy("key", "i").agg(F.sum("n").alias("n")).collect():
            n[x["key"], x["i"]] = x["n"]
        for k in todo:
            k1, k2 = (pairs[k] - 1) // 2, pairs[k] // 2
            for i, angle in enumerate(angles[k].tolist()):
                below = n.get((k, i), 0)
                if below <= k1:
                    bracket[k][0], bracket[k][2] = angle, below
                elif below > k2:
                    bracket[k][1], bracket[k][3] = angle, below
                    break
    left = {}
    for k, (lo, hi, a, b) in bracket.items():
        if b - a > REMAINDER:  # equal slopes: the angles have met
            answer[k] = math.tan((lo + hi) / 2) * scale[k]
        else:
            left[k] = (math.tan(lo) * scale[k] if lo > -half else -math.inf, math.tan(hi) * scale[k] if hi < half else math.inf)
    if left:
        ends = {k: (max(a, -1e300), min(b, 1e300)) for k, (a, b) in left.items()}
        rows: dict = {}
        for x in met.mapInArrow(_between(ends), "key long, slope double").toLocalIterator():  # at most REMAINDER a key
            rows.setdefault(x["key"], []).append(x["slope"])
        for k, slopes in rows.items():
            slopes.sort()
            answer[k] = (slopes[(pairs[k] - 1) // 2 - bracket[k][2]] + slopes[pairs[k] // 2 - bracket[k][2]]) / 2
    fields = [f for f in pts.schema.fields if f.name in keys]
    schema = StructType([*fields, StructField("slope", DoubleType()), StructField("n_pairs", LongType())])
    return spark.createDataFrame([(*[facts[k][x] for x in keys], float(answer[k]), int(pairs[k])) for k in facts], schema)
