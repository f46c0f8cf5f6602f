"""Ordered work without one-task windows.

A plain `Window.orderBy` over a hot key (or over no key at all) sorts that key in a single task. The operators here
cut the order column at split points taken from one mergeable sketch, so every (key, slice) holds about 1/n of all
rows whatever the skew, do the ordered work inside slices, and carry a small per-slice total across them.
The split points only steer the cut: results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SLICE = "_slice"


def slice_count(df: DataFrame) -> int:
    """More slices than cores, within what one CASE tree carries well."""
    return max(32, min(512, 2 * df.sparkSession.sparkContext.defaultParallelism))


def split_points(df: DataFrame, order: str, n: int | None = None) -> list:
    """At most n-1 ascending cut values of a numeric column; the only thing that reaches the driver."""
    n = n or slice_count(df)
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(order), probs, F.lit(10 * n)).alias("q")).first()
    return sorted(set(row["q"] or []))


def slice_of(value: Column, cuts: Sequence) -> Column:
    """Number of cuts <= value, as a balanced CASE tree (log2(n) comparisons, code-generated)."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(cuts))


def sliced(df: DataFrame, order: str, cuts: Sequence | None = None) -> DataFrame:
    return df.withColumn(SLICE, slice_of(F.col(order), cuts if cuts is not None else split_points(df, order)))


def _keys(keys: Sequence[str]) -> list[str]:
    return list(keys)


def running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column], ties: Sequence[str] = (),
            totals: bool = False, cuts: Sequence | None = None, maxes: dict[str, Column] | None = None,
            include_current: bool = True) -> DataFrame:
    """Running sums and maxima per key in `order`, and per-key sum totals `<name>_total` on request.

    Rows that tie on (order, ties) must not exist: pre-aggregate them or name a unique tie column.
    """
    keys, maxes = _keys(keys), maxes or {}
    df = sliced(df, order, cuts)
    part = df.groupBy(*keys, SLICE).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
                                        *[F.max(e).alias(f"_s_{n}") for n, e in maxes.items()])
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = part.select(
        *keys, SLICE,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_s_{n}").over(before).alias(f"_o_{n}") for n in maxes],
        *([F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []))
    inner = W.partitionBy(*keys, SLICE).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    out = df.select("*", *[F.coalesce(F.sum(e).over(inner), F.lit(0)).alias(f"_r_{n}") for n, e in sums.items()],
                    *[F.max(e).over(inner).alias(f"_r_{n}") for n, e in maxes.items()]).join(offsets, [*keys, SLICE])
    for n in sums:
        out = out.withColumn(n, F.col(f"_r_{n}") + F.col(f"_o_{n}"))
    for n in maxes:
        out = out.withColumn(n, F.greatest(f"_r_{n}", f"_o_{n}"))
    both = [*sums, *maxes]
    return out.drop(SLICE, *[f"_r_{n}" for n in both], *[f"_o_{n}" for n in both])


def ranked(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], name: str = "rank",
           cuts: Sequence | None = None, total: str | None = None) -> DataFrame:
    """1-based row number per key without sorting a key in one task; `total` adds the key's row count."""
    out = running(df, keys, order, {name: F.lit(1).cast("long")}, ties, totals=bool(total), cuts=cuts)
    return out.withColumnRenamed(f"{name}_total", total) if total else out


def rolling(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], back: int, ahead: int,
            make: Callable[[Callable[[int, int], W]], dict[str, Column]], block: int | None = None) -> DataFrame:
    """Row-frame window functions per key with frames inside [-back, +ahead].

    Rows are numbered, cut into blocks of `block` rows, and the last `back` / first `ahead` rows of a block are copied
    to its neighbours, so that each block is an independent task and frames stay exact. `make(frame)` returns the new
    columns; `frame(lo, hi)` gives the window for a row frame.
    """
    keys = _keys(keys)
    block = block or max(4096, 8 * max(back, ahead))
    if back > block or ahead > block:
        raise ValueError("frames must not be wider than a block")
    df = ranked(df, keys, order, ties, "_rn")
    pos = F.col("_rn") - 1
    own = F.floor(pos / F.lit(block))
    offset = pos % F.lit(block)
    targets = F.array_compact(F.array(
        own,
        F.when(offset >= block - back, own + 1) if back else F.lit(None).cast("long"),
        F.when((offset < ahead) & (own > 0), own - 1) if ahead else F.lit(None).cast("long")))
    copies = df.withColumn("_own", own).withColumn("_block", F.explode(targets))
    base = W.partitionBy(*keys, "_block").orderBy("_rn")
    cols = make(lambda lo, hi: base.rowsBetween(lo, hi))
    out = copies.select("*", *[c.alias(n) for n, c in cols.items()]).where(F.col("_own") == F.col("_block"))
    return out.drop("_own", "_block", "_rn")


def neighbour_value(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], shift: int,
                    cols: dict[str, str]) -> DataFrame:
    """lag (shift > 0) or lead (shift < 0) of several columns, hot keys included."""
    back, ahead = (shift, 0) if shift > 0 else (0, -shift)
    return rolling(df, keys, order, ties, back, ahead,
                   lambda frame: {new: F.first(old).over(frame(-shift, -shift)) for new, old in cols.items()})


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles per key plus the count `n`; no reducer ever holds a key's values.

    Equal values collapse first, so a third of all rows sharing one value costs one row.
    """
    keys = _keys(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = running(counts, keys, "_v", {"_cum": F.col("_c")}, totals=True)
    before = F.col("_cum") - F.col("_c")
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_cum_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when((before <= lo) & (lo < F.col("_cum")), F.col("_v"))).alias(f"_lo_{name}"),
                 F.max(F.when((before <= hi) & (hi < F.col("_cum")), F.col("_v"))).alias(f"_hi_{name}")]
    picked = cum.groupBy(*keys).agg(F.max("_cum_total").alias("n"), *aggs)
    out = [*keys, "n"]
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        out.append((F.col(f"_lo_{name}") + frac * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return picked.select(*out)


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], cols: dict[str, Column],
                  include_current: bool = True, cuts: Sequence | None = None) -> DataFrame:
    """Last non-NULL value of each expression up to (or strictly before) the row, hot keys included."""
    keys = _keys(keys)
    df = sliced(df, order, cuts)
    inner_all = W.partitionBy(*keys, SLICE).orderBy(order, *ties)
    last = df.groupBy(*keys, SLICE).agg(
        *[F.max_by(e, F.when(e.isNotNull(), F.struct(order, *ties))).alias(f"_l_{n}") for n, e in cols.items()])
    before = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*keys, SLICE, *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in cols])
    frame = inner_all.rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    out = df.select("*", *[F.last(e, ignorenulls=True).over(frame).alias(f"_i_{n}") for n, e in cols.items()])
    out = out.join(carried, [*keys, SLICE], "left")
    for n in cols:
        out = out.withColumn(n, F.coalesce(F.col(f"_i_{n}"), F.col(f"_p_{n}")))
    return out.drop(SLICE, *[f"_i_{n}" for n in cols], *[f"_p_{n}" for n in cols])
