"""Guards, scores and small probability functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def z_floor(value: Column, mean: Column, std: Column, floor: float, active: Column | None = None) -> Column:
    """(value - mean) / max(std, floor); 0 where the value is missing or not active."""
    z = (value - F.coalesce(mean, F.lit(0.0))) / F.greatest(or_default(std, 1.0), F.lit(float(floor)))
    return F.coalesce(F.when(active if active is not None else value > 0, z), F.lit(0.0))


def or_default(x: Column, default: float) -> Column:
    """NULL and 0 both become the default."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(float(default)))


def ratio_floor(num: Column, den: Column, floor: float) -> Column:
    return num / F.greatest(den, F.lit(float(floor)))


def log_floor(x: Column, floor: float) -> Column:
    """log10(max(x, floor)) for positive values, log10(floor) otherwise (NULL included)."""
    return F.when(x > 0, F.log10(F.greatest(x, F.lit(float(floor))))).otherwise(F.lit(round(math.log10(floor), 12)))


def gain(precision: Column, base: Column, floor: float = 1e-10) -> Column:
    return precision / F.greatest(base, F.lit(floor))


def bits(g: Column, floor: float | None = None) -> Column:
    arg = F.greatest(g, F.lit(floor)) if floor else g
    return F.when(g > 0, F.log2(arg)).otherwise(F.lit(-10.0))


def log_loss_term(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(y * F.log(q) + (F.lit(1) - y) * F.log(F.lit(1.0) - q))


def log_factorial(n: Column) -> Column:
    """ln n! at a fixed cost: a short table, then Stirling's series (terms to the seventh power, error under 1e-13)."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(n.cast("double"), F.lit(1.0)) + 1
    series = ((x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (x * 12) - 1 / (F.pow(x, F.lit(3.0)) * 360)
              + 1 / (F.pow(x, F.lit(5.0)) * 1260) - 1 / (F.pow(x, F.lit(7.0)) * 1680))
    return F.when(n < 16, F.element_at(table, F.greatest(n.cast("int"), F.lit(0)) + 1)).otherwise(series)


def _log_poisson(k: Column, lam: Column) -> Column:
    return k.cast("double") * F.log(lam) - lam - log_factorial(k)


def poisson_cdf(k: Column, lam: Column, spread: float = 10.0) -> Column:
    """P(X <= k). Only terms within `spread` deviations of k are added, below k or, above the mean, of the other tail; what lies
    beyond is under exp(-spread^2 / 2) of the sum. The number of terms grows with the square root of k, not with k."""
    kk = F.greatest(k.cast("long"), F.lit(0).cast("long"))
    width = F.ceil(F.lit(spread) * F.sqrt(F.greatest(kk.cast("double"), lam)) + 60).cast("long")
    lower = kk <= lam
    first = F.when(lower, F.greatest(kk - width, F.lit(0).cast("long"))).otherwise(kk + 1)
    last = F.when(lower, kk).otherwise(kk + width)
    start = F.struct(_log_poisson(first, lam).alias("lp"), F.lit(0.0).alias("total"))

    def step(acc, i):
        lp = F.when(i == first, acc["lp"]).otherwise(acc["lp"] + F.log(lam) - F.log(i.cast("double")))
        return F.struct(lp.alias("lp"), (acc["total"] + F.exp(lp)).alias("total"))

    part = F.aggregate(F.sequence(first, last), start, step, lambda acc: F.least(acc["total"], F.lit(1.0)))
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.when(lower, part).otherwise(1 - part))


def poisson_quantile(p: float, lam: Column, spread: float = 12.0) -> Column:
    """Smallest k with P(X <= k) >= p; the search covers `spread` deviations around the rate."""
    reach = F.lit(spread) * F.sqrt(lam) + F.lit(20.0)
    low = F.greatest(F.floor(lam - reach), F.lit(0)).cast("long")
    start = F.struct(_log_poisson(low, lam).alias("lp"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("k"))

    def step(acc, i):
        lp = F.when(i == low, acc["lp"]).otherwise(acc["lp"] + F.log(lam) - F.log(i.cast("double")))
        total = acc["total"] + F.exp(lp)
        k = F.when((acc["k"] < 0) & (total >= F.lit(p)), i).otherwise(acc["k"])
        return F.struct(lp.alias("lp"), total.alias("total"), k.alias("k"))

    return F.when(lam <= 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.sequence(low, F.ceil(lam + reach).cast("long")), start, step, lambda acc: acc["k"]))


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF, Abramowitz-Stegun 26.2.17 (absolute error below 7.5e-8)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937)
                + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-x * x / F.lit(2.0)) / F.lit(math.sqrt(2 * math.pi)) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def year_fraction(t_s: Column) -> Column:
    """Epoch seconds to fractional year."""
    ts = F.timestamp_seconds(t_s)
    y = F.year(ts)
    start = F.unix_timestamp(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    end = F.unix_timestamp(F.make_timestamp(y + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return y + (t_s - start) / (end - start)


def label_of(code: Column, labels: dict) -> Column:
    """Map a code to its label; unknown codes keep their text."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code.cast("string"))


def uniform_hash(*cols: Column) -> Column:
    """Deterministic number in [0, 1) from the hash of the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))
