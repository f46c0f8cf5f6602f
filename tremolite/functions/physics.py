"""Magnitude scaling, mechanisms, stress, rate-state, triggering and magnitude-frequency expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .spatial import DEG_KM

# Shear modulus (Pa), friction, and magnitude scaling log10(X) = a + b*M for length and width in km.
SHEAR_MODULUS = 32e9
FRICTION = 0.4
SCALING = {
    "reverse": ((-2.86, 0.63), (-1.61, 0.41)),
    "strike_slip": ((-3.55, 0.74), (-0.76, 0.27)),
    "normal": ((-2.01, 0.50), (-1.14, 0.35)),
    "all": ((-2.44, 0.59), (-1.01, 0.32)),
}
# Triggering parameters used when no fit exists.
TRIGGER = {"K": 0.04, "alpha": 1.0, "c": 0.01, "p": 1.1, "mc": 3.0}
LOG10_E = math.log10(math.e)


def p10(exponent: Column) -> Column:
    return F.pow(F.lit(10.0), exponent)


def fault_dimensions(mag: Column, kind: str = "reverse"):
    """(length_km, width_km, slip_m) from moment magnitude."""
    (la, lb), (wa, wb) = SCALING[kind]
    length = p10(F.lit(la) + F.lit(lb) * mag)
    width = p10(F.lit(wa) + F.lit(wb) * mag)
    slip = p10(F.lit(1.5) * mag + F.lit(9.05)) / (F.lit(SHEAR_MODULUS) * length * F.lit(1000.0) * width * F.lit(1000.0))
    return length, width, slip


def fault_class(rake: Column) -> Column:
    r = F.pmod(rake, F.lit(360.0))
    r = F.when(r > 180, r - 360).otherwise(r)
    slip = (F.abs(r) <= 30) | (F.abs(r) >= 150)
    return F.when(slip, "strike_slip").when((r > 30) & (r < 150), "reverse").otherwise("normal")


def regional_mechanism(lat: Column, lon: Column, depth: Column) -> Column:
    """Default (strike, dip, rake) by region and depth, as a struct."""
    def sdr(s, d, r):
        return F.struct(F.lit(float(s)).alias("strike"), F.lit(float(d)).alias("dip"), F.lit(float(r)).alias("rake"))
    return (F.when(depth > 70, sdr(200, 45, 90))
            .when((lon > 142) & (lat > 35), sdr(200, 25, 90))
            .when((lon < 137) & (lat < 35), sdr(240, 15, 90))
            .when(lat > 40, sdr(200, 40, 90))
            .when((lon > 130) & (lon < 132) & (lat < 34), sdr(30, 60, -90))
            .otherwise(sdr(200, 35, 90)))


def stress_change(lat, lon, depth, mag, obs_lat, obs_lon, obs_depth) -> Column:
    """Coulomb stress change (Pa) of a far-field double couple on an optimally oriented plane.

    With fault normal n and slip d (orthogonal unit vectors) and m = (nd' + dn')/2, the stress is
    P (3 q uu' - m - q I), q = u'mu, P = M0 / (4 pi r^3). Its trace is -P n.d = 0 and its squared norm is
    P^2 (|m|^2 + 2 q n.d) = P^2 / 2, so sqrt(J2) = P / 2 for every strike, dip and rake: the mechanism cancels and
    only moment and distance stay. `tests/test_physics.py` holds the full tensor as the witness.
    """
    dx = (obs_lon - lon) * F.lit(DEG_KM) * F.cos(F.radians(lat)) * F.lit(1000.0)
    dy = (obs_lat - lat) * F.lit(DEG_KM * 1000.0)
    dz = (obs_depth - depth) * F.lit(1000.0)
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    moment = p10(F.lit(1.5) * mag + F.lit(9.05))
    return F.when(r < 500, F.lit(0.0)).otherwise(moment / (F.lit(8 * math.pi) * F.pow(F.greatest(r, F.lit(1.0)), F.lit(3.0))))


def rate_state(cfs_pa: Column, base: Column, dt_days: Column, a_sigma=10000.0, ta_days=1825.0) -> Column:
    """Seismicity rate after one stress step; the base rate when the step is tiny or not yet there."""
    e = F.exp(F.greatest(F.least(-cfs_pa / F.lit(a_sigma), F.lit(50.0)), F.lit(-50.0)))
    den = e + (F.lit(1.0) - e) * F.exp(-dt_days / F.lit(ta_days))
    calm = (F.abs(cfs_pa) < 1.0) | (dt_days <= 0) | (den <= 0) | (den > 1e10)
    return F.when(calm, base).otherwise(base / den)


def productivity(mag: Column, K=TRIGGER["K"], alpha=TRIGGER["alpha"], mc=TRIGGER["mc"]) -> Column:
    return F.lit(K) * F.exp(F.lit(alpha) * (mag - F.lit(mc)))


def omori(mag: Column, dt_days: Column, K=0.04, alpha=1.0, c=0.01, p=1.1, mc=3.0) -> Column:
    """Triggered rate dt days after an event."""
    return productivity(mag, K, alpha, mc) / F.pow(dt_days + F.lit(c), F.lit(p))


def omori_integral(mag: Column, dt0: Column, dt1: Column, K=0.04, alpha=1.0, c=0.01, p=1.1, mc=3.0) -> Column:
    """Triggered count between two ages of an event, closed form."""
    lo, hi = dt0 + F.lit(c), dt1 + F.lit(c)
    if abs(p - 1.0) < 0.01:
        body = F.log(hi) - F.log(lo)
    else:
        body = (F.pow(hi, F.lit(1 - p)) - F.pow(lo, F.lit(1 - p))) / F.lit(1 - p)
    return productivity(mag, K, alpha, mc) * F.greatest(body, F.lit(0.0))


def b_aki(n: Column, mean: Column, mc: float = 3.0, min_count: int = 20) -> Column:
    """Aki-Utsu b-value from a count and a mean magnitude; NULL when it is not defined."""
    den = mean - F.lit(mc - 0.05)
    return F.when((n >= min_count) & (den > 0.01), F.lit(LOG10_E) / den)


def b_sigma(n: Column, mean: Column, var_samp: Column, mc: float = 3.0, min_count: int = 20) -> Column:
    """Shi-Bolt standard error; var_samp / n is the variance of the mean."""
    b = b_aki(n, mean, mc, min_count)
    return F.when(var_samp > 0, F.lit(2.30) * b * b * F.sqrt(var_samp / n))


def b_min(n: Column, mean: Column, low: Column, min_count: int = 10) -> Column:
    """b-value measured from the smallest magnitude of the window."""
    return F.when((n >= min_count) & (mean - low > 0.01), F.lit(LOG10_E) / (mean - low))


def benioff(mag: Column) -> Column:
    """Square root of the radiated energy, log10 E = 1.5 M + 4.8."""
    return p10(F.lit(0.75) * mag + F.lit(2.4))


def lunar_hour_angle(t_s: Column, lon: Column) -> Column:
    """Mean lunar hour angle in degrees; t_s is epoch seconds."""
    days = (t_s - F.lit(946728000)) / F.lit(86400.0)
    moon = F.pmod(F.lit(218.3165) + F.lit(481267.8813) * (days / F.lit(36525.0)), F.lit(360.0))
    sidereal = F.pmod(F.lit(280.46061837) + F.lit(360.98564736629) * days, F.lit(360.0))
    return F.pmod(sidereal + lon - moon, F.lit(360.0))


def tidal_loading(t_s: Column, lon: Column, strike: Column) -> Column:
    phase = F.pmod(F.pmod(F.lit(2.0) * lunar_hour_angle(t_s, lon), F.lit(360.0)) - strike, F.lit(360.0))
    return (phase < 90) | ((phase >= 180) & (phase < 270))
