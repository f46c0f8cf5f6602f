import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.functions import physics as ph, scalar as sc, spatial as sp

L = F.lit


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def full_tensor(src, obs, mech, mag):
    """Stress change from the whole tensor, as the witness of the closed form."""
    (la, lo, de), (ola, olo, ode), (s, d, k) = src, obs, np.radians(mech)
    x = np.array([(olo - lo) * 111.32 * math.cos(math.radians(la)), (ola - la) * 111.32, ode - de]) * 1000
    r = np.linalg.norm(x)
    u = x / r
    n = np.array([-math.sin(d) * math.sin(s), math.sin(d) * math.cos(s), -math.cos(d)])
    v = np.array([math.cos(k) * math.cos(s) + math.sin(k) * math.cos(d) * math.sin(s), math.cos(k) * math.sin(s) - math.sin(k) * math.cos(d) * math.cos(s), -math.sin(k) * math.sin(d)])
    m = (np.outer(n, v) + np.outer(v, n)) / 2
    q = u @ m @ u
    st = 10 ** (1.5 * mag + 9.05) / (4 * math.pi * r ** 3) * (3 * q * np.outer(u, u) - m - q * np.eye(3))
    mean = np.trace(st) / 3
    dev = st - mean * np.eye(3)
    return math.sqrt(0.5 * (dev ** 2).sum()) + 0.4 * mean


@pytest.mark.parametrize("mech", [(200, 25, 90), (240, 15, 90), (30, 60, -90), (123, 45, 17)])
def test_stress_is_independent_of_mechanism(spark, mech):
    src, obs = (35.2, 141.1, 20.0), (36.0, 140.0, 15.0)
    got = value(spark, ph.stress_change(*[L(x) for x in src], L(6.4), *[L(x) for x in obs]))
    assert got == pytest.approx(full_tensor(src, obs, mech, 6.4), rel=1e-9)


def test_stress_too_close(spark):
    assert value(spark, ph.stress_change(L(35.0), L(140.0), L(10.0), L(6.0), L(35.0), L(140.0), L(10.2))) == 0.0


def test_snap_half_even(spark):
    got = [value(spark, sp.snap(L(float(x)), 2)) for x in (25, 27, 29, 26)]
    assert got == [24.0, 28.0, 28.0, 26.0]
    assert value(spark, sp.snap(L(26.3), 2, "floor_center")) == 27.0 and value(spark, sp.snap(L(26.3), 0.5, "index", 25.0)) == 2


def test_zone_priority_and_edges(spark):
    assert value(spark, sp.zone_of(L(35.5), L(141.0))) == "tohoku_offshore"
    assert value(spark, sp.zone_of(L(34.0), L(140.0))) == "kanto_tokai"
    assert value(spark, sp.zone_of(L(46.0), L(148.0))) == "hokkaido"
    assert value(spark, sp.zone_of(L(27.0), L(129.0))) == "other"


def test_fault_class(spark):
    assert [value(spark, ph.fault_class(L(float(r)))) for r in (0, 90, -90, 170, -170, 30, 31, 270, 179)] == [
        "strike_slip", "reverse", "normal", "strike_slip", "strike_slip", "strike_slip", "reverse", "normal", "strike_slip"]


def test_rate_state(spark):
    assert value(spark, ph.rate_state(L(0.5), L(0.01), L(10.0))) == 0.01
    assert value(spark, ph.rate_state(L(2e4), L(0.01), L(0.0))) == 0.01
    e = math.exp(-2)
    assert value(spark, ph.rate_state(L(2e4), L(0.01), L(100.0))) == pytest.approx(0.01 / (e + (1 - e) * math.exp(-100 / 1825)))


def test_rate_state_grows_with_stress_and_age(spark):
    """The pruning of dominated sources in the stress features rests on this."""
    f = lambda s, t: value(spark, ph.rate_state(L(s), L(0.02), L(t)))
    vals = [f(s, 50.0) for s in (10.0, 1e3, 1e4, 1e5, 1e6)]
    ages = [f(3e4, t) for t in (1.0, 10.0, 100.0, 2000.0)]
    assert vals == sorted(vals) and ages == sorted(ages)


def test_b_value_guards(spark):
    assert value(spark, ph.b_aki(L(19), L(3.5))) is None
    assert value(spark, ph.b_aki(L(20), L(3.5))) == pytest.approx(math.log10(math.e) / 0.55)
    assert value(spark, ph.b_aki(L(20), L(2.95))) is None and value(spark, ph.b_min(L(30), L(3.0), L(3.0))) is None


def test_probability_functions(spark):
    for x in (-3.1, -0.4, 0.0, 1.7):
        assert value(spark, sc.normal_cdf(L(x))) == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-7)
    lam, k = 7.3, 5
    pois = [math.exp(-lam) * lam ** i / math.factorial(i) for i in range(40)]
    assert value(spark, sc.poisson_cdf(L(k), L(lam))) == pytest.approx(sum(pois[:k + 1]))
    want = next(i for i in range(40) if sum(pois[:i + 1]) >= 0.975)
    assert value(spark, sc.poisson_quantile(0.975, L(lam))) == want
    assert value(spark, sc.log_factorial(L(9))) == pytest.approx(math.lgamma(10))


def test_feature_floors(spark):
    assert value(spark, sc.log_floor(L(None).cast("double"), 1e-9)) == -9.0
    assert value(spark, sc.log_floor(L(1e-4), 1e-9)) == pytest.approx(-4)
    assert value(spark, sc.z_floor(L(5.0), L(3.0), L(0.0), 0.1)) == pytest.approx(2.0)
    assert value(spark, sc.z_floor(L(0.0), L(3.0), L(1.0), 0.1)) == 0.0
