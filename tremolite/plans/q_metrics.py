"""Scores, nulls, threshold searches and forecast tests (A31-A53, A57-A60, A63-A70, G09-G16, M*)."""

from __future__ import annotations

import math

from pyspark.sql import Window as W, functions as F

from ..functions import physics as ph, scalar as sc, spatial as sp
from ..operators import expand as ex, joins as jn, metrics as mt, ordered as od, resample as rs, sinks as sk
from . import features as ft, seismicity as se
from .q_basic import DAY, R
from .q_features import KEYS, PAST, cat
from .q_joins import CELL_SQL, GRID_SQL, catalogue_cells, grid_points, isolated
from .q_seismic import FORECAST_SQL, MODELS, T0, forecasts
from .q_windows import pre_event_z, _PREZ, _gsql
from .registry import query

c, lit = F.col, F.lit


@query("A31_threshold_skill", """WITH th AS (SELECT unnest([5e-2,1e-1,15e-2,2e-1,3e-1,4e-1,5e-1,6e-1,7e-1,8e-1]) AS threshold), s AS (SELECT y, p FROM scores), n AS (SELECT sum(y) AS np, count(*) AS na FROM s), a AS (SELECT threshold, count(*) FILTER (p >= threshold AND y=1) AS tp, count(*) FILTER (p >= threshold AND y=0) AS fp FROM th, s GROUP BY 1)
  SELECT threshold, tp+fp AS n_alarms, tp, fp, CAST(np-tp AS BIGINT) AS fn, round(tp/greatest(tp+fp,1), 6) AS precision, round(tp/greatest(np,1), 6) AS recall, round(fp/greatest(na-np,1), 6) AS false_alarm_rate, round(tp/greatest(tp+fp,1)/greatest(np/na,1e-6), 6) AS probability_gain,
   round(CASE WHEN tp > 0 THEN log2(greatest(tp/greatest(tp+fp,1)/greatest(np/na,1e-6), 1e-6)) ELSE -10 END, 6) + 0.0 AS igpe_bits, round((tp+fp)/na, 6) AS alarm_fraction, 0.0 + round(tp/greatest(np,1)-(tp+fp)/na, 6) AS molchan_score FROM a, n""")
def a31(v):
    t = mt.threshold_skill(v.scores, "y", "p")
    return t.select("threshold", "n_alarms", "tp", "fp", "fn", *[R(c(x)).alias(x) for x in ("precision", "recall", "false_alarm_rate", "probability_gain", "igpe_bits", "alarm_fraction", "molchan_score")])


_CURVE = """g AS (SELECT p, sum(y) AS a, sum(1-y) AS b FROM scores GROUP BY p), r AS (SELECT *, sum(a) OVER (ORDER BY p DESC) AS tp, sum(b) OVER (ORDER BY p DESC) AS fp FROM g), n AS (SELECT sum(a) AS np, sum(b) AS nn FROM g)"""


@query("A32_roc_auc", f"WITH {_CURVE} SELECT CAST(any_value(np) AS BIGINT) AS n_pos, CAST(any_value(nn) AS BIGINT) AS n_neg, round(sum(b*(tp+tp-a))/2e0/any_value(np)/any_value(nn), 8) AS auc FROM r, n")
def a32(v):
    return mt.roc_auc(v.scores, "y", "p").withColumn("auc", R(c("auc"), 8))


@query("A32b_roc_curve", f"WITH {_CURVE} SELECT p AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM r")
def a32b(v):
    return mt.score_curve(v.scores, "y", "p").select("score", "tp", "fp")


@query("A33_molchan_skill", f"WITH {_CURVE} SELECT 0.0 + round(1 - 2*sum((a+b)/(np+nn)*((1-tp/np)+(1-(tp-a)/np))/2), 8) AS molchan_skill FROM r, n")
def a33(v):
    return mt.molchan_skill(v.scores, "y", "p").select(R(c("molchan_skill"), 8).alias("molchan_skill"))


@query("A34_reliability", """SELECT CAST(least(floor(p*10), 9) AS INT) AS bin, round((least(floor(p*10), 9)+5e-1)/1e1, 6) AS bin_center, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS mean_observed, count(*) AS n FROM scores GROUP BY 1, 2""")
def a34(v):
    return mt.reliability(v.scores, "y", "p").select("bin", R(c("bin_center")).alias("bin_center"), R(c("mean_predicted")).alias("mean_predicted"), R(c("mean_observed")).alias("mean_observed"), "n")


@query("A35_log_loss", "SELECT round(avg(-(y*ln(greatest(least(p,1-1e-15),1e-15)) + (1-y)*ln(1-greatest(least(p,1-1e-15),1e-15)))), 8) AS log_loss FROM scores")
def a35(v):
    return v.scores.agg(R(F.avg(sc.log_loss_term(c("y"), c("p"))), 8).alias("log_loss"))


_FAUC = """l AS (SELECT unnest(['p','qty','price','disc']) AS feature, unnest([p, CAST(qty AS DOUBLE), price, disc]) AS v, y, fold FROM scores)"""


@query("A36_feature_auc", f"""WITH {_FAUC}, g AS (SELECT feature, v, sum(y) AS a, sum(1-y) AS b FROM l GROUP BY 1,2), r AS (SELECT *, sum(a) OVER (PARTITION BY feature ORDER BY v DESC) AS tp FROM g), s AS (SELECT feature, sum(b*(tp+tp-a))/2e0/sum(a)/sum(b) AS auc FROM r GROUP BY 1)
  SELECT feature, round(greatest(auc, 1-auc), 8) AS auc, CASE WHEN auc >= 5e-1 THEN 'higher_risk' ELSE 'lower_risk' END AS direction FROM s""")
def a36(v):
    return mt.feature_auc(v.scores, "y", ["p", "qty", "price", "disc"]).withColumn("auc", R(c("auc"), 8))


@query("A37_mutual_information", """WITH d AS (SELECT least(CAST(floor(p*10) AS INT), 9) AS x, CAST(floor(disc*100) AS INT) AS z FROM scores), j AS (SELECT x, z, count(*) AS n FROM d GROUP BY 1,2), a AS (SELECT x, sum(n) AS nx FROM j GROUP BY 1), b AS (SELECT z, sum(n) AS nz FROM j GROUP BY 1), t AS (SELECT sum(n) AS t FROM j)
  SELECT round(sum(n/t*log2(n/t/((nx/t)*(nz/t)))), 9) AS mi_bits, CAST(any_value(t) AS BIGINT) AS n FROM j JOIN a USING (x) JOIN b USING (z), t""")
def a37(v):
    d = v.scores.select(F.least(F.floor(c("p") * 10), lit(9)).alias("x"), F.floor(c("disc") * 100).alias("z"))
    return mt.mutual_information(d, "x", "z").select(R(c("mi_bits"), 9).alias("mi_bits"), "n")


@query("A38_distribution_summary", """SELECT name, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(CAST(value > 100 AS INT)), 6) AS share_above, round(avg(CAST(value < 10 AS INT)), 6) AS share_below FROM series GROUP BY 1""")
def a38(v):
    from ..operators.aggregates import summary
    s = summary(v.series, ["name"], "value", {"p10": 0.1, "median": 0.5, "p90": 0.9}, {"share_above": c("value") > 100, "share_below": c("value") < 10})
    return s.select("name", "n", *[R(c(x)).alias(x) for x in ("mean", "p10", "median", "p90", "share_above", "share_below")])


_X = "((k*7919 + b*5381 + b*b*31) % 10007)"
_U = f"({_X}*{_X} % 10007 * {_X} % 10007)/10007e0"
_W = "(" + " + ".join(f"CAST({_U} >= {t!r}e0 AS INT)" for t in rs.POISSON1) + ")"
_DAYV = "dv AS (SELECT name, t_us // 86400000000 AS k, avg(value) AS v FROM series GROUP BY 1, 2)"


def day_values(v):
    return v.series.groupBy("name", F.floor(c("t_us") / lit(86400000000)).alias("k")).agg(F.avg("value").alias("v"))


@query("A40_bootstrap_mean", f"""WITH {_DAYV}, w AS (SELECT name, b, v, {_W} AS w FROM dv, range(200) r(b)), m AS (SELECT name, b, sum(w*v)/sum(w) AS m FROM w GROUP BY 1,2 HAVING sum(w) > 0)
  SELECT name, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, round(avg(m), 6) AS boot_mean FROM m GROUP BY 1""")
def a40(v):
    b = rs.bootstrap_mean(day_values(v), ["name"], "k", "v", 200)
    return b.select("name", *[R(c(x)).alias(x) for x in ("ci_low", "ci_high", "boot_mean")])


@query("A40b_bootstrap_difference", f"""WITH {_DAYV}, w AS (SELECT name, b, v, {_W} AS w FROM dv, range(200) r(b) WHERE name IN ('click', 'error')), m AS (SELECT b, sum(w*v) FILTER (name='click')/sum(w) FILTER (name='click') - sum(w*v) FILTER (name='error')/sum(w) FILTER (name='error') AS d,
   (sum(CASE WHEN v > 60 THEN w ELSE 0 END) FILTER (name='click')/sum(w) FILTER (name='click'))/nullif(sum(CASE WHEN v > 60 THEN w ELSE 0 END) FILTER (name='error')/sum(w) FILTER (name='error'), 0) AS lift FROM w GROUP BY 1)
  SELECT 0.0 + round(quantile_cont(d, 0.025), 6) AS diff_low, 0.0 + round(quantile_cont(d, 0.975), 6) AS diff_high, round(quantile_cont(lift, 0.025), 6) AS lift_low, round(quantile_cont(lift, 0.975), 6) AS lift_high FROM m""")
def a40b(v):
    w = rs.bootstrap(day_values(v).where("name IN ('click', 'error')"), ["name"], "k", 200)
    part = lambda name, x: F.sum(F.when(c("name") == name, x))
    mean = lambda name: part(name, c("w") * c("v")) / part(name, c("w"))
    share = lambda name: part(name, F.when(c("v") > 60, c("w")).otherwise(0)) / part(name, c("w"))
    m = w.groupBy("b").agg((mean("click") - mean("error")).alias("d"), F.try_divide(share("click"), F.nullif(share("error"), lit(0.0))).alias("lift"))
    q = lambda col, p: R(F.percentile(col, lit(p)))
    return m.agg(q("d", 0.025).alias("diff_low"), q("d", 0.975).alias("diff_high"), q("lift", 0.025).alias("lift_low"), q("lift", 0.975).alias("lift_high"))


_MI = """dd AS (SELECT h, CAST(least(floor(avg(value)/20), 9) AS INT) AS x, CAST(least(count(*), 9) AS INT) AS z FROM series GROUP BY h)"""


@query("A41_permutation_null", f"""WITH {_MI}, rk AS (SELECT h, x, z, row_number() OVER (ORDER BY h) AS i FROM dd), sh AS (SELECT b, z, row_number() OVER (PARTITION BY b ORDER BY (i*7919 + b*104729 + (i % 97)*(b % 89)*31) % 10007, i) AS i FROM rk, range(1, 51) r(b)),
  pr AS (SELECT b, x, sh.z FROM sh JOIN rk USING (i) UNION ALL SELECT 0, x, z FROM rk), j AS (SELECT b, x, z, count(*) AS n FROM pr GROUP BY 1,2,3), t AS (SELECT *, sum(n) OVER (PARTITION BY b) AS t, sum(n) OVER (PARTITION BY b, x) AS nx, sum(n) OVER (PARTITION BY b, z) AS nz FROM j), m AS (SELECT b, sum(n/t*log2(n*t/(nx*nz))) AS mi FROM t GROUP BY 1)
  SELECT round(max(mi) FILTER (b = 0), 6) AS observed, round(avg(mi) FILTER (b > 0), 6) AS null_mean, round(quantile_cont(mi, 0.95) FILTER (b > 0), 6) AS null_p95, count(*) FILTER (b > 0 AND mi >= (SELECT mi FROM m WHERE b = 0)) AS n_as_large FROM m""")
def a41(v):
    d = v.series.groupBy("h").agg(F.least(F.floor(F.avg("value") / 20), lit(9)).cast("int").alias("x"), F.least(F.count(lit(1)), lit(9)).cast("int").alias("z"))
    r = d.withColumn("i", F.row_number().over(W.partitionBy(lit(0)).orderBy("h")).cast("long"))  # one row per hour
    b = r.select("i", "z", F.explode(F.sequence(lit(1).cast("long"), lit(50).cast("long"))).alias("b"))
    order = (c("i") * 7919 + c("b") * 104729 + (c("i") % 97) * (c("b") % 89) * 31) % 10007
    sh = b.select("b", "z", F.row_number().over(W.partitionBy("b").orderBy(order, "i")).cast("long").alias("i"))
    pairs = sh.join(r.select("i", "x"), "i").select("b", "x", "z").unionByName(r.select(lit(0).cast("long").alias("b"), "x", "z"))
    m = mt.mutual_information(pairs, "x", "z", ["b"])
    null = F.when(c("b") > 0, c("mi_bits"))
    obs = F.max(F.when(c("b") == 0, c("mi_bits"))).over(W.partitionBy(lit(0)))
    m = m.withColumn("obs", obs)  # one row per replicate
    return m.agg(R(F.max("obs")).alias("observed"), R(F.avg(null)).alias("null_mean"), R(F.percentile(null, lit(0.95))).alias("null_p95"), F.count_if((c("b") > 0) & (c("mi_bits") >= c("obs"))).alias("n_as_large"))


def indicators(v):
    """Three indicators per event and its group; the group is the magnitude class."""
    return v.quakes.select("event_id", (c("mag") >= 4).alias("target"), (c("depth_km") / lit(90.0)).alias("i1"), (c("lat") - F.floor("lat")).alias("i2"), (c("lon") - F.floor("lon")).alias("i3"))


_IND = "ind AS (SELECT event_id, mag >= 4 AS target, depth_km/9e1 AS i1, lat-floor(lat) AS i2, lon-floor(lon) AS i3 FROM quakes)"


@query("A43_threshold_grid", f"""WITH {_IND}, t AS (SELECT unnest([5e-1,7e-1,9e-1]) AS a), g AS (SELECT x.a AS t1, y.a AS t2, z.a AS t3, k, avg(CAST(CAST(i1>=x.a AS INT)+CAST(i2>=y.a AS INT)+CAST(i3>=z.a AS INT) >= k AS INT)) FILTER (target) AS r1, avg(CAST(CAST(i1>=x.a AS INT)+CAST(i2>=y.a AS INT)+CAST(i3>=z.a AS INT) >= k AS INT)) FILTER (NOT target) AS r0 FROM ind, t x, t y, t z, range(2,4) r(k) GROUP BY 1,2,3,4)
  SELECT t1, t2, t3, CAST(k AS INT) AS k, round(r1, 6) AS target_rate, round(r0, 6) AS control_rate, round(r1/nullif(r0,0), 6) AS lift FROM g ORDER BY round(r1/nullif(r0,0), 6) DESC NULLS LAST, t1, t2, t3, k LIMIT 10""")
def a43(v):
    th = [0.5, 0.7, 0.9]
    level = lambda x: sum(((c(x) >= t).cast("int") for t in th[1:]), (c(x) >= th[0]).cast("int"))
    # events collapse to their threshold levels (4 x 4 x 4 x 2 rows) before the parameter grid is applied
    g = indicators(v).groupBy("target", level("i1").alias("l1"), level("i2").alias("l2"), level("i3").alias("l3")).agg(F.count(lit(1)).alias("n"))
    for i in (1, 2, 3):
        g = ex.with_values(g, [1, 2, 3], f"q{i}")
    g = ex.with_values(g, [2, 3], "k")
    hits = sum(((c(f"l{i}") >= c(f"q{i}")).cast("int") for i in (2, 3)), (c("l1") >= c("q1")).cast("int"))
    hit = F.when(hits >= c("k"), c("n")).otherwise(0)
    rate = lambda cond: F.sum(F.when(cond, hit)) / F.sum(F.when(cond, c("n")))
    a = g.groupBy("q1", "q2", "q3", "k").agg(rate(c("target")).alias("r1"), rate(~c("target")).alias("r0"))
    val = lambda q: F.element_at(F.array(*[lit(t) for t in th]), c(q))
    out = a.select(val("q1").alias("t1"), val("q2").alias("t2"), val("q3").alias("t3"), "k", R(c("r1")).alias("target_rate"), R(c("r0")).alias("control_rate"), R(F.try_divide(c("r1"), c("r0"))).alias("lift"))
    return out.orderBy(F.desc_nulls_last("lift"), "t1", "t2", "t3", "k").limit(10)


@query("A44_anomaly_histogram", f"""WITH {_IND}, a AS (SELECT target, CAST(i1>=8e-1 AS INT)+CAST(i2>=8e-1 AS INT)+CAST(i3>=8e-1 AS INT) AS k FROM ind) SELECT CAST(target AS INT) AS target, k AS n_anomalies, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY target), 6) AS share FROM a GROUP BY target, k""")
def a44(v):
    k = (c("i1") >= 0.8).cast("int") + (c("i2") >= 0.8).cast("int") + (c("i3") >= 0.8).cast("int")
    g = indicators(v).groupBy(c("target").cast("int").alias("target"), k.alias("n_anomalies")).agg(F.count(lit(1)).alias("n"))
    return g.withColumn("share", R(c("n") / F.sum("n").over(W.partitionBy("target"))))


@query("A45_indicator_lift", f"""WITH {_IND}, l AS (SELECT target, unnest(['i1','i2','i3']) AS indicator, unnest([i1,i2,i3]) AS x FROM ind), q AS (SELECT indicator, quantile_cont(x, 0.9) FILTER (NOT target) AS cut FROM l GROUP BY 1)
  SELECT indicator, round(any_value(cut), 6) AS cutoff, round(avg(CAST(x > cut AS INT)) FILTER (target), 6) AS target_rate, round(avg(CAST(x > cut AS INT)) FILTER (NOT target), 6) AS control_rate, round(avg(CAST(x > cut AS INT)) FILTER (target)/avg(CAST(x > cut AS INT)) FILTER (NOT target), 6) AS lift FROM l JOIN q USING (indicator) GROUP BY 1""")
def a45(v):
    l = indicators(v).unpivot(["target"], ["i1", "i2", "i3"], "indicator", "x")
    cut = od.exact_quantiles(l.where(~c("target")), ["indicator"], "x", {"cut": 0.9}).drop("n")
    hot = (c("x") > c("cut")).cast("double")
    g = l.join(cut, "indicator").groupBy("indicator").agg(F.max("cut").alias("cut"), F.avg(F.when(c("target"), hot)).alias("r1"), F.avg(F.when(~c("target"), hot)).alias("r0"))
    return g.select("indicator", R(c("cut")).alias("cutoff"), R(c("r1")).alias("target_rate"), R(c("r0")).alias("control_rate"), R(c("r1") / c("r0")).alias("lift"))


@query("A46_joint_thresholds", f"""WITH {_IND}, t AS (SELECT unnest([5e-1,7e-1,9e-1]) AS a) SELECT x.a AS t1, y.a AS t2, round(avg(CAST(i1>=x.a AND i2>=y.a AS INT)) FILTER (target), 6) AS target_rate, round(avg(CAST(i1>=x.a AND i2>=y.a AS INT)) FILTER (NOT target), 6) AS control_rate FROM ind, t x, t y GROUP BY 1,2""")
def a46(v):
    th = [0.5, 0.7, 0.9]
    aggs = []
    for a in th:
        for b in th:
            hot = ((c("i1") >= a) & (c("i2") >= b)).cast("double")
            aggs.append(F.struct(lit(a).alias("t1"), lit(b).alias("t2"), R(F.avg(F.when(c("target"), hot))).alias("target_rate"), R(F.avg(F.when(~c("target"), hot))).alias("control_rate")))
    return indicators(v).agg(F.array(*aggs).alias("x")).select(F.inline("x"))


@query("A47_grouping_sets", """SELECT CASE WHEN dn < 10300 THEN 'early' ELSE 'late' END AS period, concat('M', CAST(floor(mag) AS INT)) AS mag_class, CAST(depth_km < 30 AS INT) AS shallow, count(*) AS n, round(avg(mag), 8) AS mean_mag FROM quakes GROUP BY GROUPING SETS ((1), (2), (3), (1,2), ())""")
def a47(v):
    q = v.quakes.select(F.when(c("dn") < 10300, "early").otherwise("late").alias("period"), F.concat(lit("M"), F.floor("mag").cast("int")).alias("mag_class"), (c("depth_km") < 30).cast("int").alias("shallow"), "mag")
    p, m, s = c("period"), c("mag_class"), c("shallow")
    return q.groupingSets([[p], [m], [s], [p, m], []], p, m, s).agg(F.count(lit(1)).alias("n"), R(F.avg("mag"), 8).alias("mean_mag"))


# ---- forecast tests -------------------------------------------------------------------------------------------------

_FC90 = FORECAST_SQL.replace("2000e0*7", "2000e0*90").replace("2000e0-day+7+1e-2", "2000e0-day+90+1e-2").replace("AS uniform, coalesce(sm,0)/2000e0*7", "AS uniform, coalesce(sm,0)/2000e0*90")
_TEST = _FC90 + """, ob AS (SELECT ci, cj, count(*) AS obs FROM quakes WHERE mag >= 5 AND (t-788918400)/864e2 >= 2000 AND (t-788918400)/864e2 < 2090 GROUP BY 1,2), ft AS (SELECT fc.*, coalesce(obs, 0) AS obs FROM fc LEFT JOIN ob USING (ci, cj)),
  ml AS (SELECT ci, cj, obs, unnest(['uniform','smoothed','relative_intensity','simple_etas']) AS model, unnest([uniform, smoothed, relative_intensity, simple_etas]) AS rate FROM ft)"""


def with_observed(v, start=2000, window=90):
    day = (c("t") - T0) / lit(float(DAY))
    o = v.quakes.where((c("mag") >= 5) & (day >= start) & (day < start + window)).groupBy("ci", "cj").agg(F.count(lit(1)).alias("obs"))
    return forecasts(v, start, window).join(o, ["ci", "cj"], "left").withColumn("obs", F.coalesce("obs", lit(0)))


def by_model(f):
    return f.unpivot(["ci", "cj", "obs"], MODELS, "model", "rate")


@query("A49_n_and_l_test", f"""WITH {_TEST}, a AS (SELECT model, sum(rate) AS tf, CAST(sum(obs) AS BIGINT) AS tob, sum(obs*ln(greatest(rate,1e-10)) - greatest(rate,1e-10) - lgamma(obs+1)) AS ll, count(*) AS n FROM ml GROUP BY 1)
  SELECT model, round(tf, 6) AS total_forecast, tob AS total_observed, round(ll, 5) AS log_likelihood, n AS n_cells, round(least((SELECT sum(exp(-tf + k*ln(tf) - lgamma(k+1))) FROM range(0, tob+1) r(k)), 1), 6) AS p_value FROM a""")
def a49(v):
    m = by_model(with_observed(v))
    rate = F.greatest(c("rate"), lit(1e-10))
    g = m.groupBy("model").agg(F.sum("rate").alias("tf"), F.sum("obs").alias("tob"), F.sum(c("obs") * F.log(rate) - rate - sc.log_factorial(c("obs"))).alias("ll"), F.count(lit(1)).alias("n"))
    return g.select("model", R(c("tf")).alias("total_forecast"), c("tob").alias("total_observed"), R(c("ll"), 5).alias("log_likelihood"), c("n").alias("n_cells"), R(sc.poisson_cdf(c("tob"), c("tf"))).alias("p_value"))


@query("A49b_paired_t_test", f"""WITH {_TEST}, d AS (SELECT model, obs*ln(greatest(simple_etas,1e-10))-greatest(simple_etas,1e-10) - (obs*ln(greatest(rate,1e-10))-greatest(rate,1e-10)) AS d FROM ft JOIN ml USING (ci, cj, obs) WHERE model <> 'simple_etas')
  SELECT model, count(*) AS n_cells, 0.0 + round(avg(d), 8) AS mean_ll_diff, 0.0 + round(avg(d)/(CASE WHEN var_samp(d) > 0 THEN sqrt(var_samp(d)/count(*)) ELSE 1e-10 END), 5) AS t_statistic FROM d GROUP BY 1""")
def a49b(v):
    f = with_observed(v)
    ll = lambda r: c("obs") * F.log(F.greatest(r, lit(1e-10))) - F.greatest(r, lit(1e-10))
    d = f.withColumn("ref", c("simple_etas")).unpivot(["obs", "ref"], MODELS[:3], "model", "rate").withColumn("d", ll(c("ref")) - ll(c("rate")))
    g = d.groupBy("model").agg(F.count(lit(1)).alias("n_cells"), F.avg("d").alias("m"), F.var_samp("d").alias("s"))
    return g.select("model", "n_cells", R(c("m"), 8).alias("mean_ll_diff"), R(c("m") / F.when(c("s") > 0, F.sqrt(c("s") / c("n_cells"))).otherwise(1e-10), 5).alias("t_statistic"))


@query("F16_poisson_normal", f"""WITH l AS (SELECT ci, cj, count(*)/1e1 AS lam FROM quakes GROUP BY 1,2)
  SELECT ci, cj, round((SELECT sum(exp(-lam + k*ln(lam) - lgamma(k+1))) FROM range(0, 11) r(k)), 6) AS cdf10, round(lgamma(CAST(round(lam*10) AS DOUBLE)+1), 5) AS ln_fact FROM l""")
def f16(v):
    l = v.quakes.groupBy("ci", "cj").agg((F.count(lit(1)) / lit(10.0)).alias("lam"), F.count(lit(1)).alias("n"))
    return l.select("ci", "cj", R(sc.poisson_cdf(lit(10), c("lam"))).alias("cdf10"), R(sc.log_factorial(c("n")), 5).alias("ln_fact"))


@query("F18_gain_bits", """SELECT fold, round((avg(CASE WHEN p >= 5e-1 THEN y END))/avg(y), 6) AS gain, 0.0 + round(log2(avg(CASE WHEN p >= 5e-1 THEN y END)/avg(y)), 6) AS bits FROM scores GROUP BY 1""")
def f18(v):
    g = v.scores.groupBy("fold").agg(F.avg(F.when(c("p") >= 0.5, c("y"))).alias("a"), F.avg("y").alias("b"))
    return g.select("fold", R(sc.gain(c("a"), c("b"))).alias("gain"), R(sc.bits(sc.gain(c("a"), c("b")))).alias("bits"))


@query("A53_elapsed_scoring", f"""WITH {_TEST}, z AS (SELECT model, least(1, obs) AS y, 1-exp(-rate) AS p FROM ml), gg AS (SELECT model, round(p,12) AS p, sum(y) AS a, sum(1-y) AS b FROM z GROUP BY 1,2), r AS (SELECT *, sum(a) OVER (PARTITION BY model ORDER BY p DESC) AS tp FROM gg), u AS (SELECT model, sum(b*(tp+tp-a))/2e0/sum(a)/sum(b) AS auc FROM r GROUP BY 1)
  SELECT model, CAST(sum(y) AS BIGINT) AS n_hit, round(avg(pow(p-y,2)), 8) AS brier, CASE WHEN model = 'uniform' THEN 5e-1 ELSE round(any_value(auc), 3) END AS auc FROM z JOIN u USING (model) GROUP BY model""")
def a53(v):
    m = by_model(with_observed(v)).select("model", F.least(c("obs"), lit(1)).alias("y"), (lit(1.0) - F.exp(-c("rate"))).alias("p"))
    # equal forecasts that differ in the last digit must tie, so scores are ranked on 12 digits
    auc = mt.roc_auc(m.withColumn("ps", F.round("p", 12)), "y", "ps", ["model"]).select("model", R(c("auc"), 3).alias("auc"))
    return m.groupBy("model").agg(F.sum("y").alias("n_hit"), R(F.avg(F.pow(c("p") - c("y"), 2)), 8).alias("brier")).join(auc, "model")


# Magnitude bins of the forecasts.
MAG_BINS = [(5.0, 5.5), (5.5, 6.0), (6.0, 6.5), (6.5, 7.0), (7.0, 7.5), (7.5, 8.0), (8.0, 9.0)]


def bin_rates(df, prob, window, b=1.0, bins=MAG_BINS):
    """Probability of a strong event to a rate per magnitude bin, Gutenberg-Richter split; the last bin is open."""
    p = F.least(c(prob), lit(0.999))
    total = F.when(c(prob) <= 0, 0.0).otherwise(-F.log(lit(1.0) - p) / lit(float(window)))
    frac = lambda lo, hi: 10 ** (-b * (lo - 5.0)) - (10 ** (-b * (hi - 5.0)) if hi < 9.0 else 0.0)
    arr = F.array(*[F.struct(lit(lo).alias("mag_min"), lit(hi).alias("mag_max"), lit(max(frac(lo, hi), 0.0)).alias("f")) for lo, hi in bins])
    out = df.withColumn("_t", total).withColumn("_b", F.explode(arr))
    return out.select(*df.columns, "_b.mag_min", "_b.mag_max", (c("_t") * c("_b.f")).alias("rate"))


_BINSQL = ", ".join(f"({lo!r}, {hi!r}, {max(10 ** (-(lo - 5.0)) - (10 ** (-(hi - 5.0)) if hi < 9.0 else 0.0), 0.0)!r})" for lo, hi in MAG_BINS)


@query("F15_bin_rates", f"""WITH {_FC90}, b(mag_min, mag_max, f) AS (VALUES {_BINSQL}) SELECT ci, cj, CAST(mag_min AS DOUBLE) AS mag_min, CAST(mag_max AS DOUBLE) AS mag_max, round(-ln(1-least(1-exp(-simple_etas), 999e-3))/90e0*f, 11) AS rate FROM fc, b""")
def f15(v):
    p = forecasts(v, 2000, 90).select("ci", "cj", (lit(1.0) - F.exp(-c("simple_etas"))).alias("prob"))
    return bin_rates(p, "prob", 90).select("ci", "cj", "mag_min", "mag_max", R(c("rate"), 11).alias("rate"))


_G15 = f"""WITH {_FC90}, b(mag_min, mag_max, f) AS (VALUES {_BINSQL}) SELECT ci*2e0-1 AS lat_min, ci*2e0+1 AS lat_max, cj*2e0-1 AS lon_min, cj*2e0+1 AS lon_max, 0e0 AS depth_min, 1e2 AS depth_max, CAST(mag_min AS DOUBLE) AS mag_min, CAST(mag_max AS DOUBLE) AS mag_max, round(-ln(1-least(1-exp(-smoothed), 999e-3))/90e0*f, 11) AS rate FROM fc, b"""


@query("G15_forecast_table", _G15)
def g15(v):
    p = forecasts(v, 2000, 90).select("ci", "cj", (lit(1.0) - F.exp(-c("smoothed"))).alias("prob"))
    b = bin_rates(p, "prob", 90)
    la, lo = c("ci") * lit(2.0), c("cj") * lit(2.0)
    return b.select((la - 1).alias("lat_min"), (la + 1).alias("lat_max"), (lo - 1).alias("lon_min"), (lo + 1).alias("lon_max"), lit(0.0).alias("depth_min"), lit(100.0).alias("depth_max"), "mag_min", "mag_max", R(c("rate"), 11).alias("rate"))


@query("K08b_forecast_xml_cells", _G15)
def k08b(v):
    """The forecast written as XML, one element per cell and bin, and read back from the files."""
    b, path = g15(v), sk.scratch(v.spark, "forecast-xml")
    sk.export_xml(b, path)
    return sk.read_xml(v.spark, path, ", ".join(f"{x} double" for x in b.columns))


@query("F19_forecast_json")
def f19(v):
    b = g15(v)
    cell = F.struct("lat_min", "lat_max", "lon_min", "lon_max", "mag_min", "mag_max", "rate")
    return b.select("lat_min", "lon_min", "mag_min", F.to_json(cell).alias("cell_json"))


# Days of a test window, days from one window to the next, days of the catalogue before the first.
TEST_DAYS, TEST_STEP, TRAIN_DAYS = 7, 30, 365

_WINDOWS = CELL_SQL + f""", q AS (SELECT *, (t-788918400)/864e2 AS day FROM quakes), b AS (SELECT floor(min(day))+{TRAIN_DAYS} AS f, max(day) AS l FROM q),
  w AS (SELECT k, f+{TEST_STEP}*k AS start FROM (SELECT f, unnest(range(0, CAST(floor((l-{TEST_DAYS}-f)/{TEST_STEP}) AS BIGINT)+1)) AS k FROM b)),
  cc AS (SELECT k, ci, cj, count(*) FILTER (mag>=5) AS m5, count(*) FILTER (mag>=3) AS m3 FROM w JOIN q ON day < start GROUP BY 1,2,3),
  g AS (SELECT w.k, start, cells.ci, cells.cj, coalesce(m5,0) AS m5, coalesce(m3,0) AS m3 FROM cells CROSS JOIN w LEFT JOIN cc ON cc.k=w.k AND cc.ci=cells.ci AND cc.cj=cells.cj),
  tt AS (SELECT k, sum(m5) AS t5, sum(m3) AS t3, count(*) AS n FROM g GROUP BY 1),
  sm AS (SELECT g.k, g.ci, g.cj, sum(exp(-5e-1*(pow((g.ci-s.ci)*2,2)+pow((g.cj-s.cj)*2,2))/4e0)*s.m5)/sum(exp(-5e-1*(pow((g.ci-s.ci)*2,2)+pow((g.cj-s.cj)*2,2))/4e0)) AS sm FROM g JOIN g s ON s.k = g.k AND s.m5 > 0 GROUP BY 1,2,3),
  tr AS (SELECT g.k, g.ci, g.cj, sum(4e-2*exp(mag-3)*greatest((pow(start-day+{TEST_DAYS}+1e-2, 1-11e-1)-pow(start-day+1e-2, 1-11e-1))/(1-11e-1), 0)*exp(-5e-1*(pow(lat-g.ci*2,2)+pow(lon-g.cj*2,2)))) AS tr FROM g JOIN q ON abs(lat-g.ci*2) <= 3 AND abs(lon-g.cj*2) <= 3 AND day < start AND day > start-365 WHERE mag >= 4 GROUP BY 1,2,3),
  ob AS (SELECT k, ci, cj, count(*) AS obs FROM w JOIN q ON day >= start AND day < start+{TEST_DAYS} WHERE mag >= 5 GROUP BY 1,2,3),
  fc AS (SELECT g.k, g.start, g.ci, g.cj, coalesce(obs,0) AS obs, t5/greatest(start,1)*{TEST_DAYS}/n AS uniform, coalesce(sm,0)/greatest(start,1)*{TEST_DAYS} AS smoothed, m3/greatest(t3,1)*(t5/greatest(start,1)*{TEST_DAYS}) AS relative_intensity, m5/greatest(start,1)*{TEST_DAYS} + coalesce(tr,0)*1e-2 AS simple_etas
    FROM g JOIN tt USING (k) LEFT JOIN sm USING (k, ci, cj) LEFT JOIN tr USING (k, ci, cj) LEFT JOIN ob USING (k, ci, cj)),
  ml AS (SELECT k, start, ci, cj, obs, unnest(['uniform','smoothed','relative_intensity','simple_etas']) AS model, unnest([uniform, smoothed, relative_intensity, simple_etas]) AS rate FROM fc),
  rk AS (SELECT *, row_number() OVER x AS place, sum(obs) OVER (x ROWS UNBOUNDED PRECEDING) AS cum, sum(obs) OVER (PARTITION BY model, k) AS tob, count(*) OVER (PARTITION BY model, k) AS n FROM ml WINDOW x AS (PARTITION BY model, k ORDER BY round(rate, 12) DESC, ci, cj)),
  ws AS (SELECT model, k, start, sum(rate) AS tf, CAST(sum(obs) AS BIGINT) AS tob, sum(obs*ln(greatest(rate,1e-10)) - greatest(rate,1e-10)) AS ll,
    CASE WHEN max(tob) > 0 THEN 1 - 2*sum((2e0 - (cum-obs)/greatest(tob,1) - cum/greatest(tob,1))/2/n) ELSE 0 END AS skill FROM (SELECT model, k, start, rate, obs, cum, tob, n FROM rk) GROUP BY 1,2,3)"""


def window_forecasts(v):
    """Rates and observed events per (window, cell); windows follow each other from the first year's end to the end of the catalogue."""
    b = v.quakes.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
    first = (b["a"] - T0) // DAY + TRAIN_DAYS
    count = math.floor(((b["z"] - T0) / DAY - TEST_DAYS - first) / TEST_STEP) + 1
    return se.sliding_forecasts(v.quakes, catalogue_cells(v), first, TEST_STEP, count, TEST_DAYS, T0)


def cell_skill(rows, keys, score, hits, cells):
    """1 - 2 x area under the miss curve of cells taken in falling order of `score`; 0 where nothing happened."""
    order = W.partitionBy(*keys).orderBy(F.round(score, 12).desc(), *cells)  # cells of one window
    x = rows.withColumns({"_cum": F.sum(hits).over(order.rowsBetween(W.unboundedPreceding, 0)), "_tot": F.sum(hits).over(W.partitionBy(*keys)), "_n": F.count(lit(1)).over(W.partitionBy(*keys))})
    tot = F.greatest("_tot", lit(1))
    strip = (lit(2.0) - (c("_cum") - c(hits)) / tot - c("_cum") / tot) / 2 / c("_n")
    return x.groupBy(*keys).agg(F.when(F.max("_tot") > 0, lit(1.0) - lit(2.0) * F.sum(strip)).otherwise(0.0).alias("skill"))


def forecast_windows(v):
    """Scores of every reference model in every test window, one row each."""
    m = sk.materialized(window_forecasts(v).unpivot(["k", "start", "ci", "cj", "obs"], MODELS, "model", "rate"), "forecast-windows")
    rate = F.greatest(c("rate"), lit(1e-10))
    g = m.groupBy("model", "k", "start").agg(F.sum("rate").alias("tf"), F.sum("obs").alias("tob"), F.sum(c("obs") * F.log(rate) - rate).alias("ll"))
    return g.join(cell_skill(m, ["model", "k"], "rate", "obs", ["ci", "cj"]), ["model", "k"])


@query("G14_forecast_windows", f"WITH {_WINDOWS} SELECT model, k AS window_id, CAST(start AS BIGINT) AS start, round(tf, 6) AS total_forecast, tob AS total_observed, round(ll, 5) AS log_likelihood, 0.0 + round(skill, 4) AS skill FROM ws")
def g14(v):
    return forecast_windows(v).select("model", c("k").alias("window_id"), c("start").cast("long").alias("start"), R(c("tf")).alias("total_forecast"), c("tob").alias("total_observed"),
                                      R(c("ll"), 5).alias("log_likelihood"), R(c("skill") + lit(1e-12), 4).alias("skill"))


@query("A50_benchmark_rollup", f"WITH {_WINDOWS} SELECT model, count(*) AS windows, round(avg(ll), 5) AS mean_ll, round(stddev_samp(ll), 5) AS sd_ll, CAST(sum(tob) AS BIGINT) AS observed, round(sum(tf), 5) AS forecast, round(avg(skill), 6) AS mean_skill FROM ws GROUP BY 1")
def a50(v):
    g = forecast_windows(v)
    return g.groupBy("model").agg(F.count(lit(1)).alias("windows"), R(F.avg("ll"), 5).alias("mean_ll"), R(F.stddev_samp("ll"), 5).alias("sd_ll"), F.sum("tob").alias("observed"), R(F.sum("tf"), 5).alias("forecast"),
                                  R(F.avg("skill")).alias("mean_skill"))


@query("A33b_cell_skill", f"WITH {_WINDOWS} SELECT model, CAST(count(*) FILTER (tob > 0) AS BIGINT) AS windows, round(avg(skill) FILTER (tob > 0), 6) AS mean_skill, round(max(skill) FILTER (tob > 0), 6) AS best_skill FROM ws GROUP BY 1")
def a33b(v):
    g = forecast_windows(v)
    hit = c("tob") > 0
    return g.groupBy("model").agg(F.count_if(hit).alias("windows"), R(F.avg(F.when(hit, c("skill")))).alias("mean_skill"), R(F.max(F.when(hit, c("skill")))).alias("best_skill"))


@query("G12_spatial_smoothing", f"""WITH {_FC90}, p AS (SELECT ci, cj, 1-exp(-simple_etas) AS p FROM fc) SELECT a.ci, a.cj, round(sum(b.p*exp(-5e-1*(pow((a.ci-b.ci)*2,2)+pow((a.cj-b.cj)*2,2))/4e0))/sum(exp(-5e-1*(pow((a.ci-b.ci)*2,2)+pow((a.cj-b.cj)*2,2))/4e0)), 9) AS smoothed FROM p a JOIN p b ON abs(a.ci-b.ci)<=1 AND abs(a.cj-b.cj)<=1 GROUP BY 1,2""")
def g12(v):
    p = forecasts(v, 2000, 90).select("ci", "cj", (lit(1.0) - F.exp(-c("simple_etas"))).alias("p"))
    return smooth_cells(p, ["p"]).select("ci", "cj", R(c("p")  , 9).alias("smoothed"))


def smooth_cells(df, values, keys=(), sigma=2.0, size=2.0):
    """3 x 3 Gaussian mean over the cells that exist; every cell scatters to its neighbours, then one grouping."""
    near = jn.neighbours(df, include_self=True)
    d2 = (F.pow((c("ni") - c("ci")) * size, 2) + F.pow((c("nj") - c("cj")) * size, 2)) / lit(sigma * sigma)
    near = near.withColumn("_w", F.exp(lit(-0.5) * d2))
    g = near.groupBy(*keys, c("ni").alias("ci"), c("nj").alias("cj")).agg(*[(F.sum(c("_w") * c(x)) / F.sum("_w")).alias(x) for x in values])
    return df.select(*keys, "ci", "cj").join(g, [*keys, "ci", "cj"])


# ---- alarms ---------------------------------------------------------------------------------------------------------

def alarm_rows(v):
    x = cat(v)
    one = lambda name, cond: x.where(cond).select("ci", "cj", "step", lit(name).alias("signal"))
    return (one("rate", (c("rate_ratio_7d") >= 2) & (c("rate_7d") >= 2)).unionByName(one("foreshock", c("n_foreshock") >= 3))
            .unionByName(one("escalation", c("foreshock_mag_increase") >= 0.5)).unionByName(one("energy", c("benioff_accel") >= 3)))


_ALARM = f"""{PAST}, lt AS (SELECT ci, cj, count(*)/greatest((SELECT (max(t)-min(t))/864e2 FROM quakes), 1) AS lt FROM quakes GROUP BY 1,2),
  a AS (SELECT ci, cj, step, count(*) FILTER (age <= 604800) AS n7, max(mag) FILTER (age <= 3*86400) AS m3, max(mag) FILTER (age > 3*86400 AND age <= 6*86400) AS mp, sum(pow(10e0, 75e-2*mag+24e-1)) FILTER (age <= 30*86400) AS b30, sum(pow(10e0, 75e-2*mag+24e-1)) FILTER (age > 30*86400 AND age <= 60*86400) AS bp FROM pe GROUP BY 1,2,3),
  o AS (SELECT CAST(round_even(lat,0) AS INT) AS a, CAST(round_even(lon,0) AS INT) AS b, t FROM quakes), fs AS (SELECT s.ci, s.cj, s.step, count(*) AS nf FROM base s JOIN o ON abs(o.a - 2*s.ci) <= 1 AND abs(o.b - 2*s.cj) <= 1 AND o.t < s.step*86400 AND o.t >= (s.step-7)*86400 GROUP BY 1,2,3),
  al AS (SELECT ci, cj, step, 'rate' AS signal FROM a JOIN lt USING (ci, cj) WHERE n7 >= 2 AND n7/greatest(lt*7, 1e-1) >= 2 UNION ALL SELECT ci, cj, step, 'foreshock' FROM fs WHERE nf >= 3 UNION ALL SELECT ci, cj, step, 'escalation' FROM a WHERE coalesce(m3,0)-coalesce(mp,0) >= 5e-1 UNION ALL SELECT ci, cj, step, 'energy' FROM a WHERE coalesce(b30,0)/greatest(coalesce(bp,0),1) >= 3)"""


@query("G09_signal_alarms", f"WITH {_ALARM} SELECT signal, count(*) AS n, count(DISTINCT step) AS steps FROM al GROUP BY 1")
def g09(v):
    return alarm_rows(v).groupBy("signal").agg(F.count(lit(1)).alias("n"), F.countDistinct("step").alias("steps"))


@query("G10_alarm_fusion", f"WITH {_ALARM} SELECT ci, cj, step, count(DISTINCT signal) AS n_signals FROM al GROUP BY 1,2,3 HAVING count(DISTINCT signal) >= 2")
def g10(v):
    return alarm_rows(v).groupBy("ci", "cj", "step").agg(F.count(lit(1)).alias("n_signals")).where("n_signals >= 2")


@query("G11_physics_at_keys", f"""WITH {_ALARM}, k AS (SELECT DISTINCT ci, cj, step FROM al WHERE signal = 'rate') SELECT k.ci, k.cj, k.step, n7 AS rate_7d, round(n7/greatest(lt*7, 1e-1), 6) AS rate_ratio_7d FROM k JOIN a USING (ci, cj, step) JOIN lt USING (ci, cj)""")
def g11(v):
    x = cat(v).where((c("rate_ratio_7d") >= 2) & (c("rate_7d") >= 2))
    return x.select("ci", "cj", "step", "rate_7d", R(c("rate_ratio_7d")).alias("rate_ratio_7d"))


# ---- specialised tables ---------------------------------------------------------------------------------------------

_VEC = """e AS (SELECT vec_id, label, CAST(floor(vec_id*20/((SELECT max(vec_id) FROM embeddings)+1)) AS INT) AS bin, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos, sqrt(list_sum(list_transform(embedding, lambda q: CAST(q AS DOUBLE)*CAST(q AS DOUBLE)))) AS nrm FROM embeddings),
  wr AS (SELECT label, count(*)/(SELECT count(*) FROM embeddings) AS w FROM embeddings GROUP BY 1), bs AS (SELECT label, pos, avg(x/nrm) AS m FROM e WHERE bin < 6 GROUP BY 1,2), bc AS (SELECT pos, sum(w*m)/sum(w) AS b FROM bs JOIN wr USING (label) GROUP BY 1),
  cs AS (SELECT bin, label, pos, avg(x/nrm) AS m FROM e GROUP BY 1,2,3), cc AS (SELECT bin, pos, sum(w*m)/sum(w) AS c FROM cs JOIN wr USING (label) GROUP BY 1,2), dr AS (SELECT bin, sqrt(sum(pow(c-b,2))) AS drift FROM cc JOIN bc USING (pos) GROUP BY 1)"""


def drift_series(df, keys=(), bins=20, base_bins=6):
    """Distance of the stratum-matched mean vector of each time bin from the baseline bins.

    Vectors are summed per (bin, stratum, position) map-side; strata weights are their share of all rows.
    """
    nrm = F.sqrt(F.aggregate(F.transform("vec", lambda x: x * x), lit(0.0), lambda a, x: a + x))
    e = df.select(*keys, "bin", "stratum", nrm.alias("nrm"), F.posexplode("vec").alias("pos", "x")).withColumn("x", F.try_divide(c("x"), c("nrm")))
    part = e.groupBy(*keys, "bin", "stratum", "pos").agg(F.sum("x").alias("s"), F.count(lit(1)).alias("n"))
    w = df.groupBy(*keys, "stratum").agg(F.count(lit(1)).alias("k"))
    cen = lambda g, by: g.join(w, [*keys, "stratum"]).groupBy(*by).agg((F.sum(c("k") * c("s") / c("n")) / F.sum("k")).alias("cen"))
    base = part.where(c("bin") < base_bins).groupBy(*keys, "stratum", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    b = cen(base, [*keys, "pos"]).withColumnRenamed("cen", "b")
    m = cen(part, [*keys, "bin", "pos"]).join(b, [*keys, "pos"])
    return m.groupBy(*keys, "bin").agg(F.sqrt(F.sum(F.pow(c("cen") - c("b"), 2))).alias("drift"))


def vector_rows(v, bins=20):
    e = v.table("embeddings")
    top = e.select(F.max("vec_id")).scalar()
    return e.select("vec_id", F.floor(c("vec_id") * bins / (top + 1)).cast("int").alias("bin"), c("label").alias("stratum"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query("A57_matched_centroid", f"WITH {_VEC} SELECT bin, round(drift, 8) AS drift FROM dr")
def a57(v):
    return drift_series(vector_rows(v)).select("bin", R(c("drift"), 8).alias("drift"))


@query("A58_theil_sen", f"WITH {_VEC} SELECT 0.0 + round(quantile_cont((b.drift-a.drift)/(b.bin-a.bin), 0.5), 8) AS slope, count(*) AS n_pairs FROM dr a JOIN dr b ON b.bin > a.bin")
def a58(v):
    return rs.theil_sen(drift_series(vector_rows(v)), [], "bin", "drift").select(R(c("slope"), 8).alias("slope"), "n_pairs")


@query("G24_drift_verdict")
def g24(v):
    d = vector_rows(v)
    # shuffle null: replicate r turns the time axis by a fixed share; replicate 0 is the observed order
    reps = d.withColumn("r", F.explode(F.sequence(lit(0), lit(12)))).withColumn("bin", (F.pmod(c("bin") * F.when(c("r") == 0, 1).otherwise(c("r") * 2 + 1) + c("r") * 3 + F.pmod(c("vec_id"), F.greatest(c("r"), lit(1))) * c("r"), lit(20))).cast("int"))
    s = rs.theil_sen(drift_series(reps, ["r"]), ["r"], "bin", "drift")
    dr = drift_series(d).agg(R(F.avg(F.when(c("bin") >= 18, c("drift"))) / F.avg(F.when(c("bin") < 18, c("drift"))), 8).alias("final_ratio"))
    g = s.agg(R(F.max(F.when(c("r") == 0, c("slope"))), 8).alias("slope"), R(F.percentile(F.when(c("r") > 0, c("slope")), lit(0.95)), 8).alias("null_p95"))
    return g.select("slope", "null_p95", (c("slope") > c("null_p95")).cast("int").alias("exceeds_null"), dr.scalar().alias("final_ratio"))


_PIX = "px AS (SELECT l_orderkey AS r, l_linenumber AS cc, (l_partkey*13 % 100)/1e2 AS pre, ((l_suppkey*7 + l_linenumber*13) % 100)/1e2 AS co, l_tax > 0 AS land FROM lineitem)"


def pixels(v):
    return v.table("lineitem").select(c("l_orderkey").alias("r"), c("l_linenumber").alias("cc"), ((c("l_partkey") * 13 % 100) / lit(100.0)).alias("pre"), ((c("l_suppkey") * 7 + c("l_linenumber") * 13) % 100 / lit(100.0)).alias("co"), (c("l_tax") > 0).alias("land"))


@query("A60_coherence_change", f"""WITH {_PIX}, d AS (SELECT pre-co AS d FROM px WHERE land AND pre > 0 AND co > 0 AND pre >= 3e-1) SELECT count(*) AS n_base, round(quantile_cont(d, 0.5), 6) + 0.0 AS p50, round(quantile_cont(d, 0.9), 6) + 0.0 AS p90, round(quantile_cont(d, 0.99), 6) + 0.0 AS p99, count(*) FILTER (d > 205e-3) AS n_gt_02, count(*) FILTER (d > 405e-3) AS n_gt_04 FROM d""")
def a60(v):
    d = pixels(v).where(c("land") & (c("pre") > 0) & (c("co") > 0) & (c("pre") >= 0.3)).select((c("pre") - c("co")).alias("d"))
    q = od.exact_quantiles(d, [], "d", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    n = d.agg(F.count_if(c("d") > 0.205).alias("n2"), F.count_if(c("d") > 0.405).alias("n4")).select(F.struct("n2", "n4")).scalar()
    return q.withColumn("x", n).select(c("n").alias("n_base"), *[R(c(x)).alias(x) for x in ("p50", "p90", "p99")], c("x.n2").alias("n_gt_02"), c("x.n4").alias("n_gt_04"))


@query("A60b_top_change_centroid", f"""WITH {_PIX}, d AS (SELECT r, cc, round(pre-co, 6) AS d FROM px WHERE land AND pre > 0 AND co > 0 AND pre >= 3e-1), t AS (SELECT * FROM d ORDER BY d DESC, r, cc LIMIT 500) SELECT round(avg(r), 4) AS row_mean, round(avg(cc), 4) AS col_mean, min(r) AS row_min, max(r) AS row_max FROM t""")
def a60b(v):
    d = pixels(v).where(c("land") & (c("pre") > 0) & (c("co") > 0) & (c("pre") >= 0.3)).select("r", "cc", F.round(c("pre") - c("co"), 6).alias("d"))
    return d.orderBy(F.desc("d"), "r", "cc").limit(500).agg(R(F.avg("r"), 4).alias("row_mean"), R(F.avg("cc"), 4).alias("col_mean"), F.min("r").alias("row_min"), F.max("r").alias("row_max"))


_BAND = "CASE WHEN km < 200 THEN '000-200' WHEN km < 400 THEN '200-400' WHEN km < 800 THEN '400-800' ELSE '800+' END"


@query("A59_distance_bands", f"""WITH d AS (SELECT mag, sqrt(pow((lat-36)*11132e-2,2)+pow((lon-140)*11132e-2*cos(radians(lat)),2)) AS km FROM quakes) SELECT {_BAND} AS band, count(*) AS n, round(avg(mag), 8) AS mean, round(quantile_cont(mag, 0.5), 6) AS median, round(quantile_cont(mag, 0.95), 6) AS p95, round(avg(CAST(mag > 4 AS INT)), 8) AS share FROM d GROUP BY 1""")
def a59(v):
    from ..operators.aggregates import summary
    km = sp.flat_km(c("lat"), c("lon"), lit(36.0), lit(140.0))
    band = F.when(km < 200, "000-200").when(km < 400, "200-400").when(km < 800, "400-800").otherwise("800+")
    s = summary(v.quakes.select(band.alias("band"), "mag"), ["band"], "mag", {"median": 0.5, "p95": 0.95}, {"share": c("mag") > 4})
    return s.select("band", "n", R(c("mean"), 8).alias("mean"), R(c("median")).alias("median"), R(c("p95")).alias("p95"), R(c("share"), 8).alias("share"))


def plane_strain(df, keys, x, y, u, w, min_n=3):
    """Second invariant (nanostrain) of the least-squares displacement gradient per key, from sums that merge map-side."""
    s = lambda e: F.sum(e)
    g = df.groupBy(*keys).agg(F.count(lit(1)).alias("n"), s(c(x)).alias("sx"), s(c(y)).alias("sy"), s(c(x) * c(x)).alias("xx"), s(c(y) * c(y)).alias("yy"), s(c(x) * c(y)).alias("xy"),
                              *[z for t, col in (("u", u), ("w", w)) for z in (s(c(col)).alias(f"s{t}"), s(c(col) * c(x)).alias(f"{t}x"), s(c(col) * c(y)).alias(f"{t}y"))]).where(c("n") >= min_n)
    # centred sums reduce the 3 x 3 normal equations to 2 x 2
    cxx, cyy, cxy = c("xx") - c("sx") * c("sx") / c("n"), c("yy") - c("sy") * c("sy") / c("n"), c("xy") - c("sx") * c("sy") / c("n")
    det = cxx * cyy - cxy * cxy
    def grad(t):
        cx, cy = c(f"{t}x") - c(f"s{t}") * c("sx") / c("n"), c(f"{t}y") - c(f"s{t}") * c("sy") / c("n")
        return F.try_divide(cx * cyy - cy * cxy, det), F.try_divide(cy * cxx - cx * cxy, det)
    (ux, uy), (wx, wy) = grad("u"), grad("w")
    shear = (uy + wx) / 2
    return g.select(*keys, "n", F.when(F.coalesce(F.try_divide(det, cxx * cyy), lit(0.0)) < 1e-9, 0.0).otherwise(F.sqrt(ux * ux + wy * wy + lit(2.0) * shear * shear) * 1000).alias("strain"))


_GN = """gn AS (SELECT CAST(round_even((26+((user_id*379)%2001)/1e2)/1e1,0) AS INT) AS gi, CAST(round_even((128+((user_id*757)%2001)/1e2)/1e1,0) AS INT) AS gj, epoch_us(ts)//86400000000 AS dn, user_id, 26+((user_id*379)%2001)/1e2 AS la, 128+((user_id*757)%2001)/1e2 AS lo, avg(value) AS dx, avg(CAST(json_extract(props,'$.k') AS INT)) AS dy, avg(value*value)/1e3 AS dz FROM events GROUP BY 1,2,3,4,5,6)"""


def gnss_days(v, size=10.0):
    """Station-day displacements with their cell."""
    o = v.station_obs.groupBy("station", "dn").agg(F.avg("value").alias("dx"), F.avg("flag").alias("dy"), (F.avg(c("value") * c("value")) / lit(1000.0)).alias("dz"))
    o = o.withColumns({"la": lit(26) + ((c("station") * 379) % 2001) / lit(100.0), "lo": lit(128) + ((c("station") * 757) % 2001) / lit(100.0)})
    return o.withColumns({"gi": sp.cell_index(c("la"), size), "gj": sp.cell_index(c("lo"), size)})


@query("A63_gnss_strain", f"""WITH {_GN}, x AS (SELECT *, (lo-gj*10)*11132e-2*cos(radians(gi*10)) AS xk, (la-gi*10)*11132e-2 AS yk FROM gn), m AS (SELECT gi, gj, dn, count(*) AS n, covar_pop(dx,xk) AS ux, covar_pop(dx,yk) AS uy, covar_pop(dy,xk) AS wx, covar_pop(dy,yk) AS wy, var_pop(xk) AS cx, var_pop(yk) AS cy, covar_pop(xk,yk) AS cxy FROM x GROUP BY 1,2,3 HAVING count(*) >= 3),
  s AS (SELECT *, cx*cy-cxy*cxy AS det FROM m), z AS (SELECT gi, gj, dn, n, (ux*cy-uy*cxy)/det AS a, (uy*cx-ux*cxy)/det AS b, (wx*cy-wy*cxy)/det AS c, (wy*cx-wx*cxy)/det AS d, coalesce(det/nullif(cx*cy,0), 0) >= 1e-9 AS ok FROM s)
  SELECT gi, gj, dn, n, CASE WHEN ok THEN round(sqrt(a*a+d*d+2*pow((b+c)/2,2))*1000, 2) ELSE 0 END AS strain FROM z""")
def a63(v):
    g = gnss_days(v)
    g = g.withColumns({"xk": (c("lo") - c("gj") * 10) * lit(sp.DEG_KM) * F.cos(F.radians(c("gi") * 10)), "yk": (c("la") - c("gi") * 10) * lit(sp.DEG_KM)})
    return plane_strain(g, ["gi", "gj", "dn"], "xk", "yk", "dx", "dy").select("gi", "gj", "dn", "n", R(c("strain"), 2).alias("strain"))


@query("A64_station_selection", """WITH d AS (SELECT event_id, sid, 2*6371e0*asin(sqrt(pow(sin(radians(slat-lat)/2),2)+cos(radians(lat))*cos(radians(slat))*pow(sin(radians(slon-lon)/2),2))) AS km FROM quakes JOIN stations ON abs(lat-slat) <= 3 AND abs(lon-slon) <= 4 WHERE mag >= 4), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, sid) AS rk, count(*) OVER (PARTITION BY event_id) AS n FROM d WHERE km <= 300)
  SELECT event_id, sid, CAST(rk AS INT) AS rk, round(km, 4) AS km FROM r WHERE rk <= 5 AND n >= 2""")
def a64(v):
    q = v.quakes.where("mag >= 4").select("event_id", "lat", "lon")
    near = jn.nearest_k(q, v.stations.select("sid", "slat", "slon"), ["event_id"], 5, 300.0, (3.0, 4.0), ("lat", "lon", "slat", "slon"), "sid")
    # two stations in reach are two among the nearest five
    r = near.withColumn("n", F.count(lit(1)).over(W.partitionBy("event_id")))
    return r.where("n >= 2").select("event_id", "sid", "rk", R(c("km"), 4).alias("km"))


@query("A68_isolated_day_night", f"""WITH a AS ({_PREZ.format(g=_gsql('2e0'), s='2e0')}), z AS (SELECT event_id, (obs-m)/s AS z FROM a WHERE n >= 5 AND s >= 1e-2 AND obs IS NOT NULL), iso AS (SELECT a.event_id FROM quakes a WHERE NOT EXISTS (SELECT 1 FROM quakes b WHERE b.t >= a.t-259200 AND b.t < a.t AND abs(a.lat-b.lat) <= 15e-1 AND abs(a.lon-b.lon) <= 15e-1 AND b.mag >= a.mag-5e-1))
  SELECT CAST(iso.event_id IS NOT NULL AS INT) AS isolated, CASE WHEN (t % 86400)//3600 >= 10 AND (t % 86400)//3600 < 20 THEN 'night' ELSE 'day' END AS part, count(*) AS n, 0.0 + round(avg(z), 6) AS mean_z, round(avg(CAST(abs(z) > 2 AS INT)), 6) AS share_2sigma FROM z JOIN quakes USING (event_id) LEFT JOIN iso USING (event_id) GROUP BY 1,2""")
def a68(v):
    q = v.quakes
    z = pre_event_z(q, grid_points(v.grid_obs), 2.0).select("event_id", "z")
    h = F.floor(F.pmod(c("t"), lit(DAY)) / 3600)
    e = q.select("event_id", F.when((h >= 10) & (h < 20), "night").otherwise("day").alias("part"))
    j = z.join(e, "event_id").join(isolated(q, q).select("event_id", lit(1).alias("iso")), "event_id", "left")
    return j.groupBy(F.coalesce("iso", lit(0)).alias("isolated"), "part").agg(F.count(lit(1)).alias("n"), R(F.avg("z")).alias("mean_z"), R(F.avg((F.abs("z") > 2).cast("double"))).alias("share_2sigma"))


@query("A70_b_and_pearson", """SELECT ci, count(*) AS n, round(CASE WHEN count(*) >= 20 AND avg(mag)-min(mag) > 1e-2 THEN log10(exp(1))/(avg(mag)-min(mag)) END, 6) AS b_value, 0.0 + round(CASE WHEN count(*) >= 10 THEN corr(mag, depth_km) END, 6) AS r FROM quakes GROUP BY 1""")
def a70(v):
    g = v.quakes.groupBy("ci").agg(F.count(lit(1)).alias("n"), F.avg("mag").alias("m"), F.min("mag").alias("lo"), F.corr("mag", "depth_km").alias("cr"))
    return g.select("ci", "n", R(ph.b_min(c("n"), c("m"), c("lo"), 20)).alias("b_value"), R(F.when(c("n") >= 10, c("cr"))).alias("r"))
