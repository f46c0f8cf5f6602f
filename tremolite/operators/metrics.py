"""Forecast and classifier scores as aggregations; scores are collapsed to distinct values before anything is ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as sc
from .expand import with_values
from .ordered import running

# Default alarm thresholds.
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80]


def threshold_skill(df: DataFrame, y: str, p: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Confusion counts and skill per threshold.

    Rows collapse to the number of thresholds they reach before any shuffle; the table that is repeated per threshold
    has one row per reached level.
    """
    level = sum(((F.col(p) >= F.lit(t)).cast("int") for t in thresholds[1:]), (F.col(p) >= F.lit(thresholds[0])).cast("int"))
    g = df.groupBy(level.alias("lv")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    g = with_values(g, list(range(1, len(thresholds) + 1)), "k")
    hit = F.col("lv") >= F.col("k")
    a = g.groupBy("k").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
                           F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
                           F.sum("pos").alias("n_pos"), F.sum("n").alias("n_all"))
    th = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("k"))
    tp, fp, n_pos, n_all = (F.col(c) for c in ("tp", "fp", "n_pos", "n_all"))
    one = F.lit(1)
    precision = tp / F.greatest(tp + fp, one)
    recall = tp / F.greatest(n_pos, one)
    frac = (tp + fp) / F.greatest(n_all, one)
    g1 = sc.gain(precision, n_pos / n_all, 1e-6)
    return a.select(th.alias("threshold"), (tp + fp).alias("n_alarms"), "tp", "fp", (n_pos - tp).alias("fn"),
                    precision.alias("precision"), recall.alias("recall"),
                    (fp / F.greatest(n_all - n_pos, one)).alias("false_alarm_rate"), g1.alias("probability_gain"),
                    sc.bits(g1, 1e-6).alias("igpe_bits"), (F.lit(1.0) - recall).alias("miss_rate"),
                    frac.alias("alarm_fraction"), (recall - frac).alias("molchan_score"))


def score_curve(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from high to low: positives and negatives at this score and above."""
    g = df.groupBy(*keys, F.col(p).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("_p"),
                                                      F.sum((F.lit(1) - F.col(y)).cast("long")).alias("_m"))
    g = g.withColumn("_desc", -F.col("score"))
    return running(g, keys, "_desc", {"tp": F.col("_p"), "fp": F.col("_m")}, totals=True).drop("_desc")


def rank_shares(df: DataFrame, columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """`df` with, per entry new -> column, the rank of the column among the rows of the key, divided by their number.

    Equal values share their mean rank; the largest of n different values has share 1. Nulls and NaN have no rank: their share is
    null and they don't count. `df` is read once per column and once more: write it first where it is costly.
    """
    # one text per key, so that rows of a null key are a group like any other
    out = df = df.withColumn("_key", F.to_json(F.struct(F.lit(1).alias("_"), *keys)))
    for new, name in columns.items():
        known = df.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
        counts = known.groupBy("_key", F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_k"))
        r = running(counts, ["_key"], "_value", {"_upto": F.col("_k")}, totals=True)
        share = (F.col("_upto") - (F.col("_k") - 1) / F.lit(2.0)) / F.col("_upto_total")
        out = out.withColumn("_value", F.col(name)).join(r.select("_key", "_value", share.alias(new)), ["_key", "_value"], "left").drop("_value")
    return out.drop("_key")


def roc_auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact trapezoid AUC per key; 0.5 when a class is missing."""
    c = score_curve(df, y, p, keys)
    area = F.sum(F.col("_m") * (F.col("tp") + F.col("tp") - F.col("_p"))) / F.lit(2.0)
    n_pos, n_neg = F.max("tp_total"), F.max("fp_total")
    return c.groupBy(*keys).agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"), area.alias("_a")).select(
        *keys, "n_pos", "n_neg",
        F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(0.5))
        .otherwise(F.try_divide(F.col("_a"), F.col("n_pos") * F.col("n_neg").cast("double"))).alias("auc"))


def molchan_skill(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """1 - 2 * area under miss rate over alarm fraction."""
    c = score_curve(df, y, p, keys)
    n = F.col("tp_total") + F.col("fp_total")
    df_ = (F.col("_p") + F.col("_m")) / n
    miss = F.lit(1.0) - F.col("tp") / F.col("tp_total")
    before = F.lit(1.0) - (F.col("tp") - F.col("_p")) / F.col("tp_total")
    return c.where(F.col("tp_total") > 0).groupBy(*keys).agg(
        (F.lit(1.0) - F.lit(2.0) * F.sum(df_ * (miss + before) / 2)).alias("molchan_skill"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("mean_observed"),
                                          F.count(F.lit(1)).alias("n")).withColumn(
        "bin_center", (F.col("bin") + F.lit(0.5)) / F.lit(float(bins)))


def feature_auc(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """AUC of each single feature, better direction reported."""
    long = df.select(y, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([y], list(features), "feature", "v")
    a = roc_auc(long, y, "v", ["feature"])
    return a.select("feature", F.greatest("auc", F.lit(1.0) - F.col("auc")).alias("auc"),
                    F.when(F.col("auc") >= 0.5, "higher_risk").otherwise("lower_risk").alias("direction"))


def mutual_information(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mutual information in bits of two discrete columns, from the joint counts only."""
    from pyspark.sql import Window as W
    joint = df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c").over(W.partitionBy(*keys)) if keys else joint.select(F.sum("_c")).scalar()  # without keys no window over everything
    nx = F.sum("_c").over(W.partitionBy(*list(keys), x))
    ny = F.sum("_c").over(W.partitionBy(*list(keys), y))
    j = joint.select(*keys, "_c", n.alias("_n"), nx.alias("_nx"), ny.alias("_ny"))
    term = F.col("_c") / F.col("_n") * F.log2(F.col("_c") * F.col("_n") / (F.col("_nx") * F.col("_ny").cast("double")))
    return j.groupBy(*keys).agg(F.sum(term).alias("mi_bits"), F.max("_n").alias("n"))
