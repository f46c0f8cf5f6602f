"""Training, calibration, stacking and walk-forward scoring on MLlib and column math."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import metrics as mt, ordered as od, sinks as sk

c, lit = F.col, F.lit
YEAR = 365.25


def walk_forward_splits(start: float, end: float, initial_years=5, step_years=1, test_years=1) -> list[tuple]:
    """(fold, train_start, train_end, test_start, test_end) of an expanding window."""
    first, step, test = start + initial_years * YEAR, step_years * YEAR, test_years * YEAR
    folds = max(0, int((end - first - test) // step) + 1)
    return [(k, start, first + k * step, first + k * step, first + k * step + test) for k in range(folds)]


def assign_folds(df: DataFrame, day: str, splits: list[tuple], embargo: float = 0.0) -> DataFrame:
    """Rows repeated per fold they take part in, with their part; the fold list is a literal, not a join."""
    def part(a, b, s, e):
        return F.when((c(day) >= lit(float(a))) & (c(day) < lit(float(b)) - embargo), "train").when((c(day) >= lit(float(s))) & (c(day) < lit(float(e))), "test")
    one = lambda f, *edges: F.struct(lit(f).alias("fold"), part(*edges).alias("part"))
    return df.select(*df.columns, F.inline(F.array(*[one(*x) for x in splits]))).where("part IS NOT NULL")


def _assembled(features: Sequence[str], model, scale: bool = False) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True))
    else:
        model = model.setFeaturesCol("_raw")
    return Pipeline(stages=[*stages, model])


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Positive rows weighted by the class ratio, a number by now: a scalar subquery would read the rows again in every pass of a fit."""
    return _weighted(df, label, df.select(F.sum(1 - c(label)) / F.greatest(F.sum(label), lit(1))).first()[0])


def _weighted(df: DataFrame, label: str, ratio: float | None) -> DataFrame:
    return df.withColumn("_w", F.when(c(label) == 1, lit(ratio).cast("double")).otherwise(1.0))


def boosted(features, label="label", rounds=20, depth=4, seed=7) -> Pipeline:
    return _assembled(features, GBTClassifier(labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed))


def forest(features, label="label", trees=20, depth=8, seed=7) -> Pipeline:
    return _assembled(features, RandomForestClassifier(labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed))


def logistic(features, label="label", l2=0.1, l1_ratio=0.0, rounds=50) -> Pipeline:
    return _assembled(features, LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=l2, elasticNetParam=l1_ratio, maxIter=rounds), scale=True)


def _logistic_column(assembler: VectorAssembler, scaler: StandardScalerModel, model: LogisticRegressionModel) -> Column:
    """The fitted probability of label 1 as column arithmetic; as in the assembler, a null is NaN."""
    margin = lit(0.0)
    for f, mean, std, weight in zip(assembler.getInputCols(), scaler.mean, scaler.std, model.coefficients):
        x = F.coalesce(c(f).cast("double"), lit(float("nan"))) - lit(float(mean))
        margin = margin + x * lit(1 / float(std) if std else 0.0) * lit(float(weight))
    return lit(1.0) - lit(1.0) / (lit(1.0) + F.exp(margin + lit(float(model.intercept))))


def probability(model, df: DataFrame, name: str = "prob") -> DataFrame:
    """`df` with the fitted probability of label 1. Scaled two-class logistic models score as columns: no vector is built per row."""
    kinds = [type(s) for s in model.stages]
    if kinds == [VectorAssembler, StandardScalerModel, LogisticRegressionModel] and model.stages[2].numClasses == 2:
        return df.select(*df.columns, _logistic_column(*model.stages).alias(name))
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def walk_forward(df: DataFrame, make, day: str, splits, label="label", min_pos=5, embargo=0.0) -> DataFrame:
    """Out-of-fold predictions of every usable fold; folds run one after the other, each as distributed training."""
    out = None
    for split in splits:
        parts = assign_folds(df, day, [split], embargo)
        train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
        ratio = F.sum(1 - c(label)) / F.greatest(F.sum(label), lit(1))
        n = parts.groupBy("part").agg(F.sum(label).alias("pos"), ratio.alias("ratio")).collect()  # two rows
        if any(r["pos"] < min_pos for r in n) or len(n) < 2:
            continue
        train = _weighted(train, label, next(r["ratio"] for r in n if r["part"] == "train"))
        pred = probability(make().fit(train), test)
        out = pred if out is None else out.unionByName(pred)
    if out is None:
        raise ValueError("no fold has enough positives")
    return out


def fold_metrics(pred: DataFrame, label="label", prob="prob") -> DataFrame:
    """AUC and Molchan skill per fold plus the pooled row (fold -1)."""
    # written once: a score may be a model's, and both curves read it twice for each of its two copies
    pred = sk.materialized(pred.select("fold", label, prob), "predictions")
    both = pred.unionByName(pred.select(lit(-1).alias("fold"), label, prob))
    return mt.roc_auc(both, label, prob, ["fold"]).join(mt.molchan_skill(both, label, prob, ["fold"]), "fold", "left")


def binned_calibration(df: DataFrame, y: str, p: str, bins: int = 50) -> list[tuple[float, float]]:
    """Equal-count bins with pooled adjacent violators: at most `bins` (mean score, calibrated rate) points.

    Only the bin means reach the driver; rows with equal scores share a bin edge decided on their collapsed counts.
    """
    g = df.groupBy(c(p).alias("s")).agg(F.count(lit(1)).alias("n"), F.sum(y).alias("k"))
    r = od.running(g, [], "s", {"cum": c("n")}, totals=True)
    b = F.least(F.floor((c("cum") - c("n")) * bins / c("cum_total")), lit(bins - 1))
    rows = r.groupBy(b.alias("b")).agg((F.sum(c("s") * c("n")) / F.sum("n")).alias("x"), (F.sum("k") / F.sum("n")).alias("v")).orderBy("b").collect()
    xs, blocks = [r["x"] for r in rows], []
    for r in rows:
        blocks.append([float(r["v"]), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * k) / (blocks[-1][1] + k), blocks[-1][1] + k]
    levels = [v for v, k in blocks for _ in range(k)]
    return list(zip(xs, levels))


def interpolate(p: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup over a short literal list, flat outside."""
    expr = F.when(p <= points[0][0], lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        expr = expr.when(p < x1, lit(y0) + (p - x0) / lit(max(x1 - x0, 1e-10)) * lit(y1 - y0))
    return expr.otherwise(lit(points[-1][1]))


def isotonic(df: DataFrame, y: str, p: str):
    """MLlib isotonic map fitted on distinct scores with their counts as weights."""
    g = df.groupBy(c(p).cast("double").alias("s")).agg(F.avg(c(y).cast("double")).alias("v"), F.count(lit(1)).cast("double").alias("w"))
    return IsotonicRegression(featuresCol="s", labelCol="v", weightCol="w").fit(g)


def sequence_samples(df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], length: int = 30) -> DataFrame:
    """Last `length` feature vectors per (cell, step); shorter histories are left out."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(step).rowsBetween(-(length - 1), 0)  # steps of one cell
    out = df.select(*keys, step, F.collect_list(F.array(*[c(x).cast("double") for x in values])).over(w).alias("sequence"))
    return out.where(F.size("sequence") == length)
