"""A second level over given scores: weights on the simplex, an isotonic map, or a logistic model, scored walk-forward."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import sinks as sk
from . import models as md

c, lit = F.col, F.lit


def moments(df: DataFrame, scores: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: row count, Gram matrix of the scores (rows of the upper half), their products with the label and its square."""
    x = [c(s).cast("double") for s in scores]
    y = c(label).cast("double")
    gram = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return df.groupBy(*keys).agg(F.count(lit(1)).alias("n"), F.sum(c(label).cast("long")).alias("n_pos"), F.array(*gram).alias("gram"),
                                 F.array(*[F.sum(v * y) for v in x]).alias("cross"), F.sum(y * y).alias("square"))


def on_simplex(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The weights w >= 0 with sum 1 that minimise w'aw / 2 - b'w: an active set walk from the best single score."""
    k = len(b)
    w = np.zeros(k)
    w[np.argmin(np.diag(a) / 2 - b)] = 1.0
    held = list(np.flatnonzero(w))
    tiny = 1e-10 * max(1.0, np.abs(a).max())
    for _ in range(20 * k + 20):
        m = np.ones((len(held) + 1, len(held) + 1))
        m[:-1, :-1], m[-1, -1] = a[np.ix_(held, held)], 0.0
        aim = np.zeros(k)
        aim[held] = np.linalg.lstsq(m, np.append(b[held], 1.0), rcond=None)[0][:-1]
        below = [j for j in held if aim[j] < 0]
        if below:
            # walk towards the aim until the first weight is used up
            step = {j: w[j] / (w[j] - aim[j]) if w[j] > aim[j] else 0.0 for j in below}
            out = min(step, key=step.get)
            w = w + step[out] * (aim - w)
            w[out] = 0.0
            held.remove(out)
            continue
        w, slope = aim, a @ aim - b
        level = float(np.mean(slope[held]))
        rest = [j for j in range(k) if j not in held and slope[j] < level - tiny]
        if not rest:
            break
        held.append(min(rest, key=lambda j: slope[j]))
    w = np.maximum(w, 0.0)
    return w / w.sum()


def _solved(row, k: int) -> tuple[np.ndarray, float, float]:
    """(weights, mean squared error of the blend, of the best single score) from one row of `moments`."""
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = row["gram"]
    a = (a + np.triu(a, 1).T) / row["n"]
    b, square = np.array(row["cross"]) / row["n"], row["square"] / row["n"]
    w = on_simplex(a, b)
    return w, float(w @ a @ w - 2 * b @ w + square), float((np.diag(a) - 2 * b + square).min())


def fold_weights(df: DataFrame, scores: Sequence[str], label: str, day: str, splits: list[tuple], embargo: float = 0.0) -> list[dict]:
    """Weights per fold from its training rows: one aggregation for all folds, a row of a few sums per fold reaches the driver."""
    train = md.assign_folds(df, day, splits, embargo).where("part = 'train'")
    out = []
    for r in sorted(moments(train, scores, label, ["fold"]).collect(), key=lambda r: r["fold"]):
        w, blend, single = _solved(r, len(scores))
        out.append({"fold": r["fold"], "n_train": r["n"], "n_pos": r["n_pos"], "weights": w.tolist(), "blend": blend, "single": single})
    return out


def _weighted_sum(scores: Sequence[str], w: Sequence[float]) -> Column:
    first, *rest = [c(s).cast("double") * lit(float(x)) for s, x in zip(scores, w)]
    return sum(rest, first)


def walk_forward(df: DataFrame, scores: Sequence[str], label: str, day: str, splits: list[tuple], meta: str = "weights", bins: int = 30,
                 min_pos: int = 5, embargo: float = 0.0) -> DataFrame:
    """Out-of-fold `prob` of the second level for every fold with `min_pos` positives on both sides.

    `logistic`: standardised ridge model; `isotonic`: the mean score through pooled equal-count bins; `weights`: the
    blend on the simplex through the same isotonic map. Fits see the training rows of their fold only.
    """
    if meta not in ("logistic", "isotonic", "weights"):
        raise ValueError(f"unknown second level: {meta}")
    if meta == "logistic":
        return md.walk_forward(df, lambda: md.logistic(list(scores), label=label, l2=0.01, rounds=20), day, splits, label, min_pos, embargo)
    weights = {r["fold"]: r["weights"] for r in fold_weights(df, scores, label, day, splits, embargo)}
    out = None
    for split in splits:
        parts = md.assign_folds(df, day, [split], embargo)
        n = {r["part"]: r["pos"] for r in parts.groupBy("part").agg(F.sum(label).alias("pos")).collect()}  # two rows
        if min(n.get("train") or 0, n.get("test") or 0) < min_pos:
            continue
        w = weights[split[0]] if meta == "weights" else [1.0 / len(scores)] * len(scores)
        # written once: read by the bins, and by every branch of the interpolation
        parts = sk.materialized(parts.withColumn("_blend", _weighted_sum(scores, w)), "blend")
        points = md.binned_calibration(parts.where("part = 'train'"), label, "_blend", bins)
        pred = parts.where("part = 'test'").withColumn("prob", md.interpolate(c("_blend"), points)).drop("_blend")
        out = pred if out is None else out.unionByName(pred)
    if out is None:
        raise ValueError("no fold has enough positives")
    return out
