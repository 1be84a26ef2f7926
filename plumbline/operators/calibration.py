"""Calibration of confidences: ECE, proper scores, risk curves, thresholds, conformal sets, logistic fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from . import ordered


def running(rows: DataFrame, value: str, sums: Sequence[str], falling: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``to_<c>``, the running sum of each column in the order of ``value``, then of ``ties``; of values in any range, and nulls last."""
    order = F.col(value).desc_nulls_last() if falling else F.col(value).asc_nulls_last()
    return ordered.running(rows, [], [order, *(F.col(c) for c in ties)], {f"to_{c}": F.col(c) for c in sums})


def ece(rows: DataFrame, confidence: str, target: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed; two aggregations, the second over ``bins`` rows."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    b = rows.groupBy(at.alias("_b")).agg(F.count("*").alias("_n"), F.avg(confidence).alias("_c"), F.avg(F.col(target).cast("double")).alias("_a"))
    return b.agg((F.sum(F.col("_n") * F.abs(F.col("_c") - F.col("_a"))) / F.sum("_n")).alias("ece"))


def proper_scores(rows: DataFrame, confidence: str, target: str) -> DataFrame:
    c, t = F.col(confidence), F.col(target).cast("double")
    return rows.agg(F.avg(scores.brier(c, t)).alias("brier"), F.avg(scores.log_loss(c, t)).alias("nll"))


def ranked_risk(rows: DataFrame, confidence: str, target: str, order: str) -> DataFrame:
    """Rows with their place by falling confidence and the errors so far."""
    d = rows.select(F.col(confidence).alias("_c"), F.col(order).alias("_o"), (1 - F.col(target).cast("long")).alias("e"), F.lit(1).alias("n"))
    return running(d, "_c", ["n", "e"], True, ["_o"]).select("_c", "_o", F.col("to_n").alias("place"), F.col("to_e").alias("errors"))


def aurc(rows: DataFrame, confidence: str, target: str, order: str) -> DataFrame:
    """Mean over all coverages of the error rate among the most confident rows."""
    return ranked_risk(rows, confidence, target, order).agg(F.avg(F.col("errors") / F.col("place")).alias("aurc"))


def auroc(rows: DataFrame, score: str, target: str) -> DataFrame:
    """Area under the ROC curve with mid-ranks for ties; null with one class only.

    Computed from counts by distinct score, so ties never make a large group.
    """
    d = rows.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(target).cast("long")).alias("_p"), F.count("*").alias("_n"))
    r = running(d, "_s", ["_n"]).withColumn("_r", F.col("to__n") - (F.col("_n") - 1) / 2)
    s = r.agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"), F.sum(F.col("_p") * F.col("_r")).alias("r"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return s.select(F.when((p > 0) & (n > 0), (F.col("r") - p * (p + 1) / 2) / (p * n)).alias("auroc"))


def selective(rows: DataFrame, confidence: str, target: str, threshold: float) -> DataFrame:
    """Share of rows accepted at a threshold and their error rate; confidences are clamped first."""
    ok = scores.probability(F.col(confidence)) >= threshold
    return rows.agg(F.avg(ok.cast("double")).alias("coverage"), F.try_divide(F.sum(F.when(ok, 1 - F.col(target).cast("double"))), F.count_if(ok)).alias("risk"))


def by_threshold(rows: DataFrame, confidence: str, target: str) -> DataFrame:
    """For each distinct confidence: rows at or above it, and the errors among them."""
    d = rows.groupBy(F.col(confidence).alias("threshold")).agg(F.count("*").alias("n"), F.sum(1 - F.col(target).cast("long")).alias("e"))
    return running(d, "threshold", ["n", "e"], True).select("threshold", F.col("to_n").alias("n"), F.col("to_e").alias("errors"))


def risk_threshold(rows: DataFrame, confidence: str, target: str, max_risk: float = 0.05, min_coverage: float = 0.1) -> DataFrame:
    """The threshold of most coverage within the risk; 1.0 with nothing accepted if there is none."""
    total = rows.agg(F.count("*").alias("total"))
    t = by_threshold(rows, confidence, target).crossJoin(F.broadcast(total))
    good = t.where((F.col("errors") / F.col("n") <= max_risk) & (F.col("n") / F.col("total") >= min_coverage))
    best = good.agg(F.max_by(F.struct("threshold", "n", "errors", "total"), F.struct("n", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(
        F.coalesce("b.threshold", F.lit(1.0)).alias("threshold"),
        F.coalesce(F.col("b.n") / F.col("b.total"), F.lit(0.0)).alias("coverage"),
        (F.col("b.errors") / F.col("b.n")).alias("risk"),
    )


def percentiles(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row: total and q<percent> for each share, between neighbouring values by a line; from running counts, so no task holds all values."""
    d = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("k"))
    total = d.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"))
    d = running(d, "_v", ["k"]).crossJoin(F.broadcast(total))
    at = lambda place: F.min(F.when(F.col("to_k") > place, F.col("_v")))
    ends = [f(F.lit(p) * (F.col("total") - 1)) for p in shares for f in (F.floor, F.ceil)]
    r = d.agg(F.max("total").alias("total"), *(at(e).alias(f"_{k}") for k, e in enumerate(ends)))
    part = lambda k, p: F.col(f"_{2 * k}") + (F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1))) * (F.col(f"_{2 * k + 1}") - F.col(f"_{2 * k}"))
    return r.select(F.coalesce("total", F.lit(0)).alias("total"), *(part(k, p).alias(f"q{round(p * 100)}") for k, p in enumerate(shares)))


def route_thresholds(rows: DataFrame, confidence: str, target: str, precision: float = 0.9) -> DataFrame:
    """High: the least threshold that keeps the precision over max(5, 10 %) rows, else the 75 % quantile.  Low: the 30 % quantile; 20 and 80 % where the two would cross."""
    q = percentiles(rows, confidence, (0.2, 0.3, 0.75, 0.8))
    t = by_threshold(rows, confidence, target).crossJoin(F.broadcast(q))
    enough = F.col("n") >= F.greatest(F.lit(5), F.ceil(F.col("total") * 0.1))
    good = t.where(enough & (1 - F.col("errors") / F.col("n") >= precision)).agg(F.min("threshold").alias("found"))
    d = q.crossJoin(F.broadcast(good)).select("*", F.coalesce("found", "q75").alias("high"), F.col("q30").alias("low"))
    crossed = F.col("low") >= F.col("high")
    return d.select(F.when(crossed, F.col("q80")).otherwise(F.col("high")).alias("high"), F.when(crossed, F.col("q20")).otherwise(F.col("low")).alias("low"))


def balanced_threshold(rows: DataFrame, score: str, target: str) -> DataFrame:
    """The score at which accepting scores at or above it has the best balanced accuracy; 0 accepts nothing, and the least of equals wins."""
    d = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(target).cast("long")).alias("p"), F.count("*").alias("n"))
    total = d.agg(F.sum("p").alias("p"), (F.sum("n") - F.sum("p")).alias("q"))
    d = running(d, "threshold", ["n", "p"], True).select("threshold", F.col("to_p").alias("tp"), (F.col("to_n") - F.col("to_p")).alias("fp")).crossJoin(F.broadcast(total))
    zero = d.where("threshold <> 0").select("threshold", "tp", "fp", "p", "q")
    none = d.groupBy().agg(F.lit(0.0).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.max("p").alias("p"), F.max("q").alias("q"))
    score_of = 0.5 * (F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("q") - F.col("fp"), "q"), F.lit(0.0)))
    return zero.unionByName(none).withColumn("balanced", score_of).agg(F.max_by(F.struct("threshold", "balanced"), F.struct(F.round("balanced", 12).alias("b"), (-F.col("threshold")).alias("t"))).alias("b")).select("b.threshold", "b.balanced")


def conformal_quantile(rows: DataFrame, nonconformity: Column, alpha: float = 0.1) -> DataFrame:
    """The nonconformity at rank min(n, ceil((n + 1)(1 - alpha)))."""
    d = rows.select(nonconformity.alias("_s")).where("_s IS NOT NULL").groupBy("_s").agg(F.count("*").alias("k"))
    total = d.agg(F.sum("k").alias("_n"))
    d = running(d, "_s", ["k"]).crossJoin(F.broadcast(total)).withColumnRenamed("to_k", "_to")
    rank = F.least(F.col("_n"), F.ceil((F.col("_n") + 1) * F.lit(1 - alpha) - 1e-9))
    return d.where(F.col("_to") >= rank).agg(F.min("_s").alias("quantile"))


def conformal_set(probabilities: dict[str, Column], quantile: Column) -> Column:
    """Labels whose nonconformity is within the quantile; the likeliest one if none is."""
    items = F.array(*(F.struct((-p).alias("n"), F.lit(k).alias("label"), p.alias("p")) for k, p in probabilities.items()))
    inside = F.transform(F.filter(items, lambda x: 1 - x["p"] <= quantile + 1e-12), lambda x: x["label"])
    best = F.transform(F.slice(F.array_sort(items), 1, 1), lambda x: x["label"])
    return F.when(F.size(inside) > 0, inside).otherwise(best)


def smoothed(count: Column, total: Column, classes: int = 3, weight: float = 0.15) -> Column:
    return (count + weight) / (total + weight * classes)


# logistic fits on a bounded sample, on the driver

MAX_FIT_ROWS = 100_000


def _pairs(rows: DataFrame, columns: Sequence[str], limit: int) -> np.ndarray:
    """At most ``limit`` rows in hash order, so that the same are taken each time."""
    n = rows.count()
    d = rows.select(*columns)
    if n > limit:
        d = d.orderBy(F.xxhash64(*columns)).limit(limit)
    return np.array([[float(x) for x in r] for r in d.collect()], dtype=float).reshape(-1, len(columns))


def fit_platt(rows: DataFrame, score: str, target: str, steps: int = 4000, rate: float = 0.05, l2: float = 1e-3, max_rows: int = MAX_FIT_ROWS) -> tuple[float, float]:
    """(weight, bias) of a one-dimensional logistic fit by gradient descent; a smoothed constant where there is one class."""
    data = _pairs(rows, [score, target], max_rows)
    x, y = data[:, 0], data[:, 1]
    if not len(x) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return 0.0, math.log(p / (1 - p))
    w = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
        w -= rate * (float(((p - y) * x).mean()) + l2 * w)
        b -= rate * float((p - y).mean())
    return w, b


def predict_platt(score: Column, model: tuple[float, float]) -> Column:
    return scores.sigmoid(score * model[0] + model[1])


def fit_logistic(rows: DataFrame, features: Sequence[str], target: str, steps: int = 4000, rate: float = 0.1, l2: float = 1e-2, max_rows: int = MAX_FIT_ROWS) -> dict[str, list[float]]:
    """Standardised features, classes weighted alike, gradient descent with an L2 penalty."""
    data = _pairs(rows, [*features, target], max_rows)
    x, y = data[:, :-1], data[:, -1]
    mean = x.mean(axis=0) if len(x) else np.zeros(len(features))
    std = x.std(axis=0) if len(x) else np.ones(len(features))
    std = np.where(std < 1e-8, 1.0, std)
    z = (x - mean) / std
    w, b = np.zeros(len(features)), 0.0
    pos, neg = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    weight = np.where(y == 1, len(y) / (2 * pos), len(y) / (2 * neg))
    for _ in range(steps if len(y) else 0):
        g = weight * (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y)
        w -= rate * (z.T @ g / len(y) + l2 * w)
        b -= rate * float(g.mean())
    return {"weight": w.tolist(), "bias": [b], "mean": mean.tolist(), "std": std.tolist()}


def predict_logistic(features: Sequence[Column], model: dict[str, list[float]]) -> Column:
    z = F.lit(model["bias"][0])
    for c, w, m, s in zip(features, model["weight"], model["mean"], model["std"], strict=True):
        z = z + w * ((c - m) / s)
    return scores.sigmoid(z)
