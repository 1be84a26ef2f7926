"""Paired comparisons: bootstrap intervals and the exact McNemar test."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: P(X <= k) of a Poisson(1) variate, up to what a double tells from 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
#: Draws that are made at once.
_DRAWS = 1 << 21


def paired(before: DataFrame, after: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Differences after - before for the keys that both have."""
    a = before.select(key, *(F.col(m).cast("double").alias(f"_{m}") for m in metrics))
    return after.join(a, key).select(key, *((F.col(m).cast("double") - F.col(f"_{m}")).alias(m) for m in metrics))


def poisson_weights(keys: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) draws of each key in each resample: counter-based, so a key has its own whatever rows are beside it."""
    u64 = np.uint64
    x = keys.view(u64)[:, None] + np.arange(1, resamples + 1, dtype=u64) * u64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the public SplitMix64 finaliser
        x ^= x >> u64(shift)
        x *= u64(factor)
    x ^= x >> u64(31)
    return np.searchsorted(_POISSON, (x >> u64(11)) * 2.0**-53, "right")


def bootstrap(differences: DataFrame, metrics: Sequence[str], key: str, resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean difference with a percentile interval for each metric.

    A resample draws each row as often as a Poisson(1) variate says, the limit
    of drawing with replacement, so rows need not meet in one task: each slice
    of rows yields weighted sums for all resamples, and these add up.  A row's
    draws follow from its key and the seed alone, not from its values, its
    partition or batch.  One draw serves all metrics, so they stay paired.
    """
    names = list(metrics)
    keyed = differences.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), *names)
    step = max(1, _DRAWS // resamples)

    def sums(frames):
        total = np.zeros((resamples, len(names) + 1))
        for pdf in frames:
            values = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
            hashes = pdf["_h"].to_numpy(np.int64)
            for at in range(0, len(pdf), step):
                total += poisson_weights(hashes[at : at + step], resamples).T.astype(float) @ values[at : at + step]
        yield pd.DataFrame({"resample": np.arange(resamples), "n": total[:, 0], **{m: total[:, k + 1] for k, m in enumerate(names)}})

    drawn = keyed.mapInPandas(sums, "resample int, n double, " + ", ".join(f"{m} double" for m in names))
    means = drawn.groupBy("resample").agg(*((F.sum(m) / F.sum("n")).alias(m) for m in names))
    tail = (1 - level) / 2
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))
    interval = means.select(F.inline(each)).groupBy("metric").agg(F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"))
    point = differences.agg(*(F.avg(m).alias(m) for m in names)).select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("difference")) for m in names))))
    return point.join(interval, "metric")


def mcnemar_p(improved: int, regressed: int) -> float:
    """Two-sided exact binomial probability of discordant pairs at least as uneven.

    The tail is summed downwards from its largest term, in logarithms, until terms no longer count.
    """
    n, k = improved + regressed, min(improved, regressed)
    if not n:
        return 1.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    total, term = 0.0, 1.0
    for i in range(k, -1, -1):
        total += term
        term *= i / (n - i + 1)
        if term < 1e-18 * total:
            break
    return min(1.0, 2 * math.exp(first) * total)


def mcnemar(pairs: DataFrame, before: str, after: str) -> dict[str, float]:
    r = pairs.agg(F.count_if(~F.col(before) & F.col(after)).alias("improved"), F.count_if(F.col(before) & ~F.col(after)).alias("regressed")).first()
    return {"improved": r.improved, "regressed": r.regressed, "p_value": mcnemar_p(r.improved, r.regressed)}
