"""Time series and logs: stage intervals, running and last-row windows, discounted sums, summaries of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running as running_sums
from .selection import nearest, quantiles


def stage_bounds(stages: DataFrame, start: str, samples: DataFrame, ts: str) -> DataFrame:
    """Each stage with its end: the next stage's start, and just after the last sample for the last one."""
    end = samples.agg((F.max(ts) + 1e-6).alias("_last"))
    return stages.crossJoin(F.broadcast(end)).withColumn("end", F.coalesce(F.lead(start).over(W.partitionBy(F.lit(0)).orderBy(start)), F.col("_last"))).drop("_last")


def in_stage(samples: DataFrame, ts: str, starts: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The stage of each sample; the boundaries are few and sorted, so the place is found without a join."""
    bounds = F.array(*(F.lit(float(s)) for s in starts))
    at = F.size(F.filter(bounds, lambda b: b <= F.col(ts)))
    return samples.where(at > 0).withColumn("stage", F.get(F.array(*(F.lit(n) for n in names)), at - 1))


def stage_summary(samples: DataFrame, stage: str, ts: str, value: str) -> DataFrame:
    s = samples.groupBy(stage).agg(F.count("*").alias("n"), F.greatest(F.max(ts) - F.min(ts), F.lit(0.0)).alias("duration"), F.max(value).alias("peak"), F.avg(value).alias("mean"))
    return s.join(quantiles(samples, [stage], value, {"p95": nearest(0.95)}), stage, "left")


def discounted(rows: DataFrame, group: str, order: str, reward: str, gamma: float) -> DataFrame:
    """Reverse discounted sums G_t = r_t + gamma * G_(t+1) within each group.

    A group is one trajectory of bounded length, so it is folded as an array.
    """
    steps = F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("k"), F.col(reward).cast("double").alias("r"))))
    empty = F.array().cast("array<struct<k:bigint,g:double>>")
    fold = F.aggregate(steps, empty, lambda acc, x: F.concat(acc, F.array(F.struct(x["k"].cast("long").alias("k"), (x["r"] + gamma * F.coalesce(F.try_element_at(acc, F.lit(-1))["g"], F.lit(0.0))).alias("g")))))
    d = rows.groupBy(group).agg(fold.alias("_f")).select(group, F.explode("_f").alias("f"))
    return d.select(group, (-F.col("f.k")).alias(order), F.col("f.g").alias("discounted"))


def last_rows(rows: DataFrame, group: Sequence[str], order: str, n: int) -> DataFrame:
    by = W.partitionBy(*(group or [F.lit(0)])).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).drop("_r")


def row_buckets(rows: DataFrame, group: str, order: str, size: int, value: str) -> DataFrame:
    """Runs of ``size`` rows of each group, in order, with the first and last of each and the mean; groups of any size."""
    d = running_sums(rows, [group], [F.col(order)], {"bucket": F.lit(1)})
    d = d.withColumn("bucket", F.floor((F.col("bucket") - 1) / size))
    return d.groupBy(group, "bucket").agg(F.concat_ws("-", F.min(order).cast("string"), F.max(order).cast("string")).alias("label"), F.count("*").alias("n"), F.avg(value).alias("mean"))


def running(c: Column, kind: str, group: str, order: str) -> Column:
    by = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return {"mean": F.avg, "best": F.max, "sum": F.sum}[kind](c).over(by)


def sampled_action(probabilities: DataFrame, group: str, order: str, p: str, draw: Column) -> DataFrame:
    """The first row of each group whose cumulative probability reaches the draw; the last if rounding leaves none.

    Of rows that share a cumulative probability, as one of probability zero does with that before, the first in order counts.
    """
    by = W.partitionBy(group).orderBy(order)
    d = probabilities.withColumns({"_c": F.sum(p).over(by.rowsBetween(W.unboundedPreceding, 0)), "_draw": draw})
    return d.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("_c") >= F.col("_draw"), F.col(order))), F.max(order)).alias("chosen"))


def experiment_summary(episodes: DataFrame, setting: str, seed: str, episode: str, success: str, reward: str, n: int = 10) -> DataFrame:
    """Success rates overall and over the first and last ``n`` episodes per seed, averaged over the seeds."""
    last = F.max(episode).over(W.partitionBy(setting, seed))
    d = episodes.withColumn("_last", last)
    ok = F.col(success).cast("double")
    per = d.groupBy(setting, seed).agg(
        F.avg(ok).alias("success"),
        F.avg(F.when(F.col(episode) < n, ok)).alias("first"),
        F.avg(F.when(F.col(episode) > F.col("_last") - n, ok)).alias("last"),
        F.min(F.when(F.col(success), F.col(episode))).alias("first_success"),
        F.avg(reward).alias("reward"),
    )
    return per.groupBy(setting).agg(F.count("*").alias("n_seeds"), F.avg("success").alias("success_rate"), F.avg("first").alias("first_rate"), F.avg("last").alias("last_rate"), F.avg("first_success").alias("first_success"), F.avg("reward").alias("mean_reward"))


def extremes(rows: DataFrame, step: str, loss: str) -> DataFrame:
    """First and last row by step, and the step of least loss."""
    return rows.agg(F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss"), F.min(loss).alias("best_loss"), F.min_by(step, F.struct(F.col(loss), F.col(step))).alias("best_step"))


def merge_segments(segments: dict[str, tuple[DataFrame, int, int]], step: str) -> DataFrame:
    """Logs of resumed runs, each cut to its own range of steps."""
    out = None
    for name, (d, first, last) in segments.items():
        part = d.where(F.col(step).between(first, last)).withColumn("segment", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
