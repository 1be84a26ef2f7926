"""Scorecards, confusion, F1, quantiles, normalising, retrieval metrics, vote and entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scorecard(rows: DataFrame, sets: Sequence[str], correct: Column, length: Column) -> DataFrame:
    """Overall and by each grouping column: n, accuracy, mean and largest length, in one pass of grouping sets."""
    d = rows.select(*sets, correct.cast("double").alias("_ok"), length.alias("_len"))
    grouped = d.groupingSets([[], *([F.col(s)] for s in sets)], *sets)
    return grouped.agg(
        *(F.grouping(s).cast("int").alias(f"g_{s}") for s in sets),
        F.count("*").alias("n"),
        F.avg("_ok").alias("accuracy"),
        F.avg("_len").alias("mean_chars"),
        F.max("_len").alias("max_chars"),
    )


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit("unknown")).alias("pred")).agg(F.count("*").alias("n"))


def recall_by_class(rows: DataFrame, gold: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """Recall of each listed label; 0 for one that doesn't occur."""
    listed = F.explode(F.array(*(F.lit(x) for x in labels)))
    hits = rows.groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("hit"))
    every = rows.sparkSession.range(1).select(listed.alias("label"))
    return every.join(hits, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)).alias("recall"))


def class_counts(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, tp, fp, fn) from one pass: each row counts for its gold and its predicted label."""
    g, p = F.col(gold), F.col(pred)
    each = F.array_distinct(F.array_compact(F.array(g, p)))
    return rows.select(g.alias("_g"), p.alias("_p"), F.explode(each).alias("label")).groupBy("label").agg(
        F.count_if((F.col("_g") == F.col("label")) & (F.col("_p") == F.col("label"))).alias("tp"),
        F.count_if((F.col("_p") == F.col("label")) & ~F.col("_g").eqNullSafe(F.col("label"))).alias("fp"),
        F.count_if((F.col("_g") == F.col("label")) & ~F.col("_p").eqNullSafe(F.col("label"))).alias("fn"),
    )


def macro_f1(rows: DataFrame, gold: str, pred: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Mean F1 over the listed labels, or over those in gold; 0 where a label's denominators are empty."""
    counts = class_counts(rows, gold, pred)
    if labels is None:
        counts = counts.where("tp + fn > 0")
    else:
        every = rows.sparkSession.range(1).select(F.explode(F.array(*(F.lit(x) for x in labels))).alias("label"))
        counts = every.join(counts, "label", "left").fillna(0)
    return counts.agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).alias("macro_f1"))


# normalising within a group, each with its own rule for a constant group


def min_max(c: Column, by) -> Column:
    low, high = F.min(c).over(by), F.max(c).over(by)
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.when(c > 0, 1.0).otherwise(0.0))


def centred(c: Column, by) -> Column:
    """Deviation from the mean by the largest deviation (1e-8 at least); two windows, so the mean is a column first."""
    return c - F.avg(c).over(by)


def max_abs(d: DataFrame, c: str, by, name: str) -> DataFrame:
    d = d.withColumn("_c", centred(F.col(c), by))
    return d.withColumn(name, F.col("_c") / F.greatest(F.max(F.abs("_c")).over(by), F.lit(1e-8))).drop("_c")


def standardised(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the value's distance from its group's mean in standard deviations; 1 stands for a deviation below 1e-8.

    The groups' moments are summed up before any exchange and joined back, so a large group isn't one task's.
    """
    moments = rows.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    d = rows.join(moments, F.col(by).eqNullSafe(F.col("_by")))
    return d.withColumn(name, (F.col(value) - F.col("_mean")) / F.when(F.col("_std") < 1e-8, 1.0).otherwise(F.col("_std"))).drop("_by", "_mean", "_std")


def softmax(d: DataFrame, c: str, by, name: str, temperature: float = 1.0) -> DataFrame:
    d = d.withColumn("_e", F.exp((F.col(c) - F.max(c).over(by)) / temperature))
    return d.withColumn(name, F.col("_e") / F.sum("_e").over(by)).drop("_e")


def weighted_moments(rows: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Weighted mean and variance, and the agreement 1 / (1 + deviation); from three sums."""
    w, x = F.col(weight), F.col(value)
    s = rows.groupBy(group).agg(F.sum(w).alias("_w"), F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"))
    mean = F.col("_wx") / F.col("_w")
    var = F.greatest(F.col("_wxx") / F.col("_w") - mean * mean, F.lit(0.0))
    return s.select(group, mean.alias("weighted_mean"), var.alias("weighted_variance"), (1 / (1 + F.sqrt(var))).alias("agreement"))


def group_advantage(rows: DataFrame, group: Sequence[str], reward: str, bound: float = 1.0) -> DataFrame:
    """Reward less the mean of the group's others, by the deviation of these differences, within bounds."""
    by = W.partitionBy(*group)
    n, total = F.count("*").over(by), F.sum(reward).over(by)
    d = rows.withColumn("_a", F.when(n > 1, F.col(reward) - (total - F.col(reward)) / F.greatest(n - 1, F.lit(1))).otherwise(0.0))
    d = d.withColumn("advantage", F.col("_a") / (F.stddev_pop("_a").over(by) + 1e-6)).drop("_a")
    return d.withColumn("advantage", F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("advantage"))))


def regression(rows: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    return rows.agg(
        F.avg((a - b) * (a - b)).alias("mse"),
        F.avg(F.abs(a - b)).alias("mae"),
        (cov / F.greatest(F.stddev_pop(a) * F.stddev_pop(b), F.lit(1e-8))).alias("pearson"),
        F.avg((F.bround(a, 0) == F.bround(b, 0)).cast("double")).alias("rounded_accuracy"),
    )


def retrieval(ranked: DataFrame, query: str, relevant: str, rank: str, k: int, n_relevant: str) -> DataFrame:
    """Per query recall@k, precision@k and the reciprocal rank of the first relevant row."""
    hit = F.col(relevant) & (F.col(rank) <= k)
    return ranked.groupBy(query).agg(
        F.coalesce(F.try_divide(F.count_if(hit), F.max(n_relevant)), F.lit(0.0)).alias("recall"),
        (F.count_if(hit) / F.lit(float(k))).alias("precision"),
        F.coalesce(1.0 / F.min(F.when(F.col(relevant), F.col(rank))), F.lit(0.0)).alias("rr"),
    )


def votes(rows: DataFrame, case: str, choice: str, order: str) -> DataFrame:
    """The choice with most votes; of equal ones that seen first."""
    n = rows.groupBy(case, choice).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(F.col(choice), F.col("votes")), F.struct("votes", (-F.col("_first")).alias("f")))
    return n.groupBy(case).agg(best.alias("_b"), F.sum("votes").alias("n")).select(case, F.col(f"_b.{choice}").alias(choice), "_b.votes", "n")


def supported(rows: DataFrame, case: str, choice: str) -> DataFrame:
    """Choices with votes from at least half of the case's rows; if none has, those with most votes."""
    n = rows.groupBy(case, choice).agg(F.count("*").alias("votes"))
    by = W.partitionBy(case)
    total, most = F.sum("votes").over(by), F.max("votes").over(by)
    d = n.withColumns({"_need": F.ceil(total / 2), "_most": most})
    return d.where(F.when(F.col("_most") >= F.col("_need"), F.col("votes") >= F.col("_need")).otherwise(F.col("votes") == F.col("_most"))).select(case, choice, "votes")


def semantic_entropy(rows: DataFrame, case: str, cluster: Column) -> DataFrame:
    """Entropy of the case's clusters by the log of its rows; 0 for a single row."""
    n = rows.groupBy(case, cluster.alias("_c")).agg(F.count("*").alias("k"))
    s = n.groupBy(case).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("_kl"))
    h = F.ln("n") - F.col("_kl") / F.col("n")
    return s.select(case, "n", F.when(F.col("n") > 1, F.greatest(h / F.ln("n"), F.lit(0.0))).otherwise(0.0).alias("entropy"))


def dedup_counts(rows: DataFrame, normal: Column, label: str) -> DataFrame:
    """What dropping repeated texts and texts with several labels removes."""
    g = rows.groupBy(normal.alias("_t")).agg(F.count("*").alias("k"), F.count_distinct(label).alias("labels"))
    return g.agg(
        F.sum("k").alias("n_rows"),
        F.count("*").alias("n_unique"),
        F.count_if(F.col("labels") > 1).alias("n_conflict"),
        (F.sum("k") - F.count_if(F.col("labels") == 1)).alias("n_removed"),
    )


def deduplicated(rows: DataFrame, normal: Column, label: str, order: str) -> DataFrame:
    """One row, the first, for each normalised text with one label only."""
    keyed = rows.withColumn("_t", F.sha2(normal, 256))
    first = keyed.groupBy("_t").agg(F.min_by(F.struct(*rows.columns), order).alias("_r"), F.count_distinct(label).alias("_n")).where("_n = 1")
    return first.select("_r.*")


def finite_summary(rows: DataFrame, value: str, step: str, threshold: float) -> DataFrame:
    """Mean of the finite values, how many aren't, the largest with its step, and how many exceed a threshold."""
    x = F.col(value)
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.when(ok, x)
    return rows.agg(
        F.count("*").alias("n"),
        F.avg(good).alias("mean"),
        F.count_if(~ok).alias("non_finite"),
        F.max(good).alias("largest"),
        F.max_by(step, F.when(ok, F.struct(x.alias("x"), (-F.col(step)).alias("s")))).alias("largest_step"),
        F.count_if(ok & (x > threshold)).alias("over"),
    )


def key_means(rows: DataFrame, metrics: str) -> DataFrame:
    """Mean of each key of a map column: columns that aren't known beforehand."""
    return rows.select(F.explode(metrics).alias("metric", "value")).groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def attribution(rows: DataFrame, categories: dict[str, tuple[Column, Column]], key: str, n_examples: int = 5) -> DataFrame:
    """For each category: rows it applies to, failures among them, the rate, and a few examples."""
    each = F.array(*(F.struct(F.lit(c).alias("category"), a.alias("applicable"), f.alias("failed")) for c, (a, f) in categories.items()))
    d = rows.select(F.col(key).alias("_k"), F.inline(each)).where("applicable")
    failed = F.coalesce(F.col("failed"), F.lit(False))
    counts = d.groupBy("category").agg(F.count("*").alias("applicable"), F.count_if(failed).alias("failures"))
    ranked = d.where(failed).withColumn("_r", F.row_number().over(W.partitionBy("category").orderBy("_k"))).where(F.col("_r") <= n_examples)
    examples = ranked.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_k")), lambda k: k.cast("string")), ",").alias("examples"))
    return counts.join(examples, "category", "left").select("category", "applicable", "failures", (F.col("failures") / F.col("applicable")).alias("rate"), F.coalesce("examples", F.lit("")).alias("examples"))
