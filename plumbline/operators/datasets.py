"""Order by hash, samples, splits, set algebra and leakage between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import stable_order


def in_stable_order(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order that looks random and never changes."""
    return rows.orderBy(stable_order(seed, F.col(key)), key)


def ranked(rows: DataFrame, strata: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Adds ``_rank``, the place within the stratum by stable order.

    The order's leading digits cut a stratum into 4096 bins of like size; ranks
    are counted out by bins, so that no task sorts a whole stratum.
    """
    strata = list(strata)
    d = rows.withColumn("_order", stable_order(seed, F.col(key))).withColumn("_bin", F.substring("_order", 1, 3))
    named = [F.col(s).alias(f"_s{k}") for k, s in enumerate(strata)]
    keys = [f"_s{k}" for k in range(len(strata))]
    sizes = d.select(*named, F.col("_bin").alias("_b")).groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_bin") == F.col("_b")
    for k, s in zip(keys, strata, strict=True):
        same = same & F.col(s).eqNullSafe(F.col(k))
    d = d.withColumn("_in", F.row_number().over(W.partitionBy(*strata, "_bin").orderBy("_order", key)))
    return d.join(starts, same).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_order", "_bin", "_b", "_before", "_in", *keys)


def balanced_sample(rows: DataFrame, label: str, key: str, per_class: int = 0, seed: int = 42) -> DataFrame:
    """``per_class`` rows of each class, 0 for as many as the smallest has."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    least = sizes.agg(F.min("_n").alias("_least"))
    r = ranked(rows, [label], key, seed)
    if per_class:
        short = sizes.where(F.col("_n") < per_class).count()
        if short:
            raise ValueError(f"{short} classes have fewer than {per_class} rows")
        return r.where(F.col("_rank") <= per_class).drop("_rank")
    return r.crossJoin(F.broadcast(least)).where("_rank <= _least").drop("_rank", "_least")


def split(rows: DataFrame, strata: Sequence[str], key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Fixed numbers of rows per stratum for each split, disjoint; what is left over has no split."""
    r = ranked(rows, strata, key, seed)
    out, upto = F.lit(None).cast("string"), 0
    for name, n in quotas.items():
        out = F.when((F.col("_rank") > upto) & (F.col("_rank") <= upto + n), name).otherwise(out)
        upto += n
    return r.withColumn("split", out).drop("_rank").where("split IS NOT NULL")


def share_split(rows: DataFrame, strata: Sequence[str], key: str, share: float = 0.8, seed: int = 42, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """The first ``share`` of each stratum, and the rest."""
    named = [F.col(s).alias(f"_t{k}") for k, s in enumerate(strata)]
    sizes = rows.select(*named).groupBy(*(f"_t{k}" for k in range(len(strata)))).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for k, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_t{k}"))
    r = ranked(rows, strata, key, seed).join(sizes, same)
    return r.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_n") * share), names[0]).otherwise(names[1])).drop("_rank", "_n", *(f"_t{k}" for k in range(len(strata))))


def hash_split(rows: DataFrame, key: str, parts: dict[str, int], seed: int = 42) -> DataFrame:
    """Split by a hash of the key alone: no shuffle, and a row's split never changes as others come."""
    total = sum(parts.values())
    h = F.conv(F.substring(stable_order(seed, F.col(key)), 1, 8), 16, 10).cast("long") % total
    out, upto = F.lit(None).cast("string"), total
    for name, n in reversed(parts.items()):
        upto -= n
        out = F.when((h >= upto) & (h < upto + n), name).otherwise(out)
    return rows.withColumn("split", out)


def positional(rows: DataFrame, key: str, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Splits by place in key order, [from, to).  No row beyond the last place is numbered; the places are parameters, not the table's size."""
    first = rows.orderBy(key).limit(max(b for _, b in ranges.values()))
    r = first.withColumn("_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key)) - 1)
    each = F.array_compact(F.array(*(F.when((F.col("_at") >= a) & (F.col("_at") < b), F.lit(name)) for name, (a, b) in ranges.items())))
    return r.withColumn("split", F.explode(each)).drop("_at")


def page(rows: DataFrame, key: str, offset: int, limit: int = 0) -> DataFrame:
    """Rows from an offset in key order; limit 0 for all."""
    d = rows.orderBy(key).offset(offset)
    return d.limit(limit) if limit else d


def capped(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each group in key order; 0 for all."""
    if not n:
        return rows
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(key))).where(F.col("_r") <= n).drop("_r")


def first_of_each(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The first row of each group by key; an aggregation, not a sort."""
    return rows.groupBy(group).agg(F.min_by(F.struct(*rows.columns), key).alias("_r")).select("_r.*")


def sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(stable_order(seed, F.col(key)), key).limit(k)


def clamped_top(rows: DataFrame, order: Sequence[Column], k: int, most: int = 20) -> DataFrame:
    return rows.orderBy(*order).limit(max(1, min(most, k)))


def merged(parts: dict[str, DataFrame], name: str = "evaluation_split") -> DataFrame:
    out = None
    for split_name, d in parts.items():
        d = d.withColumn(name, F.lit(split_name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both key sets, their intersection and differences, and whether one is within the other."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full_outer")
    both, only_a, only_b = (F.count_if(c) for c in (F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("_b").isNull(), F.col("_a").isNull()))
    return j.agg(both.alias("n_both"), only_a.alias("n_only_left"), only_b.alias("n_only_right")).withColumns({"disjoint": F.col("n_both") == 0, "subset": F.col("n_only_left") == 0})


def overlaps(splits: DataFrame, split_column: str, key: Column) -> DataFrame:
    """Keys that occur in two splits, counted for each pair of splits; keys are grouped, never joined pairwise."""
    g = splits.select(F.col(split_column).alias("s"), key.alias("_k")).distinct().groupBy("_k").agg(F.array_sort(F.collect_set("s")).alias("ss")).where(F.size("ss") > 1)
    a = g.select("ss", F.posexplode("ss").alias("i", "left"))
    pairs = a.select("left", F.explode(F.expr("slice(ss, i + 2, size(ss))")).alias("right"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("n_overlap"))
