"""Exact order statistics of groups of any size, by histograms that close in on them.

Each pass counts a group's values in bins and keeps the one bin that holds the
wanted place, until that bin has a single value.  Where what is left spans an
octave or more, or zero, bins are shares of octaves, as an order-preserving view
of a number's bits is; within an octave they are equal parts.  So a few passes do
for any range of values, rows are read where they are, and only counts of bins
are exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder
from .ordered import GROUP_ROWS
from .retrieval import small

#: Bins of a pass within an octave, and bins to an octave.
BINS, TO_OCTAVE = 4096, 64


def linear(p: float) -> tuple[Column, Column, Column]:
    """Places around the quantile, zero-based, and how far it is from the first to the second; of ``n`` rows."""
    at = F.lit(p) * (F.col("n") - 1)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def _alone(place: Column) -> tuple[Column, Column, Column]:
    return place, place, F.lit(0.0)


def nearest(p: float) -> tuple[Column, Column, Column]:
    return _alone(F.greatest(F.ceil(F.col("n") * p - 1e-6), F.lit(1)) - 1)


def floor(p: float) -> tuple[Column, Column, Column]:
    return _alone(F.least(F.floor(F.col("n") * p), F.col("n") - 1))


def rounded(p: float) -> tuple[Column, Column, Column]:
    return _alone(F.bround((F.col("n") - 1) * p, 0).cast("long"))


def _bin(v: Column, low: Column, high: Column) -> Column:
    """A bin that doesn't fall as the value rises, and in which ``low`` and ``high`` aren't together."""
    octave = F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * TO_OCTAVE) + 2000 * TO_OCTAVE)).cast("long")
    wide = (F.signum(low) != F.signum(high)) | (F.greatest(F.abs(low), F.abs(high)) >= 2 * F.least(F.abs(low), F.abs(high)))
    return F.when(wide, octave).otherwise(F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1)))


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, n, names): the values, as doubles, at zero-based places of each group's ascending order; places are expressions of ``n``.

    Nulls and NaN aren't values; a group without any has no row.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    groups = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("_t"), c.cast("long").alias("_place")) for k, c in enumerate(places.values()))))
    state = groups.withColumn("_x", wanted).select(*by, "n", "_x._t", "_x._place", "_low", "_high", F.lit(0).cast("long").alias("_below")).checkpoint()
    closed = state.where("_low = _high")
    left = state.where("_low < _high")
    while left.limit(1).count():
        named = small(left.select(*(F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)), *(c for c in left.columns if c not in by)))
        same = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
        for k, c in enumerate(by):
            same &= F.col(c).eqNullSafe(F.col(f"_by_{k}"))
        inside = v.join(named, same).groupBy(*by, "n", "_t", "_place", "_below", _bin(F.col("_v"), F.col("_low"), F.col("_high")).alias("_bin")).agg(F.count("*").alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.col("_below") + F.sum("_k").over(W.partitionBy(*by, "_t").orderBy("_bin"))
        found = inside.withColumn("_upto", upto).where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_k") <= F.col("_place")))
        state = found.select(*by, "n", "_t", "_place", "_low", "_high", (F.col("_upto") - F.col("_k")).alias("_below")).checkpoint()
        closed = closed.unionByName(state.where("_low = _high"))
        left = state.where("_low < _high")
    return closed.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_t") == k, F.col("_low"))).alias(name) for k, name in enumerate(places)))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, wanted: dict[str, tuple[Column, Column, Column]], group_rows: int = GROUP_ROWS) -> DataFrame:
    """(by, names): quantiles of each group, each by one of the definitions above.

    Where no group has more than ``group_rows`` values a window finds the places; else ``order_statistics`` does.
    """
    places = {f"_{k}_{j}": c for k, q in enumerate(wanted.values()) for j, c in enumerate(q[:2])}
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    most = v.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most <= group_rows:
        over = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        d = v.withColumns({"_r": F.row_number().over(over.orderBy("_v")) - 1, "n": F.count("*").over(over)})
        d = d.groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_r") == c, F.col("_v"))).alias(k) for k, c in places.items()))
    else:
        d = order_statistics(rows, by, value, places)
    between = lambda k, part: F.col(f"_{k}_0") + part * (F.col(f"_{k}_1") - F.col(f"_{k}_0"))
    return d.select(*by, *(between(k, q[2]).alias(name) for k, (name, q) in enumerate(wanted.items())))
