"""Ordinals and running sums in groups of any size.

A window puts a group into one task.  Where a group may be large the rows are
dealt by range of group and order instead, at splitters that Spark samples, so a
large group is spread over many parts; a part's running sums begin at what the
earlier parts of the same group sum up to.  Only groups that cross a splitter
have such a beginning, two for each part at most, so they can be broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of the largest group up to which a window does it.
GROUP_ROWS = 1_000_000
#: Rows that a part has, about.
PART_ROWS = 500_000


def _free(rows: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the rows has them."""
    have, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def parts_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column], part: str, n: int) -> DataFrame:
    """The rows with the number of their part, by ranges of group and order; kept in the shared folder, as a part must not change when it is read again.

    Rows that are equal in both may be parted as well.
    """
    spark = rows.sparkSession
    (tie,) = _free(rows, "_tie")
    tied = rows.withColumn(tie, F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, *(F.col(_quoted(c)) for c in by), *order, tie).drop(tie).withColumn(part, F.spark_partition_id())
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column], group_rows: int = GROUP_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds for each name the sum of a column over the rows of the same group up to this one; null values count nothing.

    ``by`` may be empty: then all rows are one group.  Rows that are equal in ``order`` come in any order, so what has to
    be the same for ties is summed up by value first.  Where no group has more than ``group_rows`` rows this is a window.
    """
    groups = [F.col(_quoted(c)) for c in by]
    counts = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    sizes = counts.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    if (sizes["most"] or 0) <= group_rows:
        along = W.partitionBy(*(groups or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({k: F.coalesce(F.sum(v).over(along), F.lit(0)) for k, v in sums.items()})
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, *before = _free(rows, "_part", *(f"_before_{k}" for k in range(len(sums))))
    d = parts_of(rows, by, order, part, max(width, -(-(sizes["total"] or 0) // part_rows)))
    of_part = d.groupBy(*groups, part).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(b) for b, v in zip(before, sums.values(), strict=True)))
    keys = [f"_key_{k}" for k in range(len(by))]
    of_part = of_part.select(*(g.alias(k) for g, k in zip(groups, keys, strict=True)), F.col(part).alias("_at"), *before)
    ahead = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    starts = of_part.select(*keys, "_at", *(F.sum(b).over(ahead).alias(b) for b in before)).where(F.col(before[0]).isNotNull())
    same = F.col(part) == F.col("_at")
    for g, k in zip(groups, keys, strict=True):
        same &= g.eqNullSafe(F.col(k))
    met = d.join(F.broadcast(starts), same, "left")  # one row for each splitter within a group
    along = W.partitionBy(part, *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return met.withColumns({k: F.coalesce(F.col(b), F.lit(0)) + F.coalesce(F.sum(v).over(along), F.lit(0)) for (k, v), b in zip(sums.items(), before, strict=True)}).drop(part, "_at", *keys, *before)


def mid_ranks(rows: DataFrame, by: Sequence[str], value: str, name: str, group_rows: int = GROUP_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds the rank, from 1, of each row's value in its group; equal values share the mean of their ranks.

    Counts of distinct values are summed up, and rows meet them by group and value, so neither a large group nor a
    common value is one task's: what a common value meets is one row, which Spark's skew join sends to its parts.
    """
    (n,) = _free(rows, "_n")
    counts = rows.groupBy(*(F.col(_quoted(c)) for c in by), F.col(_quoted(value))).agg(F.count("*").alias(n))
    ranked = running(counts, by, [F.col(_quoted(value)).asc_nulls_first()], {name: F.col(n)}, group_rows, part_rows)
    keys = [*by, value]
    ranked = ranked.select(*(F.col(_quoted(c)).alias(f"_key_{k}") for k, c in enumerate(keys)), (F.col(name) - (F.col(n) - 1) / 2).alias(name))
    same = F.lit(True)
    for k, c in enumerate(keys):
        same &= rows[_quoted(c)].eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(ranked, same).drop(*(f"_key_{k}" for k in range(len(keys))))
