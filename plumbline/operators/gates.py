"""Quality gates: each gives a row with what it checked and how many rows violate it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate that must hold doesn't."""


def gate(rows: DataFrame, name: str, ok: Column, key: str | None = None) -> DataFrame:
    """(gate, n_checked, n_violations, example); a null condition is a violation."""
    bad = ~F.coalesce(ok, F.lit(False))
    example = F.min(F.when(bad, F.col(key).cast("string"))) if key else F.lit(None).cast("string")
    return rows.agg(F.lit(name).alias("gate"), F.count("*").alias("n_checked"), F.count_if(bad).alias("n_violations"), example.alias("example"))


def report(*gates: DataFrame) -> DataFrame:
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def enforce(*gates: DataFrame) -> None:
    """Raises with the names of the gates that don't hold."""
    bad = report(*gates).where("n_violations > 0").collect()
    if bad:
        raise GateError("; ".join(f"{r.gate}: {r.n_violations} of {r.n_checked}, as {r.example}" for r in bad))


def message_structure(m: Column) -> Column:
    """Roles alternate from user to assistant after an optional system prompt, and contents aren't blank."""
    talk = F.filter(m, lambda x, i: ~((i == 0) & (x["role"] == "system")))
    roles = F.forall(F.transform(talk, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b)
    return (F.size(talk) > 0) & roles & F.forall(talk, lambda x: F.length(F.trim(x["content"])) > 0)


def ends_with(m: Column, role: str) -> Column:
    return F.try_element_at(m, F.lit(-1))["role"] == role


def mark_count(m: Column, mark: str, expected: Column) -> Column:
    text = F.array_join(F.transform(m, lambda x: x["content"]), "\n")
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark) == expected


def balance(rows: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """Rows of each class against an expected histogram: what differs."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(expected.items()), f"{column} string, expected long")
    got = rows.groupBy(column).agg(F.count("*").alias("found"))
    return want.join(got, column, "full_outer").select(column, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).where("expected <> found")


def no_leak(ids: Column, content: Column) -> Column:
    return ~F.exists(ids, lambda g: F.contains(content, g))


def evidence_holds(terms: Column, content: Column, n: int = 3) -> Column:
    return (F.size(F.array_distinct(terms)) == n) & F.forall(terms, lambda t: F.contains(content, t))


def same_protocol(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each configuration key: values that differ among runs; all null counts as equal, some null doesn't."""
    return runs.agg(*(F.struct(F.count_distinct(k).alias("n"), F.count_if(F.col(k).isNull()).alias("missing"), F.count("*").alias("runs")).alias(k) for k in keys)).select(
        F.inline(F.array(*(F.struct(F.lit(k).alias("key"), ((F.col(f"{k}.n") <= 1) & F.col(f"{k}.missing").isin(0, F.col(f"{k}.runs"))).alias("equal")) for k in keys)))
    )


def contiguity(rows: DataFrame, step: str, first: int, last: int) -> DataFrame:
    """Steps of [first, last] that are missing, and those that come twice."""
    want = rows.sparkSession.range(first, last + 1).select(F.col("id").alias("step"))
    got = rows.where(F.col(step).between(first, last)).groupBy(F.col(step).alias("step")).agg(F.count("*").alias("n"))
    j = want.join(got, "step", "left")
    return j.agg(F.count("*").alias("n_expected"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("n") > 1).alias("n_duplicate"), F.min(F.when(F.col("n").isNull(), F.col("step"))).alias("first_missing"))


def adjacent(segments: DataFrame, start: str, end: str) -> DataFrame:
    """Segments that don't begin right after the one before."""
    d = segments.withColumn("_prev", F.lag(end).over(W.partitionBy(F.lit(0)).orderBy(start)))
    return d.where(F.col("_prev").isNotNull() & (F.col(start) != F.col("_prev") + 1)).drop("_prev")


def length_audit(rows: DataFrame, group: str, length: str, limit: int) -> DataFrame:
    c = F.col(length)
    return rows.groupBy(group).agg(
        F.count("*").alias("n"),
        F.min(c).alias("shortest"),
        F.percentile(c, F.lit(0.5)).alias("p50"),
        F.percentile(c, F.lit(0.95)).alias("p95"),
        F.max(c).alias("longest"),
        F.count_if(c > limit).alias("n_over"),
    )


def ranges_disjoint(a: tuple[int, int], b: tuple[int, int], n: int) -> None:
    """(offset, rows) of two subsets of n rows: neither overlapping nor beyond the end."""
    for offset, rows in (a, b):
        if offset < 0 or rows <= 0 or offset + rows > n:
            raise GateError(f"rows {offset} to {offset + rows} aren't within {n}")
    if max(a[0], b[0]) < min(a[0] + a[1], b[0] + b[1]):
        raise GateError(f"{a} and {b} overlap")


def complete(rows: DataFrame, expected: int) -> bool:
    """Whether a stored result has as many rows as it should, so that it may be used again."""
    return rows.count() == expected


def arguments(**checks: bool) -> None:
    bad = [k for k, ok in checks.items() if not ok]
    if bad:
        raise ValueError(f"out of range: {', '.join(bad)}")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """Keys that come more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def key_sets_equal(a: DataFrame, b: DataFrame, key: str, show: int = 10) -> DataFrame:
    """Keys missing on either side: their number and the first few."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    side = lambda l, r, name: l.join(r, key, "left_anti").select(F.lit(name).alias("missing_in"), F.col(key).alias("_k"))
    d = side(x, y, "right").unionByName(side(y, x, "left"))
    # the first few of a side are cut from each partition before they meet
    first = d.withColumn("_r", F.row_number().over(W.partitionBy("missing_in").orderBy("_k"))).where(F.col("_r") <= show)
    shown = first.groupBy("missing_in").agg(F.array_join(F.array_sort(F.collect_list("_k")).cast("array<string>"), ",").alias("examples"))
    return d.groupBy("missing_in").agg(F.count("*").alias("n_missing")).join(shown, "missing_in").select("missing_in", "n_missing", "examples")
