"""Connected components by alternating star steps.

Each step is two aggregations and joins over links; nothing is gathered by
node.  A node's links are dealt by node and one of ``SALTS`` shares of its
neighbours: the least of each share is found first, then the least of those few,
which goes back to all shares.  So a node with very many links neither fills a
task nor is any task's alone.  The result of each step is written to the shared
checkpoint folder.  The number of steps grows with the logarithm of the longest
chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

SALTS = 64


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
    return row["n"], row["h"]


def _salted(links: DataFrame) -> DataFrame:
    return links.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))


def _with_least(links: DataFrame) -> DataFrame:
    """``links`` (a, b, salt) with m, the least of b over all links of a; by (a, salt), then by a over the shares' least."""
    shares = links.groupBy("a", "salt").agg(F.min("b").alias("least"))
    least = shares.groupBy("a").agg(F.min("least").alias("m"), F.collect_set("salt").alias("salts"))
    return links.join(least.select("a", "m", F.explode("salts").alias("salt")), ["a", "salt"])


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _with_least(_salted(both)).where("b > a")
    return met.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them.  Links have a > b."""
    met = _with_least(_salted(links))
    moved = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(met.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b longs) that aren't the least of their component."""
    links = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _digest(links)
    while state[0]:
        links = keep(_small_star(_large_star(links)))
        before, state = state, _digest(links)
        if before == state:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
