"""Uniform shuffle into shards of exact size by a communication matrix.

Rows fall into blocks by a hash.  From the block sizes alone the driver draws
how many rows of each block go to each shard: the counts of a uniform random
deal, a multivariate hypergeometric draw per block from what the shards still
take.  Each block then deals its rows out in a seeded random order, and each
shard puts what it gets into a second random order.  Shard sizes are at most
one apart.

Blocks grow in number with the input, as do the bins by which a shard's order
is counted out, so no task holds a shard; the driver holds one count for each
block and shard, and the cuts go back as a kept table.  Draws are exact at any
size: beyond the bound of numpy's sampler by inversion of the distribution
itself.  Rows are ordered by hashes, so a lost task is dealt again alike.

Defined results: a null text has size 1 and checksum 0; a null doc_id and
repeated rows are dealt like any other; of input columns only those named in
``carry`` are returned.  Rows equal in id, text and carried columns are told
apart by nothing, so any of them may have any of their places.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, plain_names, shuffle_width, small_side

N_SHARDS = 16
#: Rows that a block takes, without texts and with them.
ROWS_PER_BLOCK, FULL_ROWS_PER_BLOCK = 1 << 16, 1 << 13


def communication_matrix(blocks: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows of block i that go to shard j, for a uniform deal into shards at most one apart."""
    total = sum(blocks)
    room = np.array([total // n_shards + (j < total % n_shards) for j in range(n_shards)], np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))
    room = rng.permutation(room)
    out = np.zeros((len(blocks), n_shards), np.int64)
    for i, n in enumerate(blocks):
        # one shard after the other, each a univariate draw from the rows that are left
        left, others = n, int(room.sum())
        for j in range(n_shards):
            others -= int(room[j])
            out[i, j] = left if not others else _draw(rng, int(room[j]), others, left)
            left -= out[i, j]
        room -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good: a hypergeometric draw, at any size."""
    if not n or not good:
        return 0
    if good + bad < 10**9:  # the bound of numpy's sampler
        return int(rng.hypergeometric(good, bad, n))
    return _inverted(rng, good, bad, n)


def _inverted(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The draw by inversion, from the ratios of successive probabilities around the mode.

    What lies beyond 12 standard deviations has a probability under 1e-30 and is left out.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))) + 64
    low, high = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    # log p(k + 1) - log p(k)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log((bad - n) + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    shares = np.cumsum(np.exp(log_p - log_p.max()))
    return low + int(np.searchsorted(shares, rng.random() * shares[-1], "right"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 42, carry: tuple[str, ...] = (), rows_per_block: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and the columns in ``carry`` with prefix ``in_``.

    Without ``carry`` the narrow rows are kept; with it texts are read twice, for the counts and for the exchange.
    """
    spark = docs.sparkSession
    carried = [f"in_{c}" for c in carry]
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        *(F.col(c).alias(f"in_{c}") for c in carry),
    )
    total = docs.count()
    n_blocks = shuffle_width(spark, total, rows_per_block or (FULL_ROWS_PER_BLOCK if carry else ROWS_PER_BLOCK))
    key = ("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_deal", F.xxhash64(F.lit(seed), *key)).withColumn("_block", F.pmod(F.xxhash64(F.lit(~seed), *key), F.lit(n_blocks)).cast("int"))
    if not carry:
        rows = keep(rows)
    counts = dict(rows.groupBy("_block").count().collect())
    matrix = communication_matrix([counts.get(i, 0) for i in range(n_blocks)], n_shards, seed)
    cuts = small_side(spark.createDataFrame([(i, c) for i, c in enumerate(np.cumsum(matrix, axis=1).tolist())], "_block int, _cuts array<long>"))
    placed = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_block").orderBy("_deal", *key, *carried)))
    placed = placed.join(cuts, "_block").withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_rank"))).cast("int"))
    placed = placed.withColumn("_order", F.xxhash64(F.lit(seed + 1), *key)).withColumn("_bin", F.pmod("_order", F.lit(n_blocks)).cast("int")).drop("_cuts", "_rank", "_block", "_deal")
    # the slot: rows of the shard in earlier bins, and the place in the own bin
    bins = _bin_starts(placed)
    slot = F.row_number().over(W.partitionBy("shard", "_bin").orderBy("_order", *key, *carried)) - 1
    return placed.withColumn("_place", slot).join(bins, ["shard", "_bin"]).withColumn("slot", F.col("_place") + F.col("_before")).drop("_bin", "_order", "_place", "_before")


def _bin_starts(placed: DataFrame) -> DataFrame:
    sizes = placed.groupBy("shard", "_bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    return sizes.select("shard", "_bin", F.coalesce(before, F.lit(0)).alias("_before"))


#: Columns of the digest.
TAKEN = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _contract(rows: DataFrame) -> list[Column]:
    return [rows["doc_id"], rows["size"], rows["text_crc32"], F.lit("rows").alias("law"), rows["shard"], rows["slot"].cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]


def shard_digest(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 42) -> DataFrame:
    rows = shard(docs, n_shards, seed)
    return rows.select(*_contract(rows))


@plain_names
def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 42) -> DataFrame:
    """The digest with the rows themselves: each has its shard, slot and all its columns; those with a name of the digest's get ``in_`` before it."""
    columns, names = [c for c in docs.columns if c != "doc_id"], {}
    for c in columns:
        names[c] = c
        while names[c].lower() in TAKEN or names[c] != c and names[c] in columns:
            names[c] = f"in_{names[c]}"
    rows = shard(docs, n_shards, seed, tuple(columns))
    return rows.select(*_contract(rows), *(rows[f"in_{c}"].alias(names[c]) for c in columns))
