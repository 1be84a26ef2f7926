"""Dense search in an index of cells.

Cells are the surroundings of centres that k-means finds in a bounded sample;
every vector is in the cell of its nearest centre.  A query is compared with the
vectors of the cells nearest to it.  How many that takes is measured on the
sample: the fewest with which a share of true neighbours is found.  A large cell
is dealt into shares of bounded size, and so are the queries that come to it, so
no task holds more than a share of either, however many vectors are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .retrieval import _matrix, _Nearest, _units, small, top_k

#: Vectors of the sample at most, of those whose neighbours are looked up to measure, and cells at most.
SAMPLE, PROBES, CELLS = 20_000, 400, 1024
#: Rows of a share of a cell's vectors, and of the queries that come to it.
SHARE, QUERY_SHARE = 20_000, 2_000


@dataclass(frozen=True)
class Cells:
    """Unit centres of the cells, and how many of them a query goes to."""

    centres: np.ndarray
    probes: int
    recall: float


def _means(units: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres by spherical k-means; an empty cell starts anew at the vector farthest from its centre."""
    centres = units[np.random.Generator(np.random.PCG64(seed)).choice(len(units), n, replace=False)].copy()
    for _ in range(rounds):
        near = units @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, units)
        lost = np.flatnonzero(np.bincount(cell, minlength=n) == 0)
        if len(lost):
            sums[lost] = units[np.argsort(near.max(axis=1))[: len(lost)]]
        centres = _units(sums)
    return centres


def fit(vectors: DataFrame, vector: str, k: int = 10, recall: float = 0.95, n_cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> Cells:
    """Cells for vectors of the most common length, fitted on at most ``sample`` rows in hash order.

    ``probes`` is the least number of cells with which sample vectors find at least ``recall`` of their k nearest in the
    sample.  Cells are as many as the root of all rows, within ``CELLS`` and a quarter of the sample.
    """
    v = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if size is None or not size["n"]:
        return Cells(np.zeros((1, 1)), 1, 1.0)
    v = v.where(F.size("v") == size["n"])
    total = size["count"]
    if total > sample:
        v = v.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * sample / total)))
    rows = np.array([r["v"] for r in v.orderBy(F.xxhash64("v")).limit(sample).collect()], float).reshape(-1, size["n"])
    units = _units(rows)
    n = max(1, min(n_cells or int(np.sqrt(total)), CELLS, -(-len(units) // 4)))
    centres = _means(units, n, rounds, seed)
    cell = (units @ centres.T).argmax(axis=1)
    asked = np.random.Generator(np.random.PCG64(seed + 1)).choice(len(units), min(PROBES, len(units)), replace=False)
    scores = units[asked] @ units.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(units) - 1))]
    rank = np.argsort(np.argsort(-(units[asked] @ centres.T), axis=1), axis=1)  # of each cell for each query
    needed = np.sort(rank[np.arange(len(asked))[:, None], cell[near]].ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(units) > 1 else 1
    return Cells(centres, probes, float((needed <= probes).mean()) if len(units) > 1 else 1.0)


def _in_cells(d: DataFrame, key: str, vector: str, cells: Cells, probes: int) -> DataFrame:
    """(i, v, cell): each vector of the cells' length with its nearest cells."""
    centres = cells.centres

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = _matrix(batch.column(0), batch.column(1), centres.shape[1])
            score = units @ centres.T
            best = np.argpartition(-score, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.broadcast_to(np.arange(len(centres)), score.shape)
            at = np.repeat(np.arange(len(ids)), best.shape[1])
            flat = pa.array(units[at].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * centres.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), lists, pa.array(best.ravel().astype(np.int32))], ["i", "v", "cell"])

    return d.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(near, "i long, v array<double>, cell int")


def nearest(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str, query_vector: str, k: int, cells: Cells) -> DataFrame:
    """(query_key, key, cosine, rank): the k nearest of each query among the vectors in the cells it goes to, itself left out."""
    shared_folder(vectors.sparkSession)
    v = _in_cells(vectors, key, vector, cells, 1)
    sizes = v.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / SHARE).cast("int").alias("_parts")).checkpoint()  # a row for each cell
    q = _in_cells(queries, query_key, query_vector, cells, cells.probes)
    asked = q.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / QUERY_SHARE).cast("int").alias("_blocks")).checkpoint()
    both = small(sizes.join(asked, "cell"))
    deal = lambda n: F.pmod(F.xxhash64("i"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = v.join(both, "cell").withColumn("part", deal(F.col("_parts"))).withColumn("block", every(F.col("_blocks"))).select("cell", "part", "block", "i", "v")
    right = q.join(both, "cell").withColumn("block", deal(F.col("_blocks"))).withColumn("part", every(F.col("_parts"))).select("cell", "part", "block", "i", "v")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "i": [], "cosine": []}).astype({"q": "int64", "i": "int64"})
        best = _Nearest(b["i"].to_numpy(), np.stack(b["v"].to_numpy()), k)
        best.see(a["i"].to_numpy(), np.stack(a["v"].to_numpy()))
        row, at = np.nonzero(best.best > -np.inf)
        return pd.DataFrame({"q": best.ids[row], "i": best.found[row, at], "cosine": best.best[row, at]})

    by = ["cell", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "q long, i long, cosine double")
    return top_k(found, "q", k, F.col("cosine").desc(), F.col("i")).select(F.col("q").alias(query_key), F.col("i").alias(key), "cosine", "rank")
