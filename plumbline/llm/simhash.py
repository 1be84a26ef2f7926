"""Near-duplicates by SimHash with pigeonhole blocks.

Fingerprints of 64 bits are cut into six blocks.  Two that differ in at most
three bits differ in at most three blocks, so they share the other three; a
fingerprint is filed under each of the twenty choices of three blocks, and only
those filed together are compared.

Equal fingerprints are one node from the start.  A file with more than
``file_limit`` nodes isn't compared as it is: its nodes go into finer files by
the same principle, four blocks of the bits that the file leaves open, until a
file is small or leaves so few bits open that its size is bounded.  Every pair
within reach therefore meets in some file, whatever the skew, and no file is
unbounded.

Defined results: a null or empty text has fingerprint zero, linked like any
other; a row without doc_id links like any other, but a class's id is null only
if none of its rows has one; repeated rows appear as often as they come; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textvec as tv
from .common import keep, plain_names, small_side
from .graph import components

MAX_DISTANCE = 3
SHINGLE = 3
FILE_LIMIT = 4096
SEED = 42
#: Open bits at which a file is compared whatever its size: it holds 2**12 nodes at most.
OPEN_BITS = 12

#: Shingles whose bits are counted at once.
PART = 1 << 17

_BLOCKS = (11, 11, 11, 11, 10, 10)


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """SimHash of each text of an Arrow column."""
    t = tv.scan(column, lower=True)
    data, place = tv.packed_words(t)
    n_words = t.n_words
    size = np.minimum(SHINGLE, n_words)  # a text of fewer words is one shingle
    count = np.where(n_words > 0, np.maximum(n_words - SHINGLE + 1, 1), 0)
    heads = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(heads[-1]) - np.repeat(heads[:-1] - t.first[:-1], count)
    starts = place[at]
    hashes = tv.xxh64(data, starts, place[at + np.repeat(size, count)] - 1 - starts, SEED)
    ones = np.zeros((t.n_rows, 64), np.int64)
    owner = np.repeat(np.arange(t.n_rows), count)
    for a in range(0, len(hashes), PART):
        bits = np.unpackbits(hashes[a : a + PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = owner[a : a + PART]
        begins = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        ones[rows[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tv.slices(batch.column(1)):
                fp = fingerprints_of(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
            tv.release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(open_bits: list[int], sizes: list[int]) -> list[int]:
    """Masks of consecutive blocks of the given bits."""
    out, at = [], 0
    for n in sizes:
        out.append(sum(1 << b for b in open_bits[at : at + n]))
        at += n
    return out


def first_files() -> list[int]:
    blocks = _masks(list(range(64)), list(_BLOCKS))
    return [sum(c) for c in combinations(blocks, len(blocks) - MAX_DISTANCE)]


def finer_files(mask: int) -> list[int]:
    """Four finer masks: three differing bits leave one of four blocks of the open bits alone."""
    bits = [b for b in range(64) if not mask >> b & 1]
    n, k = len(bits), MAX_DISTANCE + 1
    return [mask | m for m in _masks(bits, [n // k + (i < n % k) for i in range(k)])]


def _filed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    files = F.explode(F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("held")) for m in masks)))
    return nodes.select("fp", "node", files.alias("f")).select("f.mask", "f.held", "fp", "node")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def spanning_links(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within reach, one fewer than the members of each group."""
    left = np.arange(len(fp))
    a, b = [], []
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        x = queue.pop()
        near = _popcount(fp[left] ^ fp[x]) <= MAX_DISTANCE
        if near.any():
            found = left[near]
            a += [node[x]] * len(found)
            b += node[found].tolist()
            queue += found.tolist()
            left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, nodes = (batch.column(k) for k in (0, 1))
        fp = fps.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        node = nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(fps.value_lengths().to_numpy(zero_copy_only=False))
        sizes = np.diff(np.concatenate(([0], ends)))
        found = []
        two = ends[sizes == 2]
        near = two[_popcount(fp[two - 2] ^ fp[two - 1]) <= MAX_DISTANCE]
        found.append((node[near - 2], node[near - 1]))
        found += [spanning_links(fp[e - n : e], node[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True) if n > 2]
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame, file_limit: int = FILE_LIMIT) -> DataFrame:
    """Links (a, b) that join all nodes (fp distinct, node) within reach of each other."""
    out = None
    filed = _filed(nodes, first_files())
    bound = [m for m in first_files()]
    while True:
        sizes = keep(filed.groupBy("mask", "held").agg(F.count("*").alias("size")).where("size > 1"))
        last = 64 - min(int(m).bit_count() for m in bound) <= OPEN_BITS
        small = F.lit(True) if last else F.col("size") <= file_limit
        members = filed.join(sizes.where(small).select("mask", "held"), ["mask", "held"])
        lists = members.groupBy("mask", "held").agg(F.collect_list(F.struct("fp", "node")).alias("m"))
        found = lists.select(F.col("m.fp").alias("fp"), F.col("m.node").alias("node")).mapInArrow(_compare, "a long, b long")
        out = found if out is None else out.unionByName(found)
        large = sizes.where(~small)
        if last or large.isEmpty():
            return out.distinct()
        # the choices of masks are few; each large file's rows go on to its own four
        rows = filed.join(large.select("mask", "held"), ["mask", "held"])
        finer = {m: finer_files(m) for m in bound}
        at = F.create_map(*(x for m, fs in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(f)) for f in fs)))))
        filed = keep(rows.select("fp", "node", F.explode(F.element_at(at, F.col("mask"))).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("held"), "fp", "node").distinct())
        bound = sorted({f for fs in finer.values() for f in fs})


def _classes(docs: DataFrame, file_limit: int) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row; root is a fingerprint of the class."""
    marked = keep(fingerprints(docs))
    nodes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = keep(components(links(nodes.select("fp", F.col("fp").alias("node")), file_limit)))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = members.join(nodes.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("of_class"))
    linked = members.join(small_side(least), "root").withColumnRenamed("node", "fp")
    named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_class")).alias("component_id"))
    # kept, so that the rows of one fingerprint can be split over tasks
    return marked.join(keep(named), "fp", "left").select("doc_id", "fp", "root", "component_id")


def classes(docs: DataFrame, file_limit: int = FILE_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row; the class id is its least doc_id."""
    return _classes(docs, file_limit).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, file_limit: int = FILE_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint in hex, component_id."""
    return classes(docs, file_limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@plain_names
def drop_near_duplicates(docs: DataFrame, file_limit: int = FILE_LIMIT) -> DataFrame:
    """One row of each class, with its least doc_id (null only if the class has none).

    Ids alone tell what goes, but for rows that share an id, or have none: of these the row that stays is looked for
    among rows with the class's least id and then least fingerprint, and is the first of them by a hash of all columns.
    """
    marked = keep(_classes(docs, file_limit))
    ids = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("goes"))
    leaving = small_side(ids.where("goes OR n > 1").select("doc_id", (F.col("n") > 1).alias("shared")))
    alone = docs.where("doc_id IS NOT NULL").join(leaving.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    shared = small_side(marked.where("doc_id IS NOT NULL").join(leaving.where("shared"), "doc_id", "left_semi").select("doc_id").distinct())
    odd = marked.where("doc_id IS NULL").select("fp").limit(1).union(shared.select("doc_id").limit(1))
    if odd.isEmpty():
        return alone
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("w")
    winners = marked.groupBy("root").agg(winner).select("w.none", F.coalesce("w.doc_id", F.lit(0)).alias("id"), F.col("w.fp").alias("fp"))
    rows = docs.where("doc_id IS NULL").unionByName(docs.join(shared, "doc_id", "left_semi").select(*docs.columns))
    cells = [F.col(f"row.`{c}`") for c in docs.columns]
    packed = _with_fingerprints(rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    met = packed.join(small_side(winners), (F.col("row.doc_id").isNull() == F.col("none")) & (F.coalesce("row.doc_id", F.lit(0)) == F.col("id")) & (F.col("fp") == F.col("_fp")))
    one = met.groupBy("none", "id", "fp").agg(F.min_by("row", F.xxhash64(*cells)).alias("row"))
    return alone.unionByName(one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def _with_fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` has the column row, a struct with a text; adds _fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field("text")
            for a, b in tv.slices(texts):
                fp = fingerprints_of(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], ["row", "_fp"])
            tv.release()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_fp", LongType())]))
