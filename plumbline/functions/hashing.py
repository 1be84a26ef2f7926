"""Signed feature hashing into dense vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

WIDTH = 256
#: Rows that a worker turns into vectors at once.
SLICE = 256


def vector(tokens: Sequence[str], width: int = WIDTH) -> np.ndarray:
    """Unit vector of signed token counts.

    Each token's 64-bit BLAKE2b, little-endian, gives its place (modulo the
    width) and its sign (the lowest bit), so sign and parity of the place agree.
    """
    out = np.zeros(width)
    for token in tokens:
        v = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
        out[v % width] += 1.0 if v & 1 else -1.0
    size = float(np.linalg.norm(out))
    return out / size if size else out


def _sums(tokens: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a slice of token lists, a row each, as ``vector`` makes them; each distinct token is hashed once."""
    flat = tokens.flatten()
    rows = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)[pc.is_valid(flat).to_numpy(zero_copy_only=False)]
    named = flat.drop_null().dictionary_encode()
    v = np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in named.dictionary.to_pylist()], np.uint64)
    v = v[named.indices.to_numpy(zero_copy_only=False)]
    at = rows.astype(np.int64) * width + (v % np.uint64(width)).astype(np.int64)
    out = np.bincount(at, weights=np.where(v & np.uint64(1), 1.0, -1.0), minlength=len(tokens) * width).astype(float).reshape(len(tokens), width)
    for row in out:
        row /= float(np.linalg.norm(row)) or 1.0
    return out


def feature_batches(batches: Iterator[pa.RecordBatch], key: str, width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    """(key, vector) of (key, tokens), by slices of ``SLICE`` rows, so that what a worker holds besides the batch it was sent doesn't grow."""
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            part = batch.slice(k, SLICE)
            vectors = _sums(part.column(1), width)
            lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, width, dtype=np.int32), vectors.ravel())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], [key, "vector"])


def hashed_features(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, vector) of each row; without tokens, or with null, all numbers are zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from feature_batches(batches, key)

    return rows.select(key, tokens).mapInArrow(run, f"{key} long, vector array<double>")
