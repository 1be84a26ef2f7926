"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference text is made of first occurrences: each ``WINDOW``-word sequence of
the corpus stands in it once, at the least (doc_id, word) where it begins.  Its
index is cut by hash into reference blocks, each with the sequences that fall to
it and their places.  A document is factored greedily, from left to right: from
the first word whose window the blocks place in an earlier document, the factor
(document, word, length) runs on for as long as the next window's place is the
next word of the same document, so it is the longest match of the reference text
that begins there, and a verbatim copy of one stretch of one document.  Factors
of at least a window's length are duplicate spans.  At a factor's end the parse
goes back ``WINDOW`` - 1 words, so windows over the boundary of two factors are
looked up like any other and no duplicate is lost between factors.

Two exchanges keep this linear and small.  Documents are dealt into chunks, and
a chunk sends each distinct thing once, so a passage that a third of all
documents share crosses the network once per chunk.

1. Anchors: in each window the least hash of its five-word sequences.  Equal
   windows have equal anchors, and about a fifth of all places are anchors.
   Blocks answer which anchors more than one chunk has.
2. Windows whose anchor is shared go to the blocks by a 96-bit hash with the
   chunk's least place; blocks answer with the least place of all where that is
   in an earlier document.  Windows within one chunk are settled there.

Answers meet the texts again by chunk; the texts' exchange is reused.  Chunks are
dealt by the hash of id and text, so neither a repeated id nor a repeated text
alone fills one.

Defined results: a null or empty text has no words; a null doc_id counts as
later than all others; rows of one doc_id don't remove each other's words;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import shuffle_width, text_bytes

WINDOW = 13
ANCHOR = 5
CHUNK_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max
_U = np.uint64
_ASK = np.dtype([("doc", "<i8"), ("h", "<u8"), ("g", "<u4"), ("word", "<u4")])

_ROUTED = "bucket int, chunk int, payload binary"


class Chunk:
    """Texts of one chunk, with the hashes of its windows."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_numpy()
        self.ids = np.where(np.asarray(table.column("doc_id").is_null()), LAST, np.nan_to_num(ids).astype(np.int64)) if table.column("doc_id").null_count else ids.astype(np.int64)
        self.text = tv.scan(table.column("text"))
        self.words = tv.word_hash(self.text)
        self.at, self.row = tv.windows(self.text, WINDOW)

    def asked(self, which: np.ndarray) -> np.ndarray:
        """The windows chosen, with their places."""
        out = np.empty(len(which), _ASK)
        row = self.row[which]
        out["doc"], out["word"] = self.ids[row], self.at[which] - self.text.first[row]
        out["h"], out["g"] = self.hashes(which)
        return out

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        grams = tv.window_hash(self.words, np.arange(max(len(self.words) - ANCHOR + 1, 0)), ANCHOR)
        out = grams[self.at] if len(self.at) else np.zeros(0, _U)
        for j in range(1, WINDOW - ANCHOR + 1):
            out = np.minimum(out, grams[self.at + j])
        return out

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows chosen: 64 and 32."""
        at = self.at[which]
        other = tv.word_hash(self.text, 1)
        return tv.window_hash(self.words, at, WINDOW), (tv.window_hash(other, at, WINDOW, 1) >> _U(32)).astype(np.uint32)

    def shared(self, answers: np.ndarray) -> np.ndarray:
        """The windows whose anchor another chunk has, or two documents of this one."""
        anchor = self.anchors()
        if not len(anchor):
            return np.zeros(0, np.int64)
        values, which = np.unique(anchor, return_inverse=True)
        known = np.isin(values, answers, assume_unique=False)
        first = np.full(len(values), -1, np.int64)
        first[which[::-1]] = self.row[::-1]
        known[np.unique(which[self.row != first[which]])] = True
        return np.flatnonzero(known[which])


def _least(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by hash and place, and where a new window begins in it."""
    order = np.lexsort((asked["word"], asked["doc"], asked["g"], asked["h"]))
    new = np.ones(len(order), bool)
    if len(order):
        h, g = asked["h"][order], asked["g"][order]
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return order, new


def _first_places(asked: np.ndarray) -> np.ndarray:
    """For each window the entry with its least place."""
    order, new = _least(asked)
    out = np.empty(len(order), np.int64)
    if len(order):
        out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _route(chunk: int, bucket: np.ndarray, values: np.ndarray, key: np.ndarray) -> pa.Table:
    """One row for each bucket with its values, ordered by bucket and key."""
    order = np.lexsort((key, bucket))
    bucket, values = bucket[order], values[order]
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    parts = np.split(values, heads[1:]) if len(heads) else []
    return pa.table({"bucket": pa.array(bucket[heads].astype(np.int32)), "chunk": pa.array(np.full(len(heads), chunk, np.int32)), "payload": pa.array([p.tobytes() for p in parts], pa.binary())})


def _join_payloads(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a table's payloads, and the chunk of each."""
    raw = [b for b in table.column("payload").to_pylist()]
    values = np.frombuffer(b"".join(raw), dtype)
    return values, np.repeat(table.column("chunk").to_numpy().astype(np.int64), [len(b) // dtype.itemsize for b in raw])


def _answers(chunks: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.argsort(chunks, kind="stable")
    chunks, values = chunks[order], values[order]
    heads = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1]))) if len(chunks) else np.zeros(0, np.int64)
    parts = np.split(values, heads[1:]) if len(heads) else []
    return pa.table({"chunk": pa.array(chunks[heads].astype(np.int32)), "answer": pa.array([p.tobytes() for p in parts], pa.binary())})


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (tv.mix64(h ^ _U(0xA5A5A5A5)) % _U(n)).astype(np.int64)


def _key(key: tuple) -> int:
    return int(key[0].as_py())


def _steps(n_buckets: int):
    """The functions of the four exchanges."""

    def ask_anchors(key: tuple, table: pa.Table) -> pa.Table:
        anchors = np.unique(Chunk(table).anchors())
        return _route(_key(key), _bucket(anchors, n_buckets), anchors, anchors)

    def answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
        values, chunks = _join_payloads(table, np.dtype("<u8"))
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        several = np.zeros(len(values), bool)
        several[order[1:][same]] = True
        several[order[:-1][same]] = True
        return _answers(chunks[several], values[several])

    def ask_windows(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(texts)
        known = np.frombuffer(b"".join(answers.column("answer").to_pylist()), "<u8")
        asked = chunk.asked(chunk.shared(known))
        order, new = _least(asked)
        out = asked[order[new]]
        return _route(_key(key), _bucket(out["h"], n_buckets), out, out["doc"])

    def answer_windows(key: tuple, table: pa.Table) -> pa.Table:
        asked, chunks = _join_payloads(table, _ASK)
        first = _first_places(asked)
        later = asked["doc"][first] < asked["doc"]
        return _answers(chunks[later], asked[first[later]])

    return ask_anchors, answer_anchors, ask_windows, answer_windows


def duplicate_windows(chunk: Chunk, known: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that begin in an earlier document, and their entries in the reference."""
    which = chunk.shared(known)
    asked = chunk.asked(which)
    both = np.concatenate((answers, asked))
    first = both[_first_places(both)[len(answers) :]] if len(which) else asked
    found = first["doc"] < asked["doc"]
    return which[found], first[found]


def factors(chunk: Chunk, which: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors: first word, number of words, and where they begin among ``which``.

    A factor takes the next window as long as the reference goes on word by word as well.
    """
    at = chunk.at[which]
    if not len(at):
        return at, at, at
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (reference["doc"][1:] != reference["doc"][:-1]) | (reference["word"][1:].astype(np.int64) != reference["word"][:-1].astype(np.int64) + 1)
    heads = np.flatnonzero(begins)
    runs = np.diff(np.concatenate((heads, [len(at)])))
    return at[heads], runs + WINDOW - 1, heads


def _covered(chunk: Chunk, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    step = np.zeros(len(chunk.words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _parse(docs: DataFrame, finish, schema: str, chunk_bytes: int) -> DataFrame:
    """``finish(chunk, which, reference, ids)`` gives the rows of a chunk from its duplicate windows."""
    spark = docs.sparkSession
    n = shuffle_width(spark, text_bytes(docs, "text"), chunk_bytes)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk")
    texts = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ask_anchors, answer_anchors, ask_windows, answer_windows = _steps(n)
    by_chunk = texts.groupBy("chunk")
    anchors = by_chunk.applyInArrow(ask_anchors, _ROUTED).groupBy("bucket").applyInArrow(answer_anchors, "chunk int, answer binary")
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(ask_windows, _ROUTED).groupBy("bucket").applyInArrow(answer_windows, "chunk int, answer binary")
    # both kinds of answers in one table: the exchange of the texts is the third use of one
    told = anchors.select("chunk", F.lit(0).alias("kind"), "answer").unionByName(windows.select("chunk", F.lit(1).alias("kind"), "answer"))

    def parse(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        raw: dict[int, list[bytes]] = {0: [], 1: []}
        for kind, answer in zip(answers.column("kind").to_pylist(), answers.column("answer").to_pylist(), strict=True):
            raw[kind].append(answer)
        which, reference = duplicate_windows(chunk, np.frombuffer(b"".join(raw[0]), "<u8"), np.frombuffer(b"".join(raw[1]), _ASK))
        return finish(chunk, which, reference, table.column("doc_id"))

    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(parse, schema)


def spans(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, first_word, n_words, source_doc, source_word: the factors; each is a copy of the source's words from there on."""

    def finish(chunk: Chunk, which: np.ndarray, reference: np.ndarray, ids: pa.ChunkedArray) -> pa.Table:
        starts, lengths, heads = factors(chunk, which, reference)
        owner = chunk.text.owner()[starts] if len(starts) else starts
        source = reference[heads]
        return pa.table({"doc_id": ids.take(pa.array(owner)), "first_word": pa.array(starts - chunk.text.first[owner]), "n_words": pa.array(lengths), "source_doc": pa.array(source["doc"]), "source_word": pa.array(source["word"].astype(np.int64))})

    return _parse(docs, finish, "doc_id long, first_word long, n_words long, source_doc long, source_word long", chunk_bytes)


def _remaining(chunk: Chunk, which: np.ndarray, reference: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The kept words of each text, joined by a space, and how many are gone."""
    t = chunk.text
    starts, lengths, _ = factors(chunk, which, reference)
    gone = _covered(chunk, starts, lengths)
    removed = np.concatenate(([0], np.cumsum(gone, dtype=np.int64)))
    out = []
    data, place = tv.packed_words(t)
    stay = np.ones(len(data), bool)
    for a, b in zip(place[:-1][gone].tolist(), place[1:][gone].tolist(), strict=True):
        stay[a:b] = False
    left = np.concatenate(([0], np.cumsum(stay, dtype=np.int64)))[place[t.first]]
    raw = data[stay].tobytes()
    for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True):
        out.append(raw[a : max(a, b - 1)])
    return out, removed[t.first[1:]] - removed[t.first[:-1]]


def remove_duplicates(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the text of the words kept."""

    def finish(chunk: Chunk, which: np.ndarray, reference: np.ndarray, ids: pa.ChunkedArray) -> pa.Table:
        texts, removed = _remaining(chunk, which, reference)
        return pa.table({"doc_id": ids, "n_words": pa.array(chunk.text.n_words), "n_removed": pa.array(removed), "text": pa.array([x.decode() for x in texts], pa.string())})

    return _parse(docs, finish, "doc_id long, n_words long, n_removed long, text string", chunk_bytes)


def digest(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def finish(chunk: Chunk, which: np.ndarray, reference: np.ndarray, ids: pa.ChunkedArray) -> pa.Table:
        texts, removed = _remaining(chunk, which, reference)
        return pa.table({"doc_id": ids, "n_words": pa.array(chunk.text.n_words), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())})

    return _parse(docs, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", chunk_bytes)


#: The rows of ``digest`` by looking up every window, without a parse.
ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i+{WINDOW - 1}], ' ')) AS s FROM w WHERE len(w) >= {WINDOW}),
g AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM s),
first AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM g JOIN first USING (s) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
