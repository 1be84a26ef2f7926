"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts and benchmark items are word sequences in lower case.  A text leaks an
item if some stretch of it is within edit distance ``max_edits`` (a share of the
item's words, rounded down) of the item.

1. A window of an item's size is looked at only if it has enough word q-grams of
   that item: a stretch within t edits of an item of n words shares
   n - q + 1 - q t of its q-grams, so this loses nothing.  q is 3, and less in
   items so short that this count would not be positive.
2. Each window left is embedded by the CGK random walk, which copies or skips
   words by random bits of the words themselves, so that sequences at small
   edit distance get embeddings at small Hamming distance.  Bit-sampling LSH
   compares ``SAMPLED`` places of the embedding.  How often two sequences of n
   words at the largest distance agree in them is measured (``collision_rate``),
   and independent walks are repeated as often as the target recall asks for at
   that rate, at most ``MAX_WALKS`` times.
3. Candidates are verified by the exact edit distance of the item to any
   stretch of the text around the window.
4. What no walk has brought is verified in the same way, over the joined
   surroundings of an item's windows in a text, so no leak is lost to the walks
   or their bound.

The benchmark goes to the executors in blocks of at most ``block_bytes``, each
against all documents in one narrow pass; documents are never shuffled.  Grams
that many items share are met for as many items at a time as ``HITS`` allows.

Defined results: null and empty texts and items leak nothing; an item of fewer
words than one edit takes must be there word by word; items under ``min_words``
words are left out (a parameter; 1, so none is); repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import plain_names

MAX_EDITS = 0.2
MIN_WORDS = 1
SAMPLED = 3
TARGET_RECALL = 0.98
MAX_WALKS = 32
GRAM = 3
STRETCH = 2  # embedding length by item length: a walk takes two steps a word on average
BLOCK_BYTES = 32 << 20
#: Pairs of a place and an item, and windows, that are held at once.
HITS, SPOTS = 1 << 22, 200_000
_U = np.uint64


def embed(words: np.ndarray, walk: int, places: np.ndarray) -> np.ndarray:
    """For sequences in the rows of ``words``: a hash of the sampled places of their CGK embeddings."""
    n_rows, n = words.shape
    padded = np.concatenate((words, np.zeros((n_rows, 1), _U)), axis=1)
    at = np.zeros(n_rows, np.int64)
    rows = np.arange(n_rows)
    out = np.zeros(n_rows, _U)
    chosen = set(places.tolist())
    for j in range(int(places.max()) + 1):
        symbol = padded[rows, at]
        if j in chosen:
            out = tv.mix64(out + symbol)
        step = tv.mix64(symbol ^ _U((walk * 1_000_003 + j) * 0x9E3779B97F4A7C15 % 2**64)) & _U(1)
        at = np.minimum(at + step.astype(np.int64), n)
    return out


def places_of(n: int, walk: int) -> np.ndarray:
    """The places of the embedding that a walk samples for sequences of n words."""
    rng = np.random.Generator(np.random.PCG64([n, walk]))
    return np.sort(rng.choice(STRETCH * n, min(SAMPLED, n), replace=False))


def collision_rate(n: int, edits: int, pairs: int = 256, walks: int = 8) -> float:
    """Measured share of walks in which a sequence of n words and one ``edits`` random edits away have equal samples."""
    rng = np.random.Generator(np.random.PCG64([n, edits, 1]))
    one = rng.integers(1, 2**63, size=(pairs, n), dtype=_U)
    two = np.zeros_like(one)
    for k in range(pairs):
        row = one[k].tolist()
        for at, kind in zip(rng.integers(0, n, edits).tolist(), rng.integers(0, 3, edits).tolist(), strict=True):
            new = [int(rng.integers(1, 2**63))]
            row[at : at + 1] = [[], new, [*row[at : at + 1], *new]][kind]
        two[k, : min(len(row), n)] = row[:n]
    return float(np.mean([embed(one, w, places_of(n, w)) == embed(two, w, places_of(n, w)) for w in range(walks)]))


def repetitions(n: int, edits: int, target: float = TARGET_RECALL) -> int:
    """Walks after which all but 1 - target of the pairs at the largest distance have met, up to MAX_WALKS."""
    rate = collision_rate(n, edits)
    if rate <= 0 or rate >= 1:
        return 1 if rate >= 1 else MAX_WALKS
    return min(MAX_WALKS, max(1, math.ceil(math.log(1 - target) / math.log(1 - rate))))


def edit_distance_within(item: list[int], stretch: list[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``stretch``, and where that part ends; bit-parallel."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for k, w in enumerate(stretch, 1):
        eq = peq.get(w, 0)
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = (down | ~(diag | up)) & full, up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(diag | plus)) & full, plus & diag
        if score < best:
            best, end = score, k
    return best, end


def joined_spots(spots: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """First word and words of the stretches that overlapping (first word, words) of one text make together."""
    low, parts, high = 0, [], -1
    for first, part in sorted(spots, key=lambda x: x[0]):
        if first > high:
            if parts:
                yield low, np.concatenate(parts)
            low, parts, high = first, [part], first + len(part)
        elif first + len(part) > high:
            parts.append(part[high - first :])
            high = first + len(part)
    if parts:
        yield low, np.concatenate(parts)


class Grams:
    """Which items have a gram of q words: those of gram g are owners[heads[g]:heads[g + 1]], ascending."""

    def __init__(self, q: int, items: np.ndarray, words: list[np.ndarray]):
        self.q, self.items = q, items
        each = [np.unique(tv.window_hash(words[k], np.arange(len(words[k]) - q + 1), q)) for k in items.tolist()]
        flat = np.concatenate(each)
        owner = np.repeat(items, [len(g) for g in each])
        order = np.argsort(flat, kind="stable")
        self.owners = owner[order]
        self.grams, heads = np.unique(flat[order], return_index=True)
        self.heads = np.append(heads, len(flat))
        self.wide = int(items.max()) + 1
        self.keyed = np.repeat(np.arange(len(self.grams)), np.diff(self.heads)) * self.wide + self.owners
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams >> _U(44)).astype(np.int64)] = True

    def hits(self, t: tv.Texts, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, item) pairs, all of an item at once, about ``HITS`` pairs at a time."""
        at, _ = tv.windows(t, self.q)
        gram = tv.window_hash(h, at, self.q)
        maybe = np.flatnonzero(self.bits[(gram >> _U(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, gram[maybe]), len(self.grams) - 1)
        held = self.grams[place] == gram[maybe]
        at, place = at[maybe][held], place[held]
        if not len(at):
            return
        total = int((self.heads[place + 1] - self.heads[place]).sum())
        cuts = [0, self.wide]
        if total > HITS:
            some, times = np.unique(place, return_counts=True)
            count = self.heads[some + 1] - self.heads[some]
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            by_item = np.bincount(self.owners[np.repeat(self.heads[some], count) + step], np.repeat(times, count), self.wide)
            part = np.cumsum(by_item).astype(np.int64) // HITS
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), self.wide]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            first, last = np.searchsorted(self.keyed, place * self.wide + low), np.searchsorted(self.keyed, place * self.wide + high)
            count = last - first
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            yield np.repeat(at, count), self.owners[np.repeat(first, count) + step]


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], max_edits: float, target_recall: float, min_words: int = MIN_WORDS):
        t = tv.scan(pc.utf8_lower(pa.array(texts, pa.string())))
        h = tv.word_hash(t)
        size = t.n_words
        long_enough = np.flatnonzero(size >= max(min_words, 1))
        self.ids = [ids[k] for k in long_enough]
        self.words = [h[t.first[k] : t.first[k + 1]] for k in long_enough]
        self.size = size[long_enough].astype(np.int64)
        self.edits = np.minimum((max_edits * self.size + 1e-9).astype(np.int64), self.size - 1)
        shared = lambda q: self.size - q + 1 - q * self.edits
        self.q = np.select([shared(q) > 0 for q in range(GRAM, 0, -1)], list(range(GRAM, 0, -1)), 1)
        self.need = np.maximum(self.size - self.q + 1 - self.q * self.edits, 1)
        self.grams = [Grams(q, np.flatnonzero(self.q == q), self.words) for q in np.unique(self.q).tolist()]
        self.target = target_recall
        self.walks: dict[int, int] = {}
        self.tables: dict[tuple[int, int], tuple[np.ndarray, dict[int, list[int]]]] = {}

    def table(self, n: int, walk: int) -> tuple[np.ndarray, dict[int, list[int]]]:
        """The places sampled in a walk, and by signature the items of n words; made when first asked for."""
        if (n, walk) not in self.tables:
            places = places_of(n, walk)
            of = np.flatnonzero(self.size == n).tolist()
            signed: dict[int, list[int]] = {}
            for k, s in zip(of, embed(np.stack([self.words[k] for k in of]), walk, places).tolist(), strict=True):
                signed.setdefault(s, []).append(k)
            self.tables[n, walk] = places, signed
        return self.tables[n, walk]

    def windows(self, t: tv.Texts, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words of the windows with enough grams of one item, and the item; all of an item at once."""
        wide = len(h) + int(self.size.max()) * 2 + 1
        for grams in self.grams:
            for at, item in grams.hits(t, h):
                key = np.sort(item.astype(np.int64) * wide + at)
                item, at = key // wide, key % wide
                last = np.arange(len(key)) + self.need[item] - 1
                inside = last < len(key)
                enough = np.zeros(len(key), bool)
                enough[inside] = key[last[inside]] - key[inside] <= (self.size + self.edits - grams.q)[item[inside]]
                item, at = item[enough], at[enough]
                if not len(at):
                    continue
                # the stretch begins up to q * edits words before its first gram that is left
                back = grams.q * self.edits[item] + 1
                owner = np.searchsorted(t.first, at, "right") - 1
                low = np.maximum(at - back + 1, t.first[owner])
                # ranges of one item and text that overlap are one
                begins = np.ones(len(at), bool)
                begins[1:] = (item[1:] != item[:-1]) | (low[1:] > at[:-1] + 1) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(begins)
                low, high, item = low[heads], np.append(at[heads[1:] - 1], at[-1:]), item[heads]
                count = high - low + 1
                step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                yield np.repeat(low, count) + step, np.repeat(item, count)

    def search(self, column: pa.Array) -> list[tuple[int, object, int, int, int]]:
        """(row, item, first word, edit distance, item's words) of each leak, once for each row and item."""
        if not self.ids:
            return []
        found: dict[tuple[int, int], tuple[int, int]] = {}
        # windows are gathered over parts, so that each walk is taken once for many of them
        spots: dict[int, list[tuple[int, int, int, np.ndarray, int]]] = {}  # by size: item, row, first word, words around, place in them
        held = 0
        for a, b in tv.slices(column):
            t = tv.scan(pc.utf8_lower(column.slice(a, b - a)))
            h = tv.word_hash(t)
            for starts, items in self.windows(t, h):
                rows = np.searchsorted(t.first, starts, "right") - 1
                for s, item, r in zip(starts.tolist(), items.tolist(), rows.tolist(), strict=True):
                    n = int(self.size[item])
                    low, high = max(s - n // 2, int(t.first[r])), min(s + 2 * n, int(t.first[r + 1]))
                    spots.setdefault(n, []).append((item, a + r, s - int(t.first[r]), h[low:high], s - low))
                held += len(starts)
                if held > SPOTS:
                    self._verify(spots, found)
                    spots, held = {}, 0
        self._verify(spots, found)
        return sorted((r, self.ids[item], start, d, int(self.size[item])) for (r, item), (d, start) in found.items())

    def _verify(self, by_size: dict[int, list[tuple[int, int, int, np.ndarray, int]]], found: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds to ``found`` the leaks among the windows: (row, item) with edit distance and first word."""
        for n, spots in by_size.items():
            tried: set[tuple[int, int]] = set()
            if n not in self.walks:
                self.walks[n] = repetitions(n, int(self.edits[self.size == n][0]), self.target)
            for walk in range(self.walks[n]):
                open_ = [k for k, x in enumerate(spots) if (x[1], x[0]) not in found]
                if not open_:
                    break
                places, table = self.table(n, walk)
                seq = np.zeros((len(open_), n), _U)
                for k, spot in enumerate(open_):
                    _, _, _, around, place = spots[spot]
                    part = around[place : place + n]
                    seq[k, : len(part)] = part
                for spot, s in zip(open_, embed(seq, walk, places).tolist(), strict=True):
                    for item in table.get(s, ()):
                        _, row, first, around, place = spots[spot]
                        if (row, item) in found or (spot, item) in tried:
                            continue
                        tried.add((spot, item))
                        d, end = edit_distance_within(self.words[item].tolist(), around.tolist())
                        if d <= self.edits[item]:
                            found[row, item] = (d, max(first - place + end - n, 0))
            # all places of a pair are verified, met by a walk or not: a walk may have met a worse copy than another place has
            places_of: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
            for item, row, first, around, place in spots:
                places_of.setdefault((row, item), []).append((first - place, around))
            for (row, item), parts in places_of.items():
                words = self.words[item].tolist()
                d, end = min((d, low + end) for low, part in joined_spots(parts) for d, end in [edit_distance_within(words, part.tolist())])
                if d <= self.edits[item]:
                    found[row, item] = min((d, max(end - n, 0)), found.get((row, item), (d + 1, 0)))


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in parts of about ``block_bytes``; one part if they fit."""
    total = benchmark.select(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) * 5 // (block_bytes * 4)))  # parts by a hash differ a little in size
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [benchmark]


def _searcher(block: DataFrame, max_edits: float, target_recall: float) -> Callable[[pa.RecordBatch, str], Iterator[tuple[pa.RecordBatch, list]]]:
    rows = [(r["item_id"], r["text"]) for r in block.select("item_id", "text").where("text IS NOT NULL").collect()]
    held: list[Items] = []

    def search(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
        if not held:
            held.append(Items([r[0] for r in rows], [r[1] for r in rows], max_edits, target_recall))
        k = batch.schema.get_field_index(text)
        for a, b in tv.slices(batch.column(k), 64 << 20):
            part = batch.slice(a, b - a)
            yield part, held[0].search(part.column(k))

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, target_recall: float = TARGET_RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, edit_distance, item_words: one row for each document and item that it leaks."""
    schema = "doc_id long, item_id long, first_word long, edit_distance long, item_words long"
    out = None
    for block in item_blocks(benchmark, block_bytes):
        search = _searcher(block, max_edits, target_recall)

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, found in search(batch, "text"):
                    if found:
                        rows = [part.column(0).take(pa.array([f[0] for f in found])), *(pa.array([f[k] for f in found], pa.int64()) for k in range(1, 5))]
                        yield pa.RecordBatch.from_arrays(rows, ["doc_id", "item_id", "first_word", "edit_distance", "item_words"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


@plain_names
def drop_leaking(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, target_recall: float = TARGET_RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    for block in item_blocks(benchmark, block_bytes):
        search = _searcher(block, max_edits, target_recall)

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, found in search(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in found]] = False
                    yield part.filter(pa.array(clean))
                tv.release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
