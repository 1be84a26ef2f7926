"""Lexical, dense and hybrid top-k retrieval, containment and similarity joins.

Queries and rules are the small side.  Token search joins on tokens, and bounds
keep most pairs from being scored; containment runs an automaton over each text.
Exact dense search compares each query with each vector, by matrix products over
blocks of queries of a checked size; ``cells`` has the search in an index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

K1, B = 1.5, 0.75


#: Rows of a side up to which it is broadcast, once counted.
BROADCAST_ROWS = 200_000
#: Pairs of a query and a document, at most, that a part of many queries makes on average.
PAIRS_PER_PART = 500_000


def small(d: DataFrame) -> DataFrame:
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d


def small_or_merged(d: DataFrame) -> DataFrame:
    """As ``small``, but a side that isn't few rows isn't broadcast by Spark's estimate either, which knows the bytes of compressed files and not the rows."""
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d.hint("merge")


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token, tf, length): one row per document and token."""
    d = docs.select(F.col(key), tokens.alias("_t")).select(key, F.size("_t").alias("length"), F.explode("_t").alias("token"))
    return d.groupBy(key, "token", "length").agg(F.count("*").alias("tf"))


def idf(posting: DataFrame, n_docs: Column) -> DataFrame:
    """Document frequencies and their logs, ln(1 + (N - df + 0.5) / (df + 0.5))."""
    df = posting.groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.ln(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, doc_tokens: Column, query_tokens: Column, distinct_query: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """(query, key, score) for every pair with a token in common.

    A query's repeated token counts as often as it comes, or once with
    ``distinct_query``.  Postings are cut down to the queries' tokens before any
    shuffle of them.  If the documents' postings are few and the queries' aren't,
    the postings are broadcast to the queries, which are dealt once.
    """
    p = postings(docs, key, doc_tokens)
    n_queries = queries.count()
    dealt = n_queries > BROADCAST_ROWS and p.count() <= BROADCAST_ROWS
    if dealt:  # so finely that a part's pairs are summed in memory
        width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        queries = queries.repartition(max(width, -(-n_queries * docs.count() // PAIRS_PER_PART)), query_key)
    q = queries.select(F.col(query_key), F.explode(F.array_distinct(query_tokens) if distinct_query else query_tokens).alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("qtf"))
    stats = docs.agg(F.count("*").alias("_N"), F.avg(F.size(doc_tokens)).alias("_avg"))
    if not dealt:
        p = p.join(q.select("token").distinct(), "token", "left_semi")
    df = p.groupBy("token").agg(F.count("*").alias("_df"))
    w = df.crossJoin(F.broadcast(stats))  # one row
    w = w.select("token", "_avg", F.ln(1 + (F.col("_N") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)).alias("_idf"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.greatest(F.col("_avg"), F.lit(1e-9)))
    part = F.col("_qw") * F.col("tf") * (k1 + 1) / norm
    weights = q.join(F.broadcast(w) if dealt else w, "token").select("token", query_key, "_avg", (F.col("qtf") * F.col("_idf")).alias("_qw"))
    if dealt:
        return weights.join(F.broadcast(p), "token").groupBy(key, query_key).agg(F.sum(part).alias("score"))
    # postings by document: the queries come to them, and all parts of a score are in one place
    return p.repartition(key).join(small(weights), "token").groupBy(key, query_key).agg(F.sum(part).alias("score"))


#: Part of a query's score bound that is left for the second round of top-k search.
REST = 0.05
#: Blocks of documents by length, to one doubling; a token's best weight is known for each block.
LENGTH_BLOCKS = 4


@dataclass(frozen=True)
class Bm25Rounds:
    """What top-k search goes by: survivors of the first round (query, key, s), and what is left to add to them."""

    survivors: DataFrame
    postings: DataFrame
    rest: DataFrame


def bm25_rounds(docs: DataFrame, queries: DataFrame, key: str, query_key: str, doc_tokens: Column, query_tokens: Column, k: int, k1: float = K1, b: float = B) -> Bm25Rounds:
    """The pairs that may be among the k best of a query, each with its score so far.

    A token adds to a score at most its weight in the query times its best weight in the document's block of lengths.
    The first round scores by each query's tokens with the largest bounds, all but ``REST`` of their sum.  Its k-th best
    score is a threshold that the whole scores of the k best can't be below; a pair that doesn't reach it with the bounds
    of its other tokens is out, and so is a document without any token of the first round, unless the other tokens alone
    might reach the threshold in its block.
    """
    shared_folder(docs.sparkSession)
    q = queries.select(F.col(query_key).alias("_q"), F.explode(query_tokens).alias("token")).groupBy("_q", "token").agg(F.count("*").alias("_qtf"))
    wanted = small(q.select("token").distinct().checkpoint())
    cut = docs.select(key, doc_tokens.alias("_tokens")).checkpoint()  # else texts are cut again for each count of their tokens
    stats = cut.agg(F.count("*").alias("_total"), F.avg(F.size("_tokens")).alias("_avg"))
    p = postings(cut, key, F.col("_tokens")).join(wanted, "token", "left_semi").crossJoin(F.broadcast(stats))  # one row
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.greatest(F.col("_avg"), F.lit(1e-9)))
    p = p.select(key, "token", F.floor(F.log2("length") * LENGTH_BLOCKS).cast("int").alias("_b"), (F.col("tf") * (k1 + 1) / norm).alias("_w"), "_total").checkpoint()
    best = p.groupBy("token", "_b").agg(F.max("_w").alias("_u"), F.count("*").alias("_n"), F.max("_total").alias("_total")).checkpoint()
    df = best.groupBy("token").agg(F.sum("_n").alias("_df"), F.max("_u").alias("_most"), F.max("_total").alias("_total"))
    idf = F.ln(1 + (F.col("_total") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = q.join(df, "token").select("_q", "token", (F.col("_qtf") * idf).alias("_qw"), "_most")
    bound, whole = F.col("_qw") * F.col("_most"), W.partitionBy("_q")
    rising = whole.orderBy(bound, "token").rowsBetween(W.unboundedPreceding, 0)
    weights = weights.withColumn("_lead", F.sum(bound).over(rising) > REST * F.sum(bound).over(whole)).checkpoint()
    lead, rest = (weights.where(c).select("token", "_q", "_qw") for c in ("_lead", "NOT _lead"))
    scored = p.repartition(key).join(small(lead), "token").groupBy("_q", key).agg(F.sum(F.col("_qw") * F.col("_w")).alias("_s"), F.first("_b").alias("_b")).checkpoint()
    kth = top_k(scored, "_q", k, F.col("_s").desc()).groupBy("_q").agg(F.when(F.max("rank") == k, F.min("_s")).otherwise(0.0).alias("_least"))
    slack = F.col("_least") * (1 - 1e-9) - 1e-9  # sums of another order
    left = rest.join(best, "token").groupBy("_q", "_b").agg(F.sum(F.col("_qw") * F.col("_u")).alias("_rest")).join(kth, "_q", "left").checkpoint()
    alive = scored.join(small(kth.checkpoint()), "_q").join(small(left.select("_q", "_b", "_rest")), ["_q", "_b"], "left").where(F.col("_s") + F.coalesce("_rest", F.lit(0.0)) >= slack)
    # blocks in which the other tokens alone may do: their documents are taken whole
    open_blocks = left.where(F.coalesce(F.col("_rest") >= slack, F.lit(True))).select("_q", "_b")
    fresh = p.join(rest.join(open_blocks, "_q"), ["token", "_b"]).select("_q", key).distinct().join(scored.select("_q", key), ["_q", key], "left_anti")
    survivors = alive.select("_q", key, "_s").unionByName(fresh.withColumn("_s", F.lit(0.0)))
    return Bm25Rounds(survivors.checkpoint(), p, rest)


def bm25_top_k(docs: DataFrame, queries: DataFrame, key: str, query_key: str, doc_tokens: Column, query_tokens: Column, k: int) -> DataFrame:
    """(query, key, score, rank): the k best documents of each query by score to eight digits, then least key; see ``bm25_rounds``.

    The common tokens, whose bounds are small, are looked up for the few pairs that are left only.
    """
    r = bm25_rounds(docs, queries, key, query_key, doc_tokens, query_tokens, k)
    more = r.survivors.join(r.rest, "_q").join(r.postings.select(key, "token", "_w"), [key, "token"]).groupBy("_q", key).agg(F.sum(F.col("_qw") * F.col("_w")).alias("_more"))
    d = r.survivors.join(more, ["_q", key], "left").select(F.col("_q").alias(query_key), key, (F.col("_s") + F.coalesce("_more", F.lit(0.0))).alias("score"))
    return top_k(d, query_key, k, F.round("score", 8).desc(), F.col(key))


def top_k(scored: DataFrame, query_key: str, k: int, *order: Column) -> DataFrame:
    by = W.partitionBy(query_key).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.greatest(norm(a) * norm(b), F.lit(1e-12))


#: Queries of dense search that go to the executors at once, by hash blocks that differ a little in size, and numbers in them.
MAX_QUERY_ROWS, MAX_QUERY_NUMBERS = 20_000, 8_000_000
#: Scores that are held at once.
SCORES = 4_000_000


def query_blocks(queries: DataFrame, query_key: str, width: int = 1) -> list[DataFrame]:
    """The queries in parts of about ``MAX_QUERY_ROWS`` rows and ``MAX_QUERY_NUMBERS`` numbers at most, by hash of their key; one part if they fit."""
    rows, most = queries.count(), max(1, min(MAX_QUERY_ROWS, MAX_QUERY_NUMBERS // max(width, 1)))
    n = -(-rows * 5 // (most * 4)) if rows > most else 1
    return [queries.where(F.pmod(F.xxhash64(query_key), F.lit(n)) == k) for k in range(n)] if n > 1 else [queries]


def _units(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.sqrt((values * values).sum(axis=1, keepdims=True)), 1e-12)


def _matrix(ids: pa.Array, vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have an id and ``width`` numbers."""
    fits = pc.and_(pc.and_(pc.is_valid(ids), pc.is_valid(vectors)), pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), width))
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), _units(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))


class _Nearest:
    """The best k of the vectors seen so far for each query, by rounded cosine, then least id."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int):
        self.ids, self.units, self.k = ids, units, k
        self.best = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, units: np.ndarray) -> None:
        step = max(1, SCORES // max(len(self.ids), 1))
        for at in range(0, len(ids), step):
            here = ids[at : at + step]
            scores = np.round(self.units @ units[at : at + step].T, 9)
            scores[self.ids[:, None] == here[None, :]] = -np.inf  # a vector isn't its own neighbour
            least = self.best[:, -1]
            if len(here) > self.k:  # what isn't among the part's best can't be among the best
                least = np.maximum(least, np.partition(scores, len(here) - self.k, axis=1)[:, len(here) - self.k])
            q, r = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            if len(q):
                self._merge(q, scores[q, r], here[r])

    def _merge(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(q)
        owner = np.concatenate((np.repeat(some, self.k), q))
        value, name = np.concatenate((self.best[some].ravel(), scores)), np.concatenate((self.found[some].ravel(), ids))
        order = np.lexsort((name, -value, owner))
        owner, value, name = owner[order], value[order], name[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < self.k
        self.best[owner[keep], rank[keep]], self.found[owner[keep], rank[keep]] = value[keep], name[keep]


def dense(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str, query_vector: str, k: int) -> DataFrame:
    """(query_key, key, cosine, rank): top k neighbours of each query among all vectors, itself left out; keys are longs.

    Queries go in blocks of bounded size, each against all vectors in one narrow
    pass: a partition holds the best k for each query and hands on nothing else.
    Rows without a vector, or with one of another length than most, have no
    neighbours and are none.
    """
    q = queries.select(F.col(query_key).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    size = q.where("v IS NOT NULL").groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    v = vectors.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    schema, out = "q long, i long, cosine double", None
    for block in query_blocks(q, "q", size["n"] if size else 1):
        rows = block.where("q IS NOT NULL AND v IS NOT NULL").where(F.size("v") == (size["n"] if size else 0)).collect()
        ids = np.array([r["q"] for r in rows], np.int64)
        units = _units(np.array([r["v"] for r in rows], float).reshape(len(rows), -1)) if rows and size["n"] else np.zeros((0, 1))

        def near(batches: Iterator[pa.RecordBatch], ids=ids, units=units, width=units.shape[1]) -> Iterator[pa.RecordBatch]:
            best = _Nearest(ids[: len(units)], units, k)
            for batch in batches:
                best.see(*_matrix(batch.column(0), batch.column(1), width))
            q, r = np.nonzero(best.best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.found[q, r]), pa.array(best.best[q, r])], ["q", "i", "cosine"])

        # a query is in one block, so its top k is whole
        part = top_k(v.mapInArrow(near, schema), "q", k, F.col("cosine").desc(), F.col("i"))
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("q").alias(query_key), F.col("i").alias(key), "cosine", "rank")


#: Bytes of item texts, about, that one automaton holds.
AUTOMATON_BYTES = 8 << 20

#: The automaton of the block that this worker had last, by the block's name.
_built: dict[str, tuple] = {}


def _automaton(name_of: str, block: Broadcast) -> tuple:
    """The automaton of a broadcast block of (id, text), or None without texts, and the id of the empty text, if it is there."""
    if name_of not in _built:
        import ahocorasick

        _built.clear()
        machine, empty = ahocorasick.Automaton(), None
        for name, item in block.value:
            if item:
                machine.add_word(item, name)
            else:
                empty = name
        machine.make_automaton()
        _built[name_of] = (machine if len(machine) else None, empty)
    return _built[name_of]


def containment(docs: DataFrame, items: DataFrame, key: str, item_key: str, text: str, item_text: str, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(item, document) for each item whose text occurs verbatim in a document; the empty text is in every text.

    Distinct item texts go in blocks of bounded size, by hash, each to an automaton that reads every text once, so a
    text's cost doesn't depend on the number of items.  The driver holds one block at a time: what it broadcasts is kept
    on disk.
    """
    spark = docs.sparkSession
    named = items.where(F.col(item_text).isNotNull()).select(item_key, F.md5(item_text).alias("_id"), F.col(item_text).alias("_item"))
    distinct = named.select("_id", "_item").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("_item") + 64), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // block_bytes))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema, found = f"_id string, {key} {docs.schema[key].dataType.simpleString()}", None
    for k in range(n):
        rows = [(r["_id"], r["_item"]) for r in distinct.where(F.pmod(F.xxhash64("_id"), F.lit(n)) == k).collect()]
        block = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch], block=block, name_of=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            machine, empty = _automaton(name_of, block)
            for batch in batches:
                at, names = [], []
                for j, t in enumerate(batch.column(1).to_pylist()):
                    here = {name for _, name in machine.iter(t)} if machine else set()
                    if empty is not None:
                        here.add(empty)
                    at += [j] * len(here)
                    names += here
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], ["_id", key])

        part = texts.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found.join(small(named.select("_id", item_key)), "_id").select(item_key, key)


def _token_sets(d: DataFrame, key: str, tokens: Column, n: str) -> DataFrame:
    """(key, n, t): the distinct tokens of each row as hashes, and their number."""
    return d.select(key, F.transform(F.array_distinct(tokens), lambda x: F.xxhash64(x)).alias("t")).select(key, F.size("t").alias(n), "t")


def _ordered_tokens(sets: DataFrame, key: str, ranks: DataFrame, n: str) -> DataFrame:
    """(key, n, t): the number of distinct tokens of each row, and those that have a rank, by rank.

    They are longs: Spark looks these up in hash sets and compares structs each with each.
    """
    t = sets.select(key, n, F.explode("t").alias("token"))
    return t.join(ranks, "token").groupBy(key, n).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "token"))), lambda x: x["token"]).alias("t"))


def _prefix(d: DataFrame, key: str, n: str, at: str, threshold: float) -> DataFrame:
    """(key, n, r, at): the tokens of each row's prefix, and how many of its tokens come before.  Tokens without a rank come first of all."""
    length = F.col(n) - F.ceil(F.col(n) * threshold - 1e-9) + 1 - (F.col(n) - F.size("t"))
    lead = F.slice("t", F.lit(1), F.greatest(F.lit(0), F.least(length, F.size("t"))).cast("int"))
    return d.select(key, n, F.size("t").alias("_in"), F.posexplode(lead).alias("_p", "_r")).select(key, n, "_r", (F.col(n) - F.col("_in") + F.col("_p")).alias(at))


def similar_candidates(docs: DataFrame, queries: DataFrame, key: str, query_key: str, threshold: float) -> DataFrame:
    """(query, key, _nd, _nq): pairs that may have a Jaccard similarity at or above a threshold over zero, by prefix, length and position.

    Both sides are as ``_ordered_tokens`` makes them.  Two sets that are so similar have a token in common that is among
    the first of either, if both are in the same order; with the rarest tokens first few pairs have one.  What is behind
    the common token bounds how many they can share.
    """
    d, q = _prefix(docs, key, "_nd", "_i", threshold), _prefix(queries, query_key, "_nq", "_j", threshold)
    met = d.join(small(q), "_r").where((F.col("_nd") >= threshold * F.col("_nq") - 1e-9) & (F.col("_nq") >= threshold * F.col("_nd") - 1e-9))
    # the first common token of a pair has the least places in both, so it is the one that must pass
    first = met.groupBy(query_key, key, "_nd", "_nq").agg(F.min("_i").alias("_i"), F.min("_j").alias("_j"))
    most = F.least(F.col("_nd") - F.col("_i"), F.col("_nq") - F.col("_j"))
    return first.where(most >= threshold / (1 + threshold) * (F.col("_nd") + F.col("_nq")) - 1e-9).select(query_key, key, "_nd", "_nq")


def similar_pairs(docs: DataFrame, queries: DataFrame, key: str, query_key: str, doc_tokens: Column, query_tokens: Column, threshold: float) -> DataFrame:
    """(query, key, similarity) of all pairs with a Jaccard similarity of token sets at or above a threshold over zero.

    Only the queries' tokens have a rank, by how many documents have them; documents are known by these and by the
    number of all their tokens.  Candidates are verified by the whole sets.  Texts are cut into tokens once, and tokens
    are known by 64 bits of hash from then on.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be over zero")
    shared_folder(docs.sparkSession)
    dt, qt = _token_sets(docs, key, doc_tokens, "_nd").checkpoint(), _token_sets(queries, query_key, query_tokens, "_nq").checkpoint()
    asked = qt.select(F.explode("t").alias("token")).distinct().checkpoint()
    have = dt.select(F.explode("t").alias("token")).join(small(asked), "token").groupBy("token").agg(F.count("*").alias("_have"))
    # by the number of documents, then by hash
    ranks = small(asked.join(have, "token", "left").select("token", F.coalesce("_have", F.lit(0)).alias("_rank")).checkpoint())
    d = _ordered_tokens(dt, key, ranks, "_nd").checkpoint()
    q = _ordered_tokens(qt, query_key, ranks, "_nq").checkpoint()
    c = similar_candidates(d, q, key, query_key, threshold)
    met = c.join(d.select(key, F.col("t").alias("_dt")), key).join(q.select(query_key, F.col("t").alias("_qt")), query_key)
    common = F.size(F.array_intersect("_dt", "_qt"))
    s = met.select(query_key, key, (common / (F.col("_nd") + F.col("_nq") - common)).alias("similarity"))
    return s.where(F.col("similarity") >= threshold)


def jaccard_top_k(docs: DataFrame, queries: DataFrame, key: str, query_key: str, doc_tokens: Column, query_tokens: Column, threshold: float, k: int) -> DataFrame:
    """The k most similar documents of each query with Jaccard similarity of token sets at or above a threshold; of equal ones the latest key."""
    s = similar_pairs(docs, queries, key, query_key, doc_tokens, query_tokens, threshold)
    return top_k(s, query_key, k, F.col("similarity").desc(), F.col(key).desc())


#: Fixed weights: of lexical, dense and keyword scores, and of the blend, keyword and priority in reranking.
BLEND, RERANK = (0.52, 0.38, 0.10), (0.72, 0.23, 0.05)


def _scaled(c: Column, by: W) -> Column:
    """Scores of a query from 0 to 1 over all its rules; where all are equal, whether they are positive."""
    low, high = F.min(c).over(by), F.max(c).over(by)
    return F.when(high > low, (c - low) / (high - low)).otherwise((c > 0).cast("double"))


def hybrid(candidates: DataFrame, query_key: str, mode: str = "hybrid", rerank: bool = True, category: Column | None = None, k: int = 10, tie: str = "rule_id") -> DataFrame:
    """Ranks the rules of each query, with the scores that make up the rank.

    ``candidates`` has a row for every query and rule with ``lexical`` and
    ``dense`` scores, ``keyword`` (the share of the rule's keywords that the
    query has) and ``priority`` (of 100).  Lexical and dense scores are scaled
    over all rules of a query, and the category filter comes after that.  ``mode``
    is bm25, dense or hybrid.  Of equal scores the greatest priority, then the
    greatest id comes first.
    """
    if mode not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    by = W.partitionBy(query_key)
    d = candidates.withColumns({"bm25": _scaled(F.col("lexical"), by), "dense_scaled": _scaled(F.col("dense"), by)})
    blend = sum((w * F.col(c) for w, c in zip(BLEND, ("bm25", "dense_scaled", "keyword"), strict=True)), F.lit(0.0))
    d = d.withColumn("retrieval", {"bm25": F.col("bm25"), "dense": F.col("dense_scaled"), "hybrid": blend}[mode])
    urgency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("priority") / 100.0))
    last = RERANK[0] * F.col("retrieval") + RERANK[1] * F.col("keyword") + RERANK[2] * urgency
    d = d.withColumn("score", last if rerank else F.col("retrieval"))
    if category is not None:
        d = d.where(category)
    return top_k(d, query_key, k, F.round("score", 12).desc(), F.col("priority").desc(), F.col(tie).desc())


def keyword_share(content: Column, keywords: Column) -> Column:
    """Share of the keywords that a text has, whatever their case; 0 without keywords."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(content), F.lower(k))))
    return F.when(F.size(keywords) > 0, hits / F.size(keywords)).otherwise(0.0)


def authority(fragments: DataFrame, rules: DataFrame, case: str, fragment: str, fragment_tokens: Column, rule_tokens: Column, threshold: Column | float, k: int = 3) -> DataFrame:
    """(case, fragment, best, chosen, top): per fragment of a case the rules of the case's category that fit best.

    ``fragments`` has case, fragment (a place in the case) and category, ``rules`` rule_id and category.  BM25 counts
    over all rules; only those of the category are ranked.  The best one is chosen if it scores at least the threshold.
    """
    name = F.struct(F.col(case), F.col(fragment))
    f = fragments.withColumn("_f", name)
    scored = bm25(rules, f, "rule_id", "_f", rule_tokens, fragment_tokens)
    allowed = scored.join(small(rules.select("rule_id", F.col("category").alias("_c"))), "rule_id").join(f.select("_f", "category"), "_f").where(F.col("_c") == F.col("category"))
    ranked = top_k(allowed, "_f", k, F.round("score", 9).desc(), F.col("rule_id")).groupBy("_f").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "rule_id", "score"))).alias("_top"))
    d = f.select(case, fragment, "_f").join(ranked, "_f", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return d.select(
        case,
        fragment,
        "best",
        F.when((F.col("best") >= limit) & F.col("_top").isNotNull(), F.get("_top", F.lit(0))["rule_id"]).alias("chosen"),
        F.array_join(F.transform("_top", lambda x: x["rule_id"].cast("string")), ",").alias("top"),
    )


def fuzzy_ids(raw: DataFrame, known: DataFrame, raw_key: str, known_key: str, category: str, slug: str) -> DataFrame:
    """Resolves an id by category and slug, equal or one a prefix of the other, where exactly one known id fits.

    Known ids are counted by each prefix of their slug, so a slug meets one row for all that begin with it, and one for
    each known slug that it begins with, however many share a prefix.  Raw slugs are resolved once each, and rows meet
    theirs.  All joins are merges of what is dealt by slug: prefixes are many times the rows that Spark's estimate of a
    file knows, so none may be broadcast by it.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    tally = (F.count("*").alias("n"), F.min("resolved").alias("resolved"))
    a = raw.select(raw_key, F.col(category).alias("_c"), F.col(slug).alias("_s"))
    b = known.select(F.col(known_key).alias("resolved"), F.col(category).alias("_c"), F.col(slug).alias("_k"))
    asked = a.select("_c", "_s").distinct()
    whole = b.groupBy("_c", F.col("_k").alias("_p")).agg(*tally)
    begins = whole.select("_c", "n", "resolved", F.explode(prefixes(F.col("_p"))).alias("_s")).groupBy("_c", "_s").agg(F.sum("n").alias("n"), F.min("resolved").alias("resolved"))
    shorter = asked.select("_c", "_s", F.explode(prefixes(F.col("_s"))).alias("_p")).where("_p <> _s")
    met = asked.join(begins.hint("merge"), ["_c", "_s"]).unionByName(shorter.join(whole.hint("merge"), ["_c", "_p"]).drop("_p"))
    found = met.groupBy("_c", "_s").agg(F.sum("n").alias("n"), F.min("resolved").alias("resolved"))
    return a.join(found.hint("merge"), ["_c", "_s"]).groupBy(raw_key).agg(F.sum("n").alias("n"), F.min("resolved").alias("resolved")).where("n = 1").select(raw_key, "resolved")


def category_vote(ranked: DataFrame, query_key: str, category: str, priority: str, rank: str = "rank") -> DataFrame:
    """The category with the largest sum of priority by rank."""
    s = ranked.groupBy(query_key, category).agg(F.sum(F.col(priority) / F.col(rank)).alias("weight"))
    best = F.max_by(F.struct(F.col(category), "weight"), F.struct(F.round("weight", 9).alias("w"), F.col(category)))
    return s.groupBy(query_key).agg(best.alias("_b")).select(query_key, f"_b.{category}", "_b.weight")
