"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

The tree is domain, language, source.  A token budget goes down it by weights.
A child that can't take its part (its documents, ``max_epochs`` times over, are
too few) takes what it can and the shortage goes to its siblings by weight; only
what a whole subtree can't take reaches the siblings of an ancestor.  Filling
children in the order of capacity by weight gives this in one window per level.

A leaf's budget is spent in epochs.  Whole epochs take each document once; the
rest is a prefix, in tokens, of the next epoch's seeded order.  The prefix is
found from token sums of hash bins, which grow in number with the rows, and row by row
only in the bin where it ends, so no task holds a leaf.

Defined results: null names are one child, ``(none)``; unlisted names weigh
``default_weight``; a null text has no tokens; an empty table gives no rows;
rows of one doc_id, or without one, are ordered by their texts, so rows of a leaf
that are equal in id and text, and no others, are taken or left together; weights
are positive.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, keep, meet, plain_names

DOMAINS: dict[str, tuple[str, ...]] = {
    "web": ("src0", "src1", "src2", "src3", "src4"),
    "forum": ("src5", "src6", "src7", "src8", "src9"),
    "news": ("src10", "src11", "src12", "src13", "src14"),
    "books": ("src15", "src16", "src17", "src18", "src19"),
}
DOMAIN_WEIGHTS = {"web": 4, "forum": 1, "news": 3, "books": 2}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
LEVELS = ("domain", "lang", "source")
BIN_DIGITS = 3


def domain_of(source: Column, domains: Mapping[str, tuple[str, ...]] = DOMAINS) -> Column:
    out = F.lit(None).cast("string")
    for name, sources in domains.items():
        out = F.when(source.isin(*sources), name).otherwise(out)
    return F.coalesce(out, F.lit("(none)"))


def _weight(name: Column, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, w in weights.items():
        out = F.when(name == k, w).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the part of ``budget`` of each child, from ``weight`` and ``cap``."""
    by = W.partitionBy(*(parent or [F.lit(0)]))
    ratio = F.col("cap").cast("decimal(38,6)") / F.col("weight")
    order = by.orderBy(ratio.asc(), F.col(name).asc())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    d = children.withColumn("_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_rest", F.sum("weight").over(rest))
    d = d.withColumn("_full", F.expr("cap * _rest <= (budget - _before) * weight"))
    left = F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(by)
    d = d.withColumn("_left", left).withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(by))
    return d.withColumn("given", F.expr("CASE WHEN _full THEN cap ELSE (_left * weight) div _open END")).drop("_before", "_rest", "_full", "_left", "_open")


def leaf_budgets(leaves: DataFrame, numerator: int, denominator: int, max_epochs: int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int], source_weights: Mapping[str, int], default_weight: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``given``; the whole budget is tokens * numerator / denominator."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above, parent = None, []
    for level, weights in zip(LEVELS, (domain_weights, lang_weights, source_weights), strict=True):
        names = [*parent, level]
        sums = caps.groupBy(*names).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        if above is None:
            total = sums.agg(F.expr(f"least((sum(tokens) * {numerator}) div {denominator}, sum(cap))").alias("budget"))
            sums = sums.crossJoin(F.broadcast(total))  # one row
        else:
            sums = sums.join(above, parent)
        sums = sums.withColumn("weight", _weight(F.col(level), weights, default_weight))
        filled = _fill(sums, parent, level)
        above, parent = filled.select(*names, F.col("given").alias("budget")), names
    return filled.select(*LEVELS, "tokens", "given")


def named(docs: DataFrame, domains: Mapping[str, tuple[str, ...]] = DOMAINS, prefix: str = "_") -> DataFrame:
    """The leaf of each document, in columns with a prefix."""
    none = F.lit("(none)")
    leaf = (domain_of(F.col("source"), domains), F.coalesce("lang", none), F.coalesce("source", none))
    return docs.withColumns({f"{prefix}{x}": c for x, c in zip(LEVELS, leaf, strict=True)})


def _order(seed: int, epoch: Column, doc_id: Column, text_hash: Column) -> Column:
    """A row's place in an epoch: by a hash of its id, and of its text and the epoch where ids are the same or null."""
    of_id = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text_hash)))
    return F.concat(F.sha2(of_id, 256), text_hash)


def _text_hash() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def bin_digits(rows: int) -> int:
    """Hexadecimal digits of the order by which rows are counted out, so that a leaf's last bin holds about 65,536 of them at most."""
    digits = BIN_DIGITS
    while rows >> (4 * digits) > 1 << 16:
        digits += 1
    return digits


def plan(docs: DataFrame, numerator: int, denominator: int, max_epochs: int, seed: int = 42, domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS, lang_weights: Mapping[str, int] = LANGUAGE_WEIGHTS, source_weights: Mapping[str, int] | None = None, domains: Mapping[str, tuple[str, ...]] = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows are doc_id, leaf and tokens; cuts have each leaf's whole epochs and the last order of its prefix."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = keep(named(docs.select("doc_id", "lang", "source", tokens.alias("n_tokens"), _text_hash().alias("text_hash")), domains).select("doc_id", "text_hash", *(F.col(f"_{x}").alias(x) for x in LEVELS), "n_tokens"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, numerator, denominator, max_epochs, domain_weights, lang_weights, source_weights or {})
    spent = (
        budgets.withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN given div tokens ELSE 0 END")).withColumn("rest", F.expr("CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END")).select(*LEVELS, "epochs", "rest")
    )
    spent = keep(spent)
    ordered = meet(rows, spent, list(LEVELS), F.col("doc_id")).withColumn("order", _order(seed, F.col("epochs"), F.col("doc_id"), F.col("text_hash"))).withColumn("bin", F.substring("order", 1, bin_digits(rows.count())))
    bins = ordered.groupBy(*LEVELS, "bin", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    bins = keep(bins.withColumn("upto", upto))
    whole = bins.where("upto <= rest").groupBy(*LEVELS).agg(F.max("bin").alias("bin")).select(*LEVELS, F.concat("bin", F.lit("g")).alias("cut"))  # g: after all digits
    last = bins.where("upto > rest AND upto - n <= rest").groupBy(*LEVELS).agg(F.min("bin").alias("bin"), F.min_by(F.col("upto") - F.col("n"), "bin").alias("before"))
    inside = ordered.join(last, [*LEVELS, "bin"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("order").rangeBetween(W.unboundedPreceding, 0)))
    part = inside.where("upto <= rest").groupBy(*LEVELS).agg(F.max("order").alias("cut"))
    cuts = whole.unionByName(part).groupBy(*LEVELS).agg(F.max("cut").alias("cut"))
    return rows, spent.join(cuts, list(LEVELS), "left").select(*LEVELS, "epochs", "cut")


def mix(docs: DataFrame, numerator: int = 3, denominator: int = 5, max_epochs: int = 2, seed: int = 42, **tree: Mapping) -> DataFrame:
    """The documents taken: doc_id, domain, lang, source, n_tokens, copies."""
    rows, cuts = plan(docs, numerator, denominator, max_epochs, seed, **tree)
    return meet(rows, cuts, list(LEVELS), F.col("doc_id")).withColumn("copies", _copies(seed, F.col("doc_id"), F.col("text_hash"))).where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def _copies(seed: int, doc_id: Column, text_hash: Column) -> Column:
    taken = F.coalesce(_order(seed, F.col("epochs"), doc_id, text_hash) <= F.col("cut"), F.lit(False))
    return F.col("epochs").cast("int") + taken.cast("int")


@plain_names
def mix_rows(docs: DataFrame, numerator: int, denominator: int, seed: int = 42, **tree: Mapping) -> DataFrame:
    """The rows of ``docs`` that are taken in at most one epoch, with all their columns."""
    _, cuts = plan(docs, numerator, denominator, 1, seed, **tree)
    p = "_"
    while any(c.startswith(p) for c in docs.columns):  # names that no column of the input has
        p += "_"
    cuts = cuts.select(*(F.col(x).alias(f"{p}{x}") for x in (*LEVELS, "epochs", "cut")))
    taken = F.coalesce(_order(seed, F.col(f"{p}epochs"), F.col("doc_id"), _text_hash()) <= F.col(f"{p}cut"), F.lit(False))
    whole = F.col(f"{p}epochs") > 0
    return meet(named(docs, prefix=p), cuts, [f"{p}{x}" for x in LEVELS], F.col("doc_id")).where(whole | taken).select(*docs.columns)


def _case(column: str, weights: Mapping[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {w}" for k, w in weights.items())} ELSE 1 END" if weights else "1"


def _sql_level(level: str, source: str, parent: tuple[str, ...], weights: Mapping[str, int]) -> str:
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"{by} ORDER BY cap::DOUBLE / weight, {level}"
    names = ", ".join((*parent, level))
    return f"""
{level}_w AS (SELECT {names}, any_value(budget) AS budget, sum(cap)::BIGINT AS cap, sum(tokens)::BIGINT AS tokens, any_value({_case(level, weights)})::BIGINT AS weight FROM {source} GROUP BY {names}),
{level}_o AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_ FROM {level}_w),
{level}_f AS (SELECT *, cap * rest_ <= (budget - before_) * weight AS full_ FROM {level}_o),
{level}_s AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({by}) AS left_, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({by}) AS open_ FROM {level}_f),
{level}_g AS (SELECT {names}, tokens, CASE WHEN full_ THEN cap ELSE (left_ * weight) // open_ END::BIGINT AS given FROM {level}_s)"""


def oracle(documents: str = "documents", numerator: int = 3, denominator: int = 5, max_epochs: int = 2, seed: int = 42, columns: str = "doc_id, domain, lang, source, n_tokens, copies") -> str:
    """The same in SQL; ``columns`` of the documents taken."""
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in ss)}) THEN '{d}'" for d, ss in DOMAINS.items()) + " ELSE '(none)' END"
    return f"""
WITH rows_ AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens, md5(coalesce(text, '')) AS th FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {max_epochs})::BIGINT AS cap FROM rows_ GROUP BY ALL),
root AS (SELECT *, (SELECT least((sum(tokens) * {numerator}) // {denominator}, sum(cap)) FROM leaves) AS budget FROM leaves),
{_sql_level("domain", "root", (), DOMAIN_WEIGHTS)},
d2 AS (SELECT l.*, given AS budget FROM leaves l JOIN domain_g USING (domain)),
{_sql_level("lang", "d2", ("domain",), LANGUAGE_WEIGHTS)},
d3 AS (SELECT l.*, given AS budget FROM leaves l JOIN lang_g USING (domain, lang)),
{_sql_level("source", "d3", ("domain", "lang"), {})},
spent AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM source_g),
ordered AS (SELECT r.*, epochs, rest, sha256('{seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'text:' || th)) || th AS o FROM rows_ r JOIN spent USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered),
taken AS (SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM run)
SELECT {columns} FROM taken WHERE copies > 0
"""
