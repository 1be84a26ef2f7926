"""Policy rules: composing, deciding with bound exceptions, verifying and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

#: Rows of matched rules that a part has, about.
PART_ROWS = 500_000


def parts(rows: DataFrame) -> int:
    """Parts into which rows are dealt: as many as shuffles have, and more where a part would have more than ``PART_ROWS``."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))


def with_rules(items: DataFrame, rules: DataFrame, rule: str, case: str, n: int) -> DataFrame:
    """Items with what their rule says, joined in ``n`` parts; a rule with more than ``PART_ROWS`` items is dealt over shares of its cases.

    Spark would make as few parts as it has tasks, so that they grow with the items.  The driver holds the rules that are
    dealt, of which there are fewer than parts.
    """
    counts = items.groupBy(rule).agg(F.count("*").alias("n"))
    common = {r[rule]: -(-r["n"] // PART_ROWS) for r in counts.where((F.col("n") > PART_ROWS) & F.col(rule).isNotNull()).collect()}
    keys = [rule]
    if common:
        keys, shares = [rule, "_share"], F.lit(1)
        for k in sorted(set(common.values())):
            shares = F.when(F.col(rule).isin([r for r, v in common.items() if v == k]), k).otherwise(shares)
        items = items.withColumn("_share", F.pmod(F.xxhash64(case), shares).cast("int"))
        rules = rules.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return items.join(rules.repartition(n, *keys).hint("merge"), keys).drop("_share")


LEVELS = {"PASS": 0, "REVIEW": 1, "REJECT": 2}


def level(decision: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in LEVELS.items():
        out = F.when(decision == name, n).otherwise(out)
    return out


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where("status = 'active'")


def compose(matched: DataFrame, case: str) -> DataFrame:
    """One rule per canonical id, that of most priority, then of greatest id; with how much that saves.

    ``matched`` has a row for each case and rule that was asked for: rule_id,
    canonical_id, category, priority; a null canonical_id is an unknown rule.
    A rule counts once, however often it was asked for, and compression is one
    less the share of rules that is left of all asked for, the unknown included.
    """
    asked = matched.select(case, "rule_id", "canonical_id", "category", "priority").distinct()
    known = F.col("canonical_id").isNotNull()
    best = asked.groupBy(case, "canonical_id").agg(F.count("*").alias("n"), F.max(F.struct("priority", "rule_id", "category")).alias("r"))
    g = best.groupBy(case).agg(
        F.sum("n").alias("n_matched"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_unknown"),
        F.count_if(known).alias("n_rules"),
        F.size(F.collect_set(F.when(known, F.col("r.category")))).alias("n_categories"),
        F.array_join(F.array_sort(F.collect_list(F.when(known, F.col("r.rule_id")).cast("string"))), ",").alias("rules"),
        F.max(F.when(known, F.struct("r.priority", "canonical_id"))).getField("canonical_id").alias("first"),
    )
    return g.select(case, "n_matched", "n_unknown", "n_rules", (F.col("n_categories") > 1).alias("conflict"), (1 - F.col("n_rules") / F.col("n_matched")).alias("compression"), "rules", "first")


def decide(matched: DataFrame, case: str) -> DataFrame:
    """The decision of each case from its matched rules, with the rules it rests on.

    A PASS rule exempts only the risky rules that name it as an exception.  If
    there are risky rules and all are exempt, or there are PASS rules alone, the
    case passes; otherwise the un-exempted rule of the highest level, then
    priority, then least id decides.  A case without rules is for review: give
    it a row with a null rule_id.  ``applied`` are the deciding rule, or the
    PASS rules that exempt; ``matched_rules`` all rules in order of their ids.
    If ``matched`` has ``cues`` and ``content``, ``evidence`` are the distinct
    cues of the rules that the content has, in the rules' order.
    """
    with_cues = {"cues", "content"} <= set(matched.columns)
    rules = F.struct("rule_id", "decision", "priority", "exception_ids", *(["cues"] if with_cues else []))
    kept = [F.array_sort(F.filter(F.collect_list(F.when(F.col("rule_id").isNotNull(), rules)), lambda r: r.isNotNull()), lambda x, y: F.when(x["rule_id"] < y["rule_id"], -1).when(x["rule_id"] > y["rule_id"], 1).otherwise(0)).alias("_rules")]
    g = matched.groupBy(case).agg(*kept, *([F.first("content").alias("_content")] if with_cues else []))
    passes = F.transform(F.filter("_rules", lambda r: r["decision"] == "PASS"), lambda r: r["rule_id"])
    risky = F.filter("_rules", lambda r: r["decision"] != "PASS")
    found = F.array_distinct(F.filter(F.flatten(F.transform("_rules", lambda r: F.coalesce(r["cues"], F.array().cast("array<string>")))), lambda c: F.contains(F.col("_content"), c))) if with_cues else F.array().cast("array<string>")
    g = g.select(case, F.size("_rules").alias("n_rules"), F.transform("_rules", lambda r: r["rule_id"]).alias("_ids"), passes.alias("_pass"), risky.alias("_risky"), F.array_join(found, "|").alias("evidence"))
    excepted = lambda r: F.coalesce(r["exception_ids"], F.array().cast("array<bigint>"))
    open_ = F.filter("_risky", lambda r: ~F.exists(excepted(r), lambda e: F.array_contains("_pass", e)))
    ordered = F.array_sort(F.transform(open_, lambda r: F.struct((-level(r["decision"])).alias("l"), (-r["priority"]).alias("p"), r["rule_id"].alias("i"), r["decision"].alias("d"))))
    g = g.withColumn("_open", ordered)
    top = F.get("_open", F.lit(0))
    decision = F.when(F.col("n_rules") == 0, "REVIEW").when(F.size("_open") == 0, "PASS").otherwise(top["d"])
    exempt = (F.size("_open") == 0) & (F.size("_risky") > 0)
    reason = F.when(F.col("n_rules") == 0, "no_rule").when(exempt, "all_exempt").when(F.size("_open") == 0, "pass_rules").otherwise("risk")
    exempting = F.filter("_pass", lambda p: F.exists("_risky", lambda r: F.array_contains(excepted(r), p)))
    applied = F.when(exempt, exempting).when(F.size("_open") > 0, F.array(top["i"])).otherwise(F.array().cast("array<bigint>"))
    return g.select(
        case,
        "n_rules",
        decision.alias("decision"),
        reason.alias("reason_code"),
        top["i"].alias("deciding_rule"),
        (F.size("_risky") - F.size("_open")).alias("n_exempt"),
        F.array_join(F.col("_ids").cast("array<string>"), ",").alias("matched_rules"),
        F.array_join(applied.cast("array<string>"), ",").alias("applied"),
        "evidence",
    )


def gold_rules(hits: DataFrame, case: str, n_sub: int = 2) -> DataFrame:
    """The root rule and up to ``n_sub`` sub-rules with most keyword hits, then priority, then greatest id."""
    by = W.partitionBy(case, "is_root").orderBy(F.col("hits").desc(), F.col("priority").desc(), F.col("rule_id").desc())
    d = hits.where("hits > 0 OR is_root").withColumn("_r", F.row_number().over(by))
    return d.where(F.col("_r") <= F.when(F.col("is_root"), 1).otherwise(n_sub)).drop("_r")


def evidence(keywords: DataFrame, case: str, article: str, n: int = 3) -> DataFrame:
    """Up to ``n`` distinct keywords of the matched rules that occur in the article, by rule priority and place."""
    d = keywords.where(F.contains(F.col(article), F.col("keyword"))).groupBy(case, "keyword").agg(F.min(F.struct((-F.col("priority")).alias("p"), F.col("pos").alias("k"))).alias("o"))
    r = d.withColumn("_r", F.row_number().over(W.partitionBy(case).orderBy("o", "keyword"))).where(F.col("_r") <= n)
    return r.groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "keyword"))), lambda x: x["keyword"]), "|").alias("terms"))


def hard_checks(prediction: dict[str, Column], known_ids: Column, categories: Column) -> Column:
    """Five checks on a parsed prediction, as a struct of booleans, and whether all hold."""
    ids = prediction["rule_ids"]
    checks = {
        "format": prediction["valid"],
        "ids_known": (F.size(ids) > 0) & (F.size(F.array_except(ids, known_ids)) == 0),
        "one_category": F.size(F.array_distinct(categories)) <= 1,
        "facts": F.size(prediction["facts"]) > 0,
        "decision": prediction["decision"].isin(*LEVELS),
    }
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    every = flags["format"]
    for v in list(flags.values())[1:]:
        every = every & v
    return F.struct(*(v.alias(k) for k, v in flags.items()), every.alias("all"))


def judge_checks(judged: Column, allowed: Column, decision: Column, engine: Column, valid: Column) -> Column:
    """Checks on a judge's choice: valid, not empty, among the candidates, no repeats, and the engine decides alike."""
    return F.struct(
        valid.alias("format"),
        (F.size(judged) > 0).alias("not_empty"),
        (F.size(F.array_except(judged, allowed)) == 0).alias("among"),
        (F.size(F.array_distinct(judged)) == F.size(judged)).alias("no_repeat"),
        F.coalesce(decision == engine, F.lit(False)).alias("consistent"),
    )


def verified(checks: Column, memory_ids: Column, authority_ids: Column, threshold: float = 0.5) -> Column:
    """A memory's rules against the authority's: accepted if all checks hold and they agree enough; corrected if the sets differ, accepted or not."""
    similarity = text.jaccard(memory_ids, authority_ids)
    differ = (F.size(F.array_except(memory_ids, authority_ids)) > 0) | (F.size(F.array_except(authority_ids, memory_ids)) > 0)
    return F.struct(similarity.alias("similarity"), (checks["all"] & (similarity >= threshold)).alias("accepted"), differ.alias("corrected"))


def route(confidence: Column, high: float, low: float, searchable: Column) -> Column:
    return F.when(confidence >= high, "high_direct").when(confidence < low, "low_abstain").when(searchable, "medium_search").otherwise("medium_abstain")


def first_pass_right(ids: Column, gold_ids: Column, decision: Column, gold: Column) -> Column:
    return (F.array_sort(F.array_distinct(ids)) == F.array_sort(F.array_distinct(gold_ids))) & (decision == gold)


def failed(ids: Column, gold_ids: Column, decision: Column, gold: Column, must_reject: Column) -> Column:
    return ~(first_pass_right(ids, gold_ids, decision, gold) & ~(must_reject & (decision != "REJECT")))


def set_rules(rules: DataFrame, ids: list, enabled: bool | None) -> DataFrame:
    """A copy of the rule table with some rules enabled, disabled, or (None) deleted; an unknown id raises."""
    found = {r[0] for r in rules.where(F.col("rule_id").isin(*ids)).select("rule_id").collect()}
    if missing := [i for i in ids if i not in found]:
        raise KeyError(f"no such rule: {missing}")
    if enabled is None:
        return rules.where(~F.col("rule_id").isin(*ids))
    return rules.withColumn("enabled", F.when(F.col("rule_id").isin(*ids), enabled).otherwise(F.col("enabled")))


def methods(predictions: dict[str, DataFrame]) -> DataFrame:
    """Predictions of several methods for the same cases, one under the other."""
    out = None
    for name, d in predictions.items():
        d = d.withColumn("method", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
