"""Queries of the rule engine, hybrid search, routing and value estimates; parts stand in for rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import memory, metrics, policy, retrieval
from .base import LANGS, SCORED, Tables, h, long, query, r6, scored

# rules: a part is a rule, its brand the canonical id, its size the priority
MATCHED = "(SELECT o_orderkey, l_partkey AS rule_id, CASE WHEN l_partkey % 11 <> 0 THEN p_brand END AS canonical_id, p_type AS category, p_size AS priority, CASE p_partkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' ELSE 'REJECT' END AS decision FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


def matched(t: Tables) -> DataFrame:
    """Rules of each order, dealt by order into parts that grow in number with the items, so that a part's rows fit into a task's memory."""
    p = t.part.select(F.col("p_partkey").alias("rule_id"), "p_brand", F.col("p_type").alias("category"), F.col("p_size").alias("priority"), F.when(F.col("p_partkey") % 4 == 0, "PASS").when(F.col("p_partkey") % 4 == 1, "REVIEW").otherwise("REJECT").alias("decision"))
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("rule_id"))
    n = policy.parts(items)
    d = items.join(F.broadcast(p), "rule_id") if p.count() <= retrieval.BROADCAST_ROWS else policy.with_rules(items, p, "rule_id", "o_orderkey", n)
    # Spark looks orders up before the items are dealt, so the orders' parts are given as well
    d = d.join(t.orders.select("o_orderkey").repartition(n, "o_orderkey").hint("merge"), "o_orderkey", "left_semi").repartition(n, "o_orderkey")
    return d.select("o_orderkey", "rule_id", F.when(F.col("rule_id") % 11 != 0, F.col("p_brand")).alias("canonical_id"), "category", "priority", "decision")


@query("pol02_compose", f"""WITH m AS (SELECT DISTINCT * FROM {MATCHED}), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, canonical_id ORDER BY priority DESC, rule_id DESC) AS k FROM m WHERE canonical_id IS NOT NULL),
s AS (SELECT o_orderkey, count(*) AS n_rules, count(DISTINCT category) AS nc, array_to_string(list_sort(list(rule_id::VARCHAR)), ',') AS rules, arg_max(canonical_id, (priority, canonical_id)) AS first FROM b WHERE k = 1 GROUP BY o_orderkey),
e AS (SELECT o_orderkey, count(*) AS n_matched, count(*) FILTER (canonical_id IS NULL) AS n_unknown FROM m GROUP BY o_orderkey)
SELECT o_orderkey, n_matched, n_unknown, coalesce(n_rules, 0) AS n_rules, coalesce(nc, 0) > 1 AS conflict, round(1 - coalesce(n_rules, 0) / n_matched::DOUBLE, 6) AS compression, coalesce(rules, '') AS rules, first FROM e LEFT JOIN s USING (o_orderkey)""")
def pol02(t: Tables) -> DataFrame:
    return policy.compose(matched(t), "o_orderkey").withColumn("compression", r6(F.col("compression")))


GOLD = f"(SELECT o_orderkey, rule_id, priority, ({h('rule_id', 5)}) AS hits, rule_id % 10 = 0 AS is_root FROM {MATCHED})"


@query("pol03_gold_rules", f"SELECT o_orderkey, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, is_root ORDER BY hits DESC, priority DESC, rule_id DESC) AS k FROM (SELECT DISTINCT * FROM {GOLD}) WHERE hits > 0 OR is_root) WHERE k <= CASE WHEN is_root THEN 1 ELSE 2 END")
def pol03(t: Tables) -> DataFrame:
    from ..functions.scores import hash_int

    d = matched(t).select("o_orderkey", "rule_id", "priority", hash_int(F.col("rule_id"), 5).alias("hits"), (F.col("rule_id") % 10 == 0).alias("is_root")).distinct()
    return policy.gold_rules(d, "o_orderkey").select("o_orderkey", "rule_id")


@query("pol04_evidence_terms", "WITH k AS (SELECT doc_id, text, unnest([{'keyword': 'the', 'priority': 1, 'pos': 0}, {'keyword': 'ion', 'priority': 3, 'pos': 1}, {'keyword': 'de', 'priority': 2, 'pos': 0}, {'keyword': 'er', 'priority': 2, 'pos': 1}], recursive := true) FROM documents), r AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY -priority, pos, keyword) AS k FROM k WHERE contains(text, keyword)) SELECT doc_id, string_agg(keyword, '|' ORDER BY k) AS terms FROM r WHERE k <= 3 GROUP BY doc_id")
def pol04(t: Tables) -> DataFrame:
    words = [("the", 1, 0), ("ion", 3, 1), ("de", 2, 0), ("er", 2, 1)]
    listed = F.array(*(F.struct(F.lit(k).alias("keyword"), F.lit(p).alias("priority"), F.lit(i).alias("pos")) for k, p, i in words))
    d = t.documents.select("doc_id", "text", F.inline(listed))
    return policy.evidence(d, "doc_id", "text")


@query(
    "pol05_decision",
    f"""WITH m AS (SELECT m.*, o_orderstatus || ' ' || o_orderpriority || ' ' || o_orderkey AS content, ['PRIO', 'O ' || rule_id % 10, '-' , canonical_id] AS cues FROM {MATCHED} m JOIN orders USING (o_orderkey)),
x AS (SELECT a.o_orderkey, a.rule_id, a.decision, a.priority, CASE a.decision WHEN 'REVIEW' THEN 1 WHEN 'REJECT' THEN 2 ELSE 0 END AS lv, EXISTS (SELECT 1 FROM m b WHERE b.o_orderkey = a.o_orderkey AND b.decision = 'PASS' AND b.rule_id IN (a.rule_id - 1, a.rule_id - 2)) AS exempt FROM m a),
y AS (SELECT DISTINCT b.o_orderkey, b.rule_id FROM m b JOIN m a USING (o_orderkey) WHERE b.decision = 'PASS' AND a.decision <> 'PASS' AND b.rule_id IN (a.rule_id - 1, a.rule_id - 2)),
z AS (SELECT o_orderkey, array_to_string(list_sort(list(rule_id)), ',') AS exempting FROM y GROUP BY o_orderkey),
o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY lv DESC, priority DESC, rule_id) AS k FROM x WHERE decision <> 'PASS' AND NOT exempt),
c AS (SELECT o_orderkey, flatten(list(list_filter(cues, lambda v: v IS NOT NULL AND contains(content, v)) ORDER BY rule_id)) AS found FROM m GROUP BY o_orderkey),
g AS (SELECT o_orderkey, count(*)::INTEGER AS n_rules, array_to_string(list_sort(list(rule_id)), ',') AS matched_rules, count(*) FILTER (decision <> 'PASS') AS n_risky, count(*) FILTER (decision <> 'PASS' AND exempt)::INTEGER AS n_exempt FROM x GROUP BY o_orderkey)
SELECT g.o_orderkey, n_rules, coalesce(o.decision, 'PASS') AS decision, CASE WHEN o.decision IS NOT NULL THEN 'risk' WHEN n_risky > 0 THEN 'all_exempt' ELSE 'pass_rules' END AS reason_code, o.rule_id AS deciding_rule, n_exempt, matched_rules,
CASE WHEN o.rule_id IS NOT NULL THEN o.rule_id::VARCHAR WHEN n_risky > 0 THEN exempting ELSE '' END AS applied,
array_to_string(list_filter(found, lambda v, i: list_position(found, v) = i), '|') AS evidence FROM g JOIN c USING (o_orderkey) LEFT JOIN z USING (o_orderkey) LEFT JOIN o ON o.o_orderkey = g.o_orderkey AND o.k = 1""",
)
def pol05(t: Tables) -> DataFrame:
    content = t.orders.select("o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("content"))
    cues = F.array_compact(F.array(F.lit("PRIO"), F.concat(F.lit("O "), (F.col("rule_id") % 10).cast("string")), F.lit("-"), F.col("canonical_id")))
    d = matched(t).withColumns({"exception_ids": F.array(F.col("rule_id") - 1, F.col("rule_id") - 2), "cues": cues})
    return policy.decide(d.join(content, "o_orderkey"), "o_orderkey")


# benchmark items stand in for rules, in four categories that are the documents' languages


def _rules(t: Tables) -> DataFrame:
    w = text.words(F.col("text"))
    return t.benchmark.select(F.col("item_id").alias("rule_id"), "text", F.element_at(F.array(*map(F.lit, LANGS)), (F.col("item_id") % 4 + 1).cast("int")).alias("category"), (F.col("item_id") * 7 % 101).alias("priority"), F.slice(F.array_distinct(w), 1, 3).alias("keywords"))


@query("pol01_hybrid_search")
def pol01(t: Tables) -> DataFrame:
    """Every twentieth document is a query against all rules: each is scored with each, as scaling needs."""
    from ..functions.hashing import hashed_features

    rules, asked = _rules(t), t.documents.where("doc_id % 20 = 0").select("doc_id", "text", "lang")
    tokens = text.feature_tokens(F.col("text"), {"table": ["|"]})
    lexical = retrieval.bm25(rules, asked, "rule_id", "doc_id", tokens, tokens, distinct_query=True).withColumnRenamed("score", "lexical")
    vectors = lambda d, key, name: hashed_features(d.select(key, tokens.alias("tokens")), key, "tokens").withColumnRenamed("vector", name)
    of_rules = retrieval.small(vectors(rules, "rule_id", "rv").join(rules.select("rule_id", "keywords", "priority", "category"), "rule_id"))
    pairs = vectors(asked, "doc_id", "qv").join(asked, "doc_id").crossJoin(of_rules)
    c = pairs.select("doc_id", "rule_id", "category", "lang", "priority", retrieval.cosine(F.col("qv"), F.col("rv")).alias("dense"), retrieval.keyword_share(F.col("text"), F.col("keywords")).alias("keyword"))
    c = c.join(lexical, ["doc_id", "rule_id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    found = retrieval.hybrid(c, "doc_id", category=F.col("category") == F.col("lang"), k=3)
    return found.select("doc_id", long("rank").alias("rank"), "rule_id", *(r6(F.col(x)).alias(x) for x in ("bm25", "keyword", "retrieval", "score")), r6(F.col("dense_scaled")).alias("dense"))


@query("pol06_authority_retrieval")
def pol06(t: Tables) -> DataFrame:
    """Every twentieth document is a case, its lines are the fragments; the threshold is fitted on the cases with labels."""
    from ..operators.calibration import balanced_threshold
    from ..operators.shape import exploded_in_order

    cases = t.documents.where("doc_id % 20 = 0").select("doc_id", F.col("lang").alias("category"), F.split("text", r"\n").alias("parts"))
    lines = exploded_in_order(cases, "doc_id", F.col("parts")).join(cases.select("doc_id", "category"), "doc_id")
    rules = _rules(t).select("rule_id", "category", "text")
    found = retrieval.authority(lines, rules, "doc_id", "pos", text.search_tokens(F.col("part")), text.search_tokens(F.col("text")), 0.0)
    best = found.groupBy("doc_id").agg(F.max("best").alias("best"))
    limit = balanced_threshold(best.join(t.labels.select("doc_id", "quality"), "doc_id"), "best", "quality")
    d = found.crossJoin(F.broadcast(limit.select("threshold")))  # one row
    chosen = F.when((F.col("best") >= F.col("threshold")) & (F.col("threshold") > 0), F.col("chosen"))
    return d.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(chosen)).cast("array<string>"), ",").alias("rules"), r6(F.max("best")).alias("best"), F.count("*").alias("n_fragments"))


@query("pol07_verification", "SELECT doc_id, round(CASE WHEN u = 0 THEN 1 ELSE len(list_intersect(a, b)) / u::DOUBLE END, 6) AS similarity, CASE WHEN u = 0 THEN 1 ELSE len(list_intersect(a, b)) / u::DOUBLE END >= 0.5 AND doc_id % 4 <> 0 AS accepted, len(list_intersect(a, b)) <> u AS corrected FROM (SELECT doc_id, a, b, len(list_distinct(list_concat(a, b))) AS u FROM (SELECT doc_id, [lang, source] AS a, ['en', source, source] AS b FROM documents))")
def pol07(t: Tables) -> DataFrame:
    checks = F.struct((F.col("doc_id") % 4 != 0).alias("all"))
    v = policy.verified(checks, F.array("lang", "source"), F.array(F.lit("en"), F.col("source"), F.col("source")))
    return t.documents.select("doc_id", v.alias("v")).select("doc_id", r6(F.col("v.similarity")).alias("similarity"), "v.accepted", "v.corrected")


@query("flt10_hard_checks", "SELECT doc_id, doc_id % 5 <> 0 AS format, lang IN ('en', 'de') AS ids_known, doc_id % 5 <> 0 AND lang IN ('en', 'de') AND doc_id % 3 <> 0 AS all_hold FROM documents")
def flt10(t: Tables) -> DataFrame:
    facts = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    c = policy.hard_checks({"rule_ids": F.array("lang"), "valid": F.col("doc_id") % 5 != 0, "facts": facts, "decision": F.lit("PASS")}, F.array(F.lit("en"), F.lit("de")), F.array("source"))
    return t.documents.select("doc_id", c.alias("c")).select("doc_id", "c.format", "c.ids_known", F.col("c.all").alias("all_hold"))


@query("flt11_judge_checks", "SELECT doc_id, lang IN ('en', 'de') AS among, lang <> source AS no_repeat, doc_id % 2 = 0 AS consistent FROM documents")
def flt11(t: Tables) -> DataFrame:
    c = policy.judge_checks(F.array("lang", "source"), F.array(F.lit("en"), F.lit("de"), F.col("source")), F.lit("PASS"), F.when(F.col("doc_id") % 2 == 0, "PASS").otherwise("REJECT"), F.lit(True))
    return t.documents.select("doc_id", c.alias("c")).select("doc_id", "c.among", "c.no_repeat", "c.consistent")


@query("pol08_router", f"SELECT doc_id, CASE WHEN conf >= 0.8 THEN 'high_direct' WHEN conf < 0.2 THEN 'low_abstain' WHEN toxic = 0 THEN 'medium_search' ELSE 'medium_abstain' END AS route FROM {SCORED}")
def pol08(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", policy.route(F.col("conf"), 0.8, 0.2, F.col("toxic") == 0).alias("route"))


@query("pol09_methods", f"SELECT method, count(*) AS n, round(avg((p = gold)::INTEGER), 6) AS accuracy FROM (SELECT 'guess' AS method, guess AS p, gold FROM {SCORED} UNION ALL SELECT 'always_pass', 'PASS', gold FROM {SCORED} UNION ALL SELECT 'gated', CASE WHEN conf >= 0.5 THEN guess ELSE 'REVIEW' END, gold FROM {SCORED}) GROUP BY method")
def pol09(t: Tables) -> DataFrame:
    d = scored(t)
    each = {"guess": F.col("guess"), "always_pass": F.lit("PASS"), "gated": F.when(F.col("conf") >= 0.5, F.col("guess")).otherwise("REVIEW")}
    m = policy.methods({k: d.select(c.alias("p"), "gold") for k, c in each.items()})
    return m.groupBy("method").agg(F.count("*").alias("n"), r6(F.avg((F.col("p") == F.col("gold")).cast("double"))).alias("accuracy"))


@query("pol10_first_pass", f"SELECT doc_id, guess = gold AND toxic = 0 AS right_first FROM {SCORED}")
def pol10(t: Tables) -> DataFrame:
    c = policy.first_pass_right(F.array(F.lit("b"), F.lit("a")), F.when(F.col("toxic") == 0, F.array(F.lit("a"), F.lit("b"), F.lit("b"))).otherwise(F.array(F.lit("a"))), F.col("guess"), F.col("gold"))
    return scored(t).select("doc_id", c.alias("right_first"))


@query("pol11_failures", f"SELECT doc_id FROM {SCORED} WHERE NOT (guess = gold AND NOT (toxic = 1 AND guess <> 'REJECT'))")
def pol11(t: Tables) -> DataFrame:
    ids = F.array(F.lit("a"))
    return scored(t).where(policy.failed(ids, ids, F.col("guess"), F.col("gold"), F.col("toxic") == 1)).select("doc_id")


STATE = "event_type || ' u' || user_id % 20"


def _state() -> Column:
    return F.concat_ws(" ", "event_type", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")))


def _memory(t: Tables) -> DataFrame:
    return t.events.where("event_id % 20 <> 0").select(F.col("event_id").alias("step"), _state().alias("state"), F.concat(F.lit("a"), (F.col("event_id") % 3).cast("string")).alias("action"), F.col("value").alias("return_value"))


def _states(t: Tables) -> DataFrame:
    return t.events.where("event_id % 20 = 0").select(F.col("event_id").alias("query_id"), _state().alias("state"))


def _candidates(t: Tables) -> DataFrame:
    return _states(t).select("query_id", F.explode(F.array(*(F.lit(f"a{k}") for k in range(4)))).alias("action"), (F.col("query_id") % 7 / 10).alias("logit"))


# the ten latest cases of the same state: of two tokens each, only equal ones have a similarity of 0.95
NEAR = f"""near AS (SELECT query_id, action, return_value FROM (SELECT q.query_id, m.*, row_number() OVER (PARTITION BY q.query_id ORDER BY m.step DESC) AS k
FROM (SELECT event_id AS query_id, {STATE} AS state FROM events WHERE event_id % 20 = 0) q JOIN (SELECT event_id AS step, {STATE} AS state, 'a' || event_id % 3 AS action, value AS return_value FROM events WHERE event_id % 20 <> 0) m USING (state)) WHERE k <= 10),
base AS (SELECT event_id AS query_id, {STATE} AS state, unnest(['a0', 'a1', 'a2', 'a3']) AS action, event_id % 7 / 10 AS logit FROM events WHERE event_id % 20 = 0),
sv AS (SELECT query_id, avg(return_value) AS v, stddev_pop(return_value) AS dev, count(*) AS n FROM near GROUP BY query_id), qa AS (SELECT query_id, action, avg(return_value) AS q FROM near GROUP BY ALL),
adv AS (SELECT b.*, n, dev, CASE WHEN n IS NULL THEN 0 ELSE coalesce(q, 0) - v END AS a FROM base b LEFT JOIN sv USING (query_id) LEFT JOIN qa USING (query_id, action))"""


@query("pol12_logit_correction", f"WITH {NEAR} SELECT query_id, action, round(logit, 6) AS logit, round(a / greatest(max(abs(a)) OVER (PARTITION BY query_id), 1e-8), 6) AS scaled, round(logit + 2 * a / greatest(max(abs(a)) OVER (PARTITION BY query_id), 1e-8), 6) AS corrected FROM adv")
def pol12(t: Tables) -> DataFrame:
    near = memory.neighbours(_states(t), _memory(t), "query_id", 0.95, 10)
    d = memory.corrected_logits(_candidates(t), near, "query_id", 2.0)
    return d.select("query_id", "action", *(r6(F.col(c)).alias(c) for c in ("logit", "scaled", "corrected")))


ENTRIES = [("e1", "click u1", "a0", 1.0, 0.9, True), ("e2", "view u2", "a1", 0.5, 0.7, True), ("e3", "click", "a2", -0.5, 0.6, True), ("e4", "view", "a0", 0.5, 0.6, False), ("e5", "purchase", "zz", 0.5, 0.6, True)]
RULE_BASE = [("r1", "click", "a1", "recommend", 1.0, 0.8, True, False), ("r2", "purchase", "a3", "forbid", 1.0, 0.9, True, False), ("r3", "purchase", "a2", "forbid", 1.0, 1.0, True, True), ("r4", "view", "a2", "recommend", 1.0, 1.0, False, False)]


def _tokens_of(state: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in state.split()) + "]"


def _signal(name: str, rows: list[tuple]) -> str:
    """SQL of a source's signals; rows are (tokens, action, score, confidence, enabled, hard)."""
    values = ", ".join(f"({k}, {_tokens_of(s)}, '{a}', {x}, {c}, {on}, {hard})" for k, (s, a, x, c, on, hard) in enumerate(rows))
    return f"""{name}_e(e, w, action, score, conf, enabled, hard) AS (VALUES {values}),
{name}_m AS (SELECT b.query_id, b.action, sim, score, conf, hard FROM (SELECT b.query_id, b.action, e.*, len(list_intersect(w, string_split(state, ' '))) / len(list_distinct(list_concat(w, string_split(state, ' '))))::DOUBLE AS sim FROM base b JOIN {name}_e e ON e.action = b.action AND enabled) b WHERE sim >= 0.3),
{name}_r AS (SELECT b.query_id, b.action, coalesce(sum(CASE WHEN hard THEN 0 ELSE sim * score END), 0) AS raw, coalesce(bool_or(hard), false) AS blocked, sum(sim) AS w, sum(sim * conf) AS wc FROM base b LEFT JOIN {name}_m m USING (query_id, action) GROUP BY ALL),
{name}_c AS (SELECT *, raw - avg(raw) OVER p AS cent, coalesce(sum(wc) OVER p / sum(w) OVER p, 0) AS trust FROM {name}_r WINDOW p AS (PARTITION BY query_id)),
{name} AS (SELECT query_id, action, blocked, trust, cent / greatest(max(abs(cent)) OVER (PARTITION BY query_id), 1e-8) AS s FROM {name}_c)"""


SUPPORT_ROWS = [(s, a, x, c, on, False) for _, s, a, x, c, on in ENTRIES]
RULE_ROWS = [(s, a, x if effect == "recommend" else -x, c, on, hard and effect == "forbid") for _, s, a, effect, x, c, on, hard in RULE_BASE]


@query(
    "pol13_three_sources",
    f"""WITH {NEAR}, {_signal("support", SUPPORT_ROWS)}, {_signal("rules", RULE_ROWS)},
cc AS (SELECT *, a - avg(a) OVER (PARTITION BY query_id) AS cent FROM adv),
cs AS (SELECT query_id, action, logit, CASE WHEN n IS NULL THEN 0 ELSE 2 * 1 / (1 + dev) * least(1, n / 4.0) * cent / greatest(max(abs(cent)) OVER (PARTITION BY query_id), 1e-8) END AS cases FROM cc)
SELECT query_id, action, round(cases, 6) AS cases, round(s.trust * s.s, 6) AS support, round(r.trust * r.s, 6) AS rules, round(CASE WHEN s.blocked OR r.blocked THEN -1e9 ELSE logit + cases + s.trust * s.s + r.trust * r.s END, 6) AS corrected
FROM cs JOIN support s USING (query_id, action) JOIN rules r USING (query_id, action)""",
)
def pol13(t: Tables) -> DataFrame:
    entries = t.spark.createDataFrame(ENTRIES, "entry_id string, state string, action string, score double, confidence double, enabled boolean")
    rules = memory.rule_entries(t.spark.createDataFrame(RULE_BASE, "entry_id string, state string, action string, effect string, strength double, confidence double, enabled boolean, hard boolean"))
    states, base = _states(t), _candidates(t)
    signals = {
        "cases": (2.0, memory.case_signal(base, memory.neighbours(states, _memory(t), "query_id", 0.95, 10), "query_id")),
        "support": (1.0, memory.matched_signal(base, states, entries, "query_id", "entry_id", 0.3)),
        "rules": (1.0, memory.matched_signal(base, states, rules, "query_id", "entry_id", 0.3)),
    }
    d = memory.three_sources(base, signals, "query_id")
    return d.select("query_id", "action", *(r6(F.col(c)).alias(c) for c in ("cases", "support", "rules", "corrected")))


STATE_WORDS = "list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))"


@query(
    "jon08_weighted_matching",
    f"""WITH s AS (SELECT doc_id, {STATE_WORDS} AS w FROM documents WHERE doc_id % 20 = 0), e AS (SELECT item_id, 'a' || item_id % 3 AS action, (item_id % 5 - 2) / 2 AS score, item_id % 10 / 10 AS conf, {STATE_WORDS} AS w FROM benchmark WHERE item_id % 9 <> 0),
m AS (SELECT doc_id, action, score, conf, len(list_intersect(s.w, e.w)) / (len(s.w) + len(e.w) - len(list_intersect(s.w, e.w)))::DOUBLE AS sim FROM s, e),
b AS (SELECT doc_id, unnest(['a0', 'a1', 'a2', 'a3']) AS action FROM s),
r AS (SELECT b.doc_id, b.action, coalesce(sum(sim * score), 0) AS raw, count(sim) AS n, sum(sim) AS w, sum(sim * conf) AS wc FROM b LEFT JOIN m ON m.doc_id = b.doc_id AND m.action = b.action AND sim >= 0.1 GROUP BY ALL),
c AS (SELECT *, raw - avg(raw) OVER p AS cent, coalesce(sum(wc) OVER p / sum(w) OVER p, 0) AS trust, (sum(n) OVER p)::BIGINT AS n_matched FROM r WINDOW p AS (PARTITION BY doc_id))
SELECT doc_id, action, round(cent / greatest(max(abs(cent)) OVER (PARTITION BY doc_id), 1e-8), 6) AS signal, round(trust, 6) AS confidence, n_matched FROM c""",
)
def jon08(t: Tables) -> DataFrame:
    entries = t.benchmark.select(F.col("item_id").alias("entry_id"), F.col("text").alias("state"), F.concat(F.lit("a"), (F.col("item_id") % 3).cast("string")).alias("action"), ((F.col("item_id") % 5 - 2) / 2).alias("score"), (F.col("item_id") % 10 / 10).alias("confidence"), (F.col("item_id") % 9 != 0).alias("enabled"))
    states = t.documents.where("doc_id % 20 = 0").select("doc_id", F.col("text").alias("state"))
    base = states.select("doc_id", F.explode(F.array(*(F.lit(f"a{k}") for k in range(4)))).alias("action"))
    d = memory.matched_signal(base, states, entries, "doc_id", "entry_id", 0.1)
    return d.select("doc_id", "action", r6(F.col("signal")).alias("signal"), r6(F.col("confidence")).alias("confidence"), long("n_matched").alias("n_matched"))


@query("pol14_rule_table", "SELECT p_partkey AS rule_id, p_partkey NOT IN (1, 2) AS enabled FROM part WHERE p_partkey <> 3")
def pol14(t: Tables) -> DataFrame:
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), F.lit(True).alias("enabled"))
    return policy.set_rules(policy.set_rules(rules, [1, 2], False), [3], None)


@query("pol15_answer_context", "SELECT p_brand, string_agg(p_partkey || ': ' || p_name, chr(10) ORDER BY p_partkey) AS context FROM part WHERE p_size = 7 GROUP BY p_brand")
def pol15(t: Tables) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", F.format_string("%d: %s", "p_partkey", "p_name").alias("line"))))
    return t.part.where("p_size = 7").groupBy("p_brand").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
