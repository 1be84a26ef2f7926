"""Queries of aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, scores, text
from ..operators import calibration, memory, metrics, selection, series, stats
from .base import EVENTS, LANGS, NORMAL, RESPONSES, SCORED, Tables, events, h, long, query, r6, responses, scored

DECISIONS = ["PASS", "REVIEW", "REJECT"]


@query(
    "agg01_scorecard",
    f"""WITH d AS (SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY sha256({NORMAL}) ORDER BY doc_id) AS k FROM documents),
j AS (SELECT d.*, s.correct FROM d JOIN {SCORED} s USING (doc_id) WHERE k = 1)
SELECT grouping(lang)::INTEGER AS g_lang, grouping(source)::INTEGER AS g_source, lang, source, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(length(text)), 6) AS mean_chars, max(length(text))::BIGINT AS max_chars
FROM j GROUP BY GROUPING SETS ((), (lang), (source))""",
)
def agg01(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", F.length("text").alias("chars"), F.sha2(text.body(F.col("text")), 256).alias("_t"))
    first = d.groupBy("_t").agg(F.min_by(F.struct("doc_id", "lang", "source", "chars"), "doc_id").alias("r")).select("r.*")
    j = first.join(scored(t).select("doc_id", "correct"), "doc_id")
    s = metrics.scorecard(j, ["lang", "source"], F.col("correct"), F.col("chars"))
    return s.select("g_lang", "g_source", "lang", "source", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("mean_chars")).alias("mean_chars"), long("max_chars").alias("max_chars"))


@query("agg02_style_scorecard", f"SELECT style, count(*) AS n, round(avg(has::INTEGER), 6) AS format_rate, round(avg(length(response)), 6) AS mean_chars, max(length(response))::BIGINT AS max_chars FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'cot' ELSE 'direct' END AS style, response, contains(response, 'boxed') AS has FROM ({RESPONSES})) GROUP BY style")
def agg02(t: Tables) -> DataFrame:
    d = responses(t).select(F.when(F.col("doc_id") % 2 == 0, "cot").otherwise("direct").alias("style"), "response")
    return d.groupBy("style").agg(F.count("*").alias("n"), r6(F.avg(F.contains("response", F.lit("boxed")).cast("double"))).alias("format_rate"), r6(F.avg(F.length("response"))).alias("mean_chars"), long(F.max(F.length("response"))).alias("max_chars"))


@query("agg03_confusion", f"SELECT gold, coalesce(guess, 'unknown') AS pred, count(*) AS n FROM {SCORED} GROUP BY ALL")
def agg03(t: Tables) -> DataFrame:
    return metrics.confusion(scored(t), "gold", "guess")


@query("agg04_recall", f"SELECT l.label, count(s.gold) AS n, round(coalesce(avg((gold = guess)::INTEGER), 0), 6)::DOUBLE AS recall FROM (VALUES ('PASS'), ('REVIEW'), ('REJECT'), ('OTHER')) l(label) LEFT JOIN {SCORED} s ON s.gold = l.label GROUP BY l.label")
def agg04(t: Tables) -> DataFrame:
    return metrics.recall_by_class(scored(t), "gold", "guess", [*DECISIONS, "OTHER"]).select("label", "n", r6(F.col("recall")).alias("recall"))


F1 = f"(SELECT label, count(*) FILTER (gold = label AND guess = label) AS tp, count(*) FILTER (guess = label AND gold <> label) AS fp, count(*) FILTER (gold = label AND guess <> label) AS fn FROM {SCORED}, (VALUES ('PASS'), ('REVIEW'), ('REJECT'), ('OTHER')) l(label) GROUP BY label)"


@query("agg05_macro_f1", f"SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2e0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM {F1}")
def agg05(t: Tables) -> DataFrame:
    return metrics.macro_f1(scored(t), "gold", "guess", [*DECISIONS, "OTHER"]).select(r6(F.col("macro_f1")).alias("macro_f1"))


@query("agg06_macro_f1_present", f"SELECT round(avg(2e0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM {F1} WHERE tp + fn > 0")
def agg06(t: Tables) -> DataFrame:
    return metrics.macro_f1(scored(t), "gold", "guess").select(r6(F.col("macro_f1")).alias("macro_f1"))


SETS = "(SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN [] ELSE list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) END AS a, CASE WHEN doc_id % 6 = 0 THEN [] ELSE list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{{4,}})', 1)) END AS b FROM documents)"
SET_SCORES = "SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN {e} WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 6) AS p, round(CASE WHEN len(a) + len(b) = 0 THEN {e} WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b)::DOUBLE END, 6) AS r, round(CASE WHEN len(a) + len(b) = 0 THEN {e} ELSE 2e0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM " + SETS


def _sets(t: Tables, empty_is_right: bool) -> DataFrame:
    none = F.array().cast("array<string>")
    a = F.when(F.col("doc_id") % 9 == 0, none).otherwise(text.state_tokens(F.col("text")))
    b = F.when(F.col("doc_id") % 6 == 0, none).otherwise(F.array_distinct(text.all_matches(F.lower("text"), r"([a-z0-9_]{4,})")))
    d = t.documents.select("doc_id", a.alias("a"), b.alias("b"))
    p, r, f1 = arrays.set_scores(F.col("a"), F.col("b"), empty_is_right)
    return d.select("doc_id", r6(p).alias("p"), r6(r).alias("r"), r6(f1).alias("f1"))


query("agg07_set_f1_empty_right", SET_SCORES.format(e=1))(lambda t: _sets(t, True))
query("agg08_set_f1_empty_wrong", SET_SCORES.format(e=0))(lambda t: _sets(t, False))


@query("agg09_ece", f"SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM (SELECT least(floor(conf * 10), 9) AS b, count(*) AS n, avg(conf) AS c, avg(correct) AS a FROM {SCORED} GROUP BY b)")
def agg09(t: Tables) -> DataFrame:
    return calibration.ece(scored(t), "conf", "correct").select(r6(F.col("ece")).alias("ece"))


CLAMPED = "greatest(1e-6, least(1 - 1e-6, conf))"


@query("agg10_proper_scores", f"SELECT round(avg(power(conf - correct, 2)), 6) AS brier, round(avg(-CASE WHEN correct = 1 THEN ln({CLAMPED}) ELSE ln(1 - {CLAMPED}) END), 6) AS nll FROM {SCORED}")
def agg10(t: Tables) -> DataFrame:
    return calibration.proper_scores(scored(t), "conf", "correct").select(r6(F.col("brier")).alias("brier"), r6(F.col("nll")).alias("nll"))


@query("agg11_aurc", f"SELECT round(avg(e / k::DOUBLE), 6) AS aurc FROM (SELECT sum(1 - correct) OVER (ORDER BY conf DESC, doc_id ROWS UNBOUNDED PRECEDING) AS e, row_number() OVER (ORDER BY conf DESC, doc_id) AS k FROM {SCORED})")
def agg11(t: Tables) -> DataFrame:
    return calibration.aurc(scored(t), "conf", "correct", "doc_id").select(r6(F.col("aurc")).alias("aurc"))


@query("agg12_auroc", f"SELECT round((sum(r) FILTER (correct = 1) - sum(correct) * (sum(correct) + 1) / 2e0) / (sum(correct) * (count(*) - sum(correct))), 6) AS auroc FROM (SELECT correct, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2e0 AS r FROM {SCORED})")
def agg12(t: Tables) -> DataFrame:
    return calibration.auroc(scored(t), "conf", "correct").select(r6(F.col("auroc")).alias("auroc"))


@query("agg13_selective", f"SELECT round(avg(({CLAMPED} >= 0.7)::INTEGER), 6) AS coverage, round(avg(1 - correct) FILTER ({CLAMPED} >= 0.7), 6) AS risk FROM {SCORED}")
def agg13(t: Tables) -> DataFrame:
    return calibration.selective(scored(t), "conf", "correct", 0.7).select(r6(F.col("coverage")).alias("coverage"), r6(F.col("risk")).alias("risk"))


BY_THRESHOLD = f"(SELECT conf AS threshold, sum(count(*)) OVER (ORDER BY conf DESC) AS n, sum(sum(1 - correct)) OVER (ORDER BY conf DESC) AS errors FROM {SCORED} GROUP BY conf)"


@query(
    "agg14_risk_threshold",
    f"""WITH good AS (SELECT *, (SELECT count(*) FROM {SCORED}) AS total FROM {BY_THRESHOLD} WHERE errors / n::DOUBLE <= 0.25),
best AS (SELECT * FROM good WHERE n >= 0.1 * total ORDER BY n DESC, threshold LIMIT 1)
SELECT round(coalesce(max(threshold), 1.0), 6) AS threshold, round(coalesce(max(n / total::DOUBLE), 0), 6) AS coverage, round(max(errors / n::DOUBLE), 6) AS risk FROM best""",
)
def agg14(t: Tables) -> DataFrame:
    return calibration.risk_threshold(scored(t), "conf", "correct", 0.25).select(*(r6(F.col(c)).alias(c) for c in ("threshold", "coverage", "risk")))


@query(
    "agg15_route_thresholds",
    f"""WITH q AS (SELECT count(*) AS total, quantile_cont(conf, 0.2) AS q20, quantile_cont(conf, 0.3) AS q30, quantile_cont(conf, 0.75) AS q75, quantile_cont(conf, 0.8) AS q80 FROM {SCORED}),
f AS (SELECT min(threshold) AS found FROM {BY_THRESHOLD}, q WHERE n >= greatest(5, ceil(total * 0.1)) AND 1 - errors / n::DOUBLE >= 0.72),
d AS (SELECT *, coalesce(found, q75) AS high FROM q, f)
SELECT round(CASE WHEN q30 >= high THEN q80 ELSE high END, 6) AS high, round(CASE WHEN q30 >= high THEN q20 ELSE q30 END, 6) AS low FROM d""",
)
def agg15(t: Tables) -> DataFrame:
    return calibration.route_thresholds(scored(t), "conf", "correct", 0.72).select(r6(F.col("high")).alias("high"), r6(F.col("low")).alias("low"))


@query(
    "agg16_balanced_threshold",
    f"""WITH s AS (SELECT conf AS threshold, sum(correct) AS p, count(*) AS n FROM {SCORED} GROUP BY conf),
c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n - p) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS p, sum(n - p) OVER () AS q FROM s),
a AS (SELECT * FROM c WHERE threshold <> 0 UNION ALL SELECT 0, 0, 0, max(p), max(q) FROM c),
b AS (SELECT threshold, 0.5 * (tp / p::DOUBLE + (q - fp) / q::DOUBLE) AS balanced FROM a)
SELECT round(threshold, 6) AS threshold, round(balanced, 6) AS balanced FROM b ORDER BY round(balanced, 12) DESC, threshold LIMIT 1""",
)
def agg16(t: Tables) -> DataFrame:
    return calibration.balanced_threshold(scored(t), "conf", "correct").select(r6(F.col("threshold")).alias("threshold"), r6(F.col("balanced")).alias("balanced"))


@query("agg17_conformal_quantile", f"SELECT round(s, 6) AS quantile FROM (SELECT 1 - conf AS s, row_number() OVER (ORDER BY 1 - conf) AS k, count(*) OVER () AS n FROM {SCORED}) WHERE k = least(n, ceil((n + 1) * 0.9 - 1e-9))")
def agg17(t: Tables) -> DataFrame:
    return calibration.conformal_quantile(scored(t), 1 - F.col("conf"), 0.1).select(r6(F.col("quantile")).alias("quantile"))


@query("agg18_conformal_set", f"SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s, ',') ELSE CASE WHEN a >= b THEN 'PASS' ELSE 'REJECT' END END AS labels FROM (SELECT doc_id, a, b, list_filter([CASE WHEN 1 - a <= 0.4 + 1e-12 THEN 'PASS' END, CASE WHEN 1 - b <= 0.4 + 1e-12 THEN 'REJECT' END], lambda x: x IS NOT NULL) AS s FROM (SELECT doc_id, conf AS a, 0.9 - conf / 2 AS b FROM {SCORED}))")
def agg18(t: Tables) -> DataFrame:
    s = calibration.conformal_set({"PASS": F.col("conf"), "REJECT": 0.9 - F.col("conf") / 2}, F.lit(0.4))
    return scored(t).select("doc_id", F.array_join(s, ",").alias("labels"))


@query("agg19_smoothed_probability", f"SELECT gold, guess, round((count(*) + 0.15) / (sum(count(*)) OVER (PARTITION BY gold) + 0.45), 6)::DOUBLE AS p FROM {SCORED} GROUP BY gold, guess")
def agg19(t: Tables) -> DataFrame:
    d = scored(t).groupBy("gold", "guess").agg(F.count("*").alias("k"))
    return d.select("gold", "guess", r6(calibration.smoothed(F.col("k"), F.sum("k").over(W.partitionBy("gold")))).alias("p"))


@query("agg20_vote", "SELECT user_id, event_type, votes, n FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1")
def agg20(t: Tables) -> DataFrame:
    return metrics.votes(t.events, "user_id", "event_type", "event_id").select("user_id", "event_type", "votes", "n")


@query("agg21_entropy", "SELECT user_id, sum(k)::BIGINT AS n, round(CASE WHEN sum(k) > 1 THEN greatest((ln(sum(k)) - sum(k * ln(k)) / sum(k)) / ln(sum(k)), 0) ELSE 0 END, 6) AS entropy FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) GROUP BY user_id")
def agg21(t: Tables) -> DataFrame:
    return metrics.semantic_entropy(t.events, "user_id", F.col("event_type")).select("user_id", "n", r6(F.col("entropy")).alias("entropy"))


@query(
    "agg22_reliability_features",
    """WITH c AS (SELECT user_id, event_type, count(*) AS k, avg(value) AS m FROM events GROUP BY ALL)
SELECT user_id, sum(k)::BIGINT AS n, count(*) AS clusters, round(max(k) / sum(k)::DOUBLE, 6) AS agreement, round(sum(k * m) / sum(k), 6) AS mean_value, (count(*) > 1) AS conflict, round(1 - count(*) / sum(k)::DOUBLE, 6) AS redundancy FROM c GROUP BY user_id""",
)
def agg22(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("k"), F.avg("value").alias("m"))
    return c.groupBy("user_id").agg(F.sum("k").alias("n"), F.count("*").alias("clusters"), r6(F.max("k") / F.sum("k")).alias("agreement"), r6(F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("mean_value"), (F.count("*") > 1).alias("conflict"), r6(1 - F.count("*") / F.sum("k")).alias("redundancy"))


@query("agg23_quantile_linear", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def agg23(t: Tables) -> DataFrame:
    d = selection.quantiles(t.events, ["event_type"], "value", {"p50": selection.linear(0.5), "p95": selection.linear(0.95)})
    return d.select("event_type", r6(F.col("p50")).alias("p50"), r6(F.col("p95")).alias("p95"))


RANKED = "(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"


@query("agg24_quantile_nearest", f"SELECT event_type, round(value, 6) AS p95 FROM {RANKED} WHERE k = greatest(ceil(n * 0.95 - 1e-6), 1)")
def agg24(t: Tables) -> DataFrame:
    return selection.quantiles(t.events, ["event_type"], "value", {"p95": selection.nearest(0.95)}).select("event_type", r6(F.col("p95")).alias("p95"))


@query("agg25_quantile_floor", f"SELECT event_type, round(value, 6) AS p95 FROM {RANKED} WHERE k = least(floor(n * 0.95), n - 1) + 1")
def agg25(t: Tables) -> DataFrame:
    return selection.quantiles(t.events, ["event_type"], "value", {"p95": selection.floor(0.95)}).select("event_type", r6(F.col("p95")).alias("p95"))


@query("agg26_quantile_rounded", f"SELECT event_type, round(value, 6) AS p95 FROM {RANKED} WHERE k = round_even((n - 1) * 0.95::DOUBLE, 0) + 1")
def agg26(t: Tables) -> DataFrame:
    return selection.quantiles(t.events, ["event_type"], "value", {"p95": selection.rounded(0.95)}).select("event_type", r6(F.col("p95")).alias("p95"))


@query("agg27_median", "SELECT lang, round(median(n_chars), 6) AS median FROM documents GROUP BY lang")
def agg27(t: Tables) -> DataFrame:
    return selection.quantiles(t.documents, ["lang"], "n_chars", {"median": selection.linear(0.5)}).select("lang", r6(F.col("median")).alias("median"))


@query("agg28_weighted", "SELECT event_type, round(w, 6) AS weighted_mean, round(v, 4) AS weighted_variance, round(1 / (1 + sqrt(v)), 6) AS agreement FROM (SELECT event_type, sum((1 + event_id % 5) * value) / sum(1 + event_id % 5) AS w, greatest(sum((1 + event_id % 5) * value * value) / sum(1 + event_id % 5) - power(sum((1 + event_id % 5) * value) / sum(1 + event_id % 5), 2), 0) AS v FROM events GROUP BY event_type)")
def agg28(t: Tables) -> DataFrame:
    d = metrics.weighted_moments(t.events.withColumn("weight", 1 + F.col("event_id") % 5), "event_type", "value", "weight")
    return d.select("event_type", r6(F.col("weighted_mean")).alias("weighted_mean"), F.round("weighted_variance", 4).alias("weighted_variance"), r6(F.col("agreement")).alias("agreement"))


@query("agg29_min_max", "SELECT p_partkey, round(CASE WHEN hi > lo THEN (p_retailprice - lo) / (hi - lo) ELSE CASE WHEN p_retailprice > 0 THEN 1 ELSE 0 END END, 6) AS scaled FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_type) AS lo, max(p_retailprice) OVER (PARTITION BY p_type) AS hi FROM part)")
def agg29(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r6(metrics.min_max(F.col("p_retailprice"), W.partitionBy("p_type"))).alias("scaled"))


@query("agg30_max_abs", "SELECT event_id, round(c / greatest(max(abs(c)) OVER (PARTITION BY user_id), 1e-8), 6) AS scaled FROM (SELECT event_id, user_id, value - avg(value) OVER (PARTITION BY user_id) AS c FROM events)")
def agg30(t: Tables) -> DataFrame:
    return metrics.max_abs(t.events, "value", W.partitionBy("user_id"), "scaled").select("event_id", r6(F.col("scaled")).alias("scaled"))


@query("agg31_standardise", "SELECT event_id, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-8 THEN 1 ELSE stddev_pop(value) OVER w END, 5) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def agg31(t: Tables) -> DataFrame:
    return metrics.standardised(t.events.select("event_id", "event_type", "value"), "event_type", "value", "z").select("event_id", F.round("z", 5).alias("z"))


@query("agg32_softmax", "SELECT event_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM (SELECT event_id, user_id, exp((value - max(value) OVER (PARTITION BY user_id)) / 50) AS e FROM events)")
def agg32(t: Tables) -> DataFrame:
    return metrics.softmax(t.events, "value", W.partitionBy("user_id"), "p", 50.0).select("event_id", r6(F.col("p")).alias("p"))


@query("agg33_regression", "SELECT round(avg(power(a - b, 2)), 4) AS mse, round(avg(abs(a - b)), 6) AS mae, round((avg(a * b) - avg(a) * avg(b)) / greatest(stddev_pop(a) * stddev_pop(b), 1e-8), 5) AS pearson, round(avg((round_even(a, 0) = round_even(b, 0))::INTEGER), 6) AS rounded_accuracy FROM (SELECT l_quantity::DOUBLE AS a, l_extendedprice / 1000 AS b FROM lineitem)")
def agg33(t: Tables) -> DataFrame:
    d = metrics.regression(t.lineitem.select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b")), "a", "b")
    return d.select(F.round("mse", 4).alias("mse"), r6(F.col("mae")).alias("mae"), F.round("pearson", 5).alias("pearson"), r6(F.col("rounded_accuracy")).alias("rounded_accuracy"))


@query("agg34_advantage", f"SELECT event_id, round(greatest(-1, least(1, a / (stddev_pop(a) OVER (PARTITION BY user_id, day) + 1e-6))), 5) AS advantage FROM (SELECT event_id, user_id, day, CASE WHEN count(*) OVER w > 1 THEN value - (sum(value) OVER w - value) / (count(*) OVER w - 1) ELSE 0 END AS a FROM {EVENTS} WINDOW w AS (PARTITION BY user_id, day))")
def agg34(t: Tables) -> DataFrame:
    return metrics.group_advantage(events(t), ["user_id", "day"], "value").select("event_id", F.round("advantage", 5).alias("advantage"))


@query("agg35_reward_sum", f"SELECT doc_id, round(correct + 0.3 * conf, 6) AS reward, round(correct + 0.3 * CASE WHEN doc_id % 3 <> 0 THEN conf END, 6) AS masked FROM {SCORED}")
def agg35(t: Tables) -> DataFrame:
    hit, c = (1.0, F.col("correct")), F.col("conf")
    return scored(t).select("doc_id", r6(scores.reward_sum({"a": hit, "c": (0.3, c)})).alias("reward"), r6(scores.reward_sum({"a": hit, "c": (0.3, F.when(F.col("doc_id") % 3 != 0, c))})).alias("masked"))


@query("agg37_experiment_summary", f"""WITH e AS (SELECT event_type AS setting, user_id % 3 AS seed, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) - 1 AS episode, value > 50 AS ok, value FROM events),
p AS (SELECT setting, seed, avg(ok::INTEGER) AS success, avg(ok::INTEGER) FILTER (episode < 10) AS first, avg(ok::INTEGER) FILTER (episode > last - 10) AS last, min(episode) FILTER (ok) AS fs, avg(value) AS reward FROM (SELECT *, max(episode) OVER (PARTITION BY setting, seed) AS last FROM e) GROUP BY ALL)
SELECT setting, count(*) AS n_seeds, round(avg(success), 6) AS success_rate, round(avg(first), 6) AS first_rate, round(avg(last), 6) AS last_rate, round(avg(fs), 6) AS first_success, round(avg(reward), 6) AS mean_reward FROM p GROUP BY setting""")
def agg37(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("setting"), (F.col("user_id") % 3).alias("seed"), "event_id", "value")
    e = e.withColumns({"episode": F.row_number().over(W.partitionBy("setting", "seed").orderBy("event_id")) - 1, "ok": F.col("value") > 50})
    d = series.experiment_summary(e, "setting", "seed", "episode", "ok", "value")
    return d.select("setting", "n_seeds", *(r6(F.col(c)).alias(c) for c in ("success_rate", "first_rate", "last_rate", "first_success", "mean_reward")))


@query(
    "agg38_method_scorecard",
    f"""SELECT method, count(*) AS n, round(avg((gold = guess)::INTEGER), 6) AS accuracy, round(avg(ok::INTEGER), 6) AS coverage, round(avg((gold <> guess)::INTEGER) FILTER (ok), 6) AS risk, round(avg(power(conf - (gold = guess)::INTEGER, 2)), 6) AS brier, round(avg((guess = 'REVIEW')::INTEGER), 6) AS review_rate
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'direct' ELSE 'search' END AS method, conf >= 0.5 AS ok FROM {SCORED}) GROUP BY method""",
)
def agg38(t: Tables) -> DataFrame:
    right = (F.col("gold") == F.col("guess")).cast("double")
    ok = F.col("conf") >= 0.5
    d = scored(t).withColumn("method", F.when(F.col("doc_id") % 2 == 0, "direct").otherwise("search"))
    return d.groupBy("method").agg(F.count("*").alias("n"), r6(F.avg(right)).alias("accuracy"), r6(F.avg(ok.cast("double"))).alias("coverage"), r6(F.avg(F.when(ok, 1 - right))).alias("risk"), r6(F.avg(scores.brier(F.col("conf"), right))).alias("brier"), r6(F.avg((F.col("guess") == "REVIEW").cast("double"))).alias("review_rate"))


@query(
    "agg39_failure_attribution",
    f"""WITH c AS (SELECT doc_id, unnest([{{'category': 'wrong', 'applicable': true, 'failed': pred <> quality}}, {{'category': 'overconfident', 'applicable': conf >= 0.8, 'failed': pred <> quality}}, {{'category': 'toxic_passed', 'applicable': toxic = 1, 'failed': guess = 'PASS'}}], recursive := true) FROM {SCORED}),
a AS (SELECT category, count(*) AS applicable, count(*) FILTER (failed) AS failures FROM c WHERE applicable GROUP BY category),
x AS (SELECT category, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k FROM c WHERE applicable AND failed) WHERE k <= 5 GROUP BY category)
SELECT category, applicable, failures, round(failures / applicable::DOUBLE, 6) AS rate, coalesce(examples, '') AS examples FROM a LEFT JOIN x USING (category)""",
)
def agg39(t: Tables) -> DataFrame:
    wrong = F.col("pred") != F.col("quality")
    cases = {"wrong": (F.lit(True), wrong), "overconfident": (F.col("conf") >= 0.8, wrong), "toxic_passed": (F.col("toxic") == 1, F.col("guess") == "PASS")}
    return metrics.attribution(scored(t), cases, "doc_id").withColumn("rate", r6(F.col("rate")))


@query("agg40_agent_summary", "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, round(avg(length(text)), 6) AS mean_chars, round(avg(contains(text, '?')::INTEGER), 6) AS asking FROM conversations GROUP BY role")
def agg40(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("n_turns"), F.count_distinct("conv_id").alias("n_conversations"), r6(F.avg(F.length("text"))).alias("mean_chars"), r6(F.avg(F.contains("text", F.lit("?")).cast("double"))).alias("asking"))


@query("agg41_task_weighted_mean", "SELECT round(avg(m), 6) AS score FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type)")
def agg41(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.avg("value").alias("m")).agg(r6(F.avg("m")).alias("score"))


ODD = "CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 77 = 0 THEN 'Infinity'::DOUBLE ELSE value END"


@query("agg42_training_health", f"SELECT count(*) AS n, round(avg(x) FILTER (isfinite(x)), 6) AS mean, count(*) FILTER (NOT coalesce(isfinite(x), false)) AS non_finite, round(max(x) FILTER (isfinite(x)), 6) AS largest, (SELECT event_id FROM (SELECT event_id, {ODD} AS x FROM events) WHERE isfinite(x) ORDER BY x DESC, event_id LIMIT 1) AS largest_step, count(*) FILTER (isfinite(x) AND x > 90) AS over FROM (SELECT event_id, {ODD} AS x FROM events)")
def agg42(t: Tables) -> DataFrame:
    e = F.col("event_id")
    d = t.events.select("event_id", F.when(e % 50 == 0, float("nan")).when(e % 77 == 0, float("inf")).otherwise(F.col("value")).alias("x"))
    return metrics.finite_summary(d, "x", "event_id", 90.0).select("n", r6(F.col("mean")).alias("mean"), "non_finite", r6(F.col("largest")).alias("largest"), "largest_step", "over")


@query("agg43_dynamic_metrics", "SELECT 'rewards/' || event_type || '/mean' AS metric, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type UNION ALL SELECT 'loss', count(*), round(avg(value / 2), 6) FROM events")
def agg43(t: Tables) -> DataFrame:
    m = F.create_map(F.concat(F.lit("rewards/"), "event_type", F.lit("/mean")), F.col("value"), F.lit("loss"), F.col("value") / 2)
    return metrics.key_means(t.events.select(m.alias("m")), "m").select("metric", "n", r6(F.col("mean")).alias("mean"))


@query("agg44_extremes", "SELECT round(min_by(value, event_id), 6) AS first_loss, round(max_by(value, event_id), 6) AS last_loss, round(min(value), 6) AS best_loss, (SELECT event_id FROM events ORDER BY value, event_id LIMIT 1) AS best_step FROM events")
def agg44(t: Tables) -> DataFrame:
    d = series.extremes(t.events, "event_id", "value")
    return d.select(*(r6(F.col(c)).alias(c) for c in ("first_loss", "last_loss", "best_loss")), "best_step")


@query("agg45_paired_bootstrap")
def agg45(t: Tables) -> DataFrame:
    d = scored(t).select("doc_id", (F.col("correct") - 0.5).alias("accuracy"), (F.col("conf") - 0.5).alias("confidence"))
    return stats.bootstrap(d, ["accuracy", "confidence"], "doc_id", 2000)


@query(
    "agg46_mcnemar",
    f"""WITH c AS (SELECT count(*) FILTER (conf <= 0.5 AND correct = 1) AS improved, count(*) FILTER (conf > 0.5 AND correct = 0) AS regressed FROM {SCORED}),
p AS (SELECT improved, regressed, improved + regressed AS n, unnest(range(0, least(improved, regressed) + 1)) AS i FROM c),
t AS (SELECT improved, regressed, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM p GROUP BY improved, regressed)
SELECT improved, regressed, least(1.0, 2 * tail) AS p_value FROM t""",
)
def agg46(t: Tables) -> DataFrame:
    found = stats.mcnemar(scored(t).select((F.col("conf") > 0.5).alias("a"), (F.col("correct") == 1).alias("b")), "a", "b")
    return t.spark.createDataFrame([tuple(found.values())], "improved long, regressed long, p_value double")


@query("agg47_platt")
def agg47(t: Tables) -> DataFrame:
    d = scored(t)
    model = calibration.fit_platt(d.withColumn("score", F.col("conf")), "score", "correct", 500)
    return d.select("doc_id", calibration.predict_platt(F.col("conf"), model).alias("p"))


@query("agg48_logistic")
def agg48(t: Tables) -> DataFrame:
    d = scored(t).join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("chars", F.col("n_chars").cast("double"))
    model = calibration.fit_logistic(d, ["conf", "chars"], "correct", 500)
    return d.select("doc_id", calibration.predict_logistic([F.col("conf"), F.col("chars")], model).alias("p"))


CASES = "(SELECT event_type AS state, 'a' || user_id % 4 AS action, value FROM events)"


@query(
    "agg49_condense",
    f"""WITH g AS (SELECT state, action, avg(value) AS mean, count(*) AS n FROM {CASES} GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY state) AS total, row_number() OVER w AS k, lead(mean) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY state ORDER BY round(mean, 9) DESC, action))
SELECT 'condensed_' || sha1(state)[1:10] AS rule_id, state, action, round(mean, 6) AS mean, total::BIGINT AS evidence_count, round(least(0.95, 0.5 + 0.05 * n), 6) AS confidence FROM r WHERE k = 1 AND total >= 5 AND nxt IS NOT NULL AND n >= 2 AND mean - nxt >= 0.1""",
)
def agg49(t: Tables) -> DataFrame:
    cases = t.events.select(F.col("event_type").alias("state"), F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("action"), "value")
    return memory.condense(cases, "state", "action", "value").withColumns({"mean": r6(F.col("mean")), "confidence": r6(F.col("confidence"))})


@query("agg50_text_dedup", f"SELECT sum(k)::BIGINT AS n_rows, count(*) AS n_unique, count(*) FILTER (labels > 1) AS n_conflict, (sum(k) - count(*) FILTER (labels = 1))::BIGINT AS n_removed FROM (SELECT count(*) AS k, count(DISTINCT source) AS labels FROM documents GROUP BY {NORMAL})")
def agg50(t: Tables) -> DataFrame:
    return metrics.dedup_counts(t.documents, text.body(F.col("text")), "source")


@query("agg51_document_frequency", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS token FROM documents), d AS (SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY token) SELECT token, df, cf, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS idf FROM d WHERE df >= 20")
def agg51(t: Tables) -> DataFrame:
    from ..operators.retrieval import postings

    p = postings(t.documents, "doc_id", text.words(F.col("text")))
    d = p.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 20")
    n = t.documents.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("token", "df", "cf", r6(F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))


@query("agg52_format_coverage", f"SELECT count(*) AS n, count(*) FILTER (contains(response, '<think>')) AS opened, count(*) FILTER (contains(response, '</think>')) AS closed, count(*) FILTER (contains(response, '<think></think>')) AS empty, count(*) FILTER (contains(response, 'boxed{{')) AS boxed, round(avg(length(response)), 6) AS mean_chars FROM ({RESPONSES})")
def agg52(t: Tables) -> DataFrame:
    has = lambda s: F.count_if(F.contains("response", F.lit(s)))
    return responses(t).agg(F.count("*").alias("n"), has("<think>").alias("opened"), has("</think>").alias("closed"), has("<think></think>").alias("empty"), has("boxed{").alias("boxed"), r6(F.avg(F.length("response"))).alias("mean_chars"))


@query("agg53_resources", "SELECT lang, count(*) AS calls, sum(n_chars // 4)::BIGINT AS tokens, round(sum(n_chars // 4 / 1e3 * 0.02), 6) AS cost FROM documents GROUP BY lang")
def agg53(t: Tables) -> DataFrame:
    tokens = F.expr("n_chars div 4")
    return t.documents.groupBy("lang").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), r6(F.sum(tokens / 1000 * 0.02)).alias("cost"))


@query("agg54_category_vote", "WITH r AS (SELECT p_brand, p_type, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), s AS (SELECT p_brand, p_type, sum(p_size / rank::DOUBLE) AS w FROM r WHERE rank <= 10 GROUP BY ALL) SELECT p_brand, p_type, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(w, 9) DESC, p_type DESC) AS k FROM s) WHERE k = 1")
def agg54(t: Tables) -> DataFrame:
    from ..operators.retrieval import category_vote, top_k

    ranked = top_k(t.part, "p_brand", 10, F.col("p_retailprice").desc(), F.col("p_partkey"))
    return category_vote(ranked, "p_brand", "p_type", "p_size").withColumn("weight", r6(F.col("weight")))


@query("agg55_verdict_rates", f"SELECT toxic, count(*) AS n, round(avg(((conf > 0.5) = (correct = 1))::INTEGER), 6) AS accuracy, round(avg((conf <= 0.5)::INTEGER), 6) AS detected FROM {SCORED} GROUP BY toxic")
def agg55(t: Tables) -> DataFrame:
    return scored(t).groupBy("toxic").agg(F.count("*").alias("n"), r6(F.avg(((F.col("conf") > 0.5) == (F.col("correct") == 1)).cast("double"))).alias("accuracy"), r6(F.avg((F.col("conf") <= 0.5).cast("double"))).alias("detected"))


@query("agg56_simulation_summary", "SELECT event_type, round(avg(value), 6) AS mean_reward, round(count(*) / count(DISTINCT user_id)::DOUBLE, 6) AS mean_turns FROM events GROUP BY event_type")
def agg56(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(r6(F.avg("value")).alias("mean_reward"), r6(F.count("*") / F.count_distinct("user_id")).alias("mean_turns"))


@query("agg57_candidate_coverage", f"SELECT count(*) AS n, round(avg((guess = gold)::INTEGER), 6) AS first_hit, round(avg((guess = gold OR second = gold)::INTEGER), 6) AS any_hit, round(avg((second = gold)::INTEGER) FILTER (guess <> gold), 6) AS rescue FROM (SELECT *, ['PASS', 'REVIEW', 'REJECT'][{h("doc_id || 's'", 3)} + 1] AS second FROM {SCORED})")
def agg57(t: Tables) -> DataFrame:
    names = F.array(*(F.lit(x) for x in DECISIONS))
    d = scored(t).withColumn("second", F.element_at(names, (scores.hash_int(F.concat(F.col("doc_id").cast("string"), F.lit("s")), 3) + 1).cast("int")))
    candidates = F.array("guess", "second")
    any_hit = F.exists(candidates, lambda c: c == F.col("gold"))
    return d.agg(F.count("*").alias("n"), r6(F.avg((F.col("guess") == F.col("gold")).cast("double"))).alias("first_hit"), r6(F.avg(any_hit.cast("double"))).alias("any_hit"), r6(F.avg(F.when(F.col("guess") != F.col("gold"), (F.col("second") == F.col("gold")).cast("double")))).alias("rescue"))


@query("agg58_context_scaling", "SELECT size, (sum(length(p_name) + 1) - 1)::BIGINT AS chars FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS k FROM part), (VALUES (10), (50), (100), (200)) s(size) WHERE k <= size GROUP BY size")
def agg58(t: Tables) -> DataFrame:
    first = t.part.orderBy("p_partkey").limit(200).select("p_partkey", "p_name").withColumn("k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p_partkey")))
    sizes = t.spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in (10, 50, 100, 200)))).alias("size"))
    return first.join(F.broadcast(sizes), F.col("k") <= F.col("size")).groupBy("size").agg((F.sum(F.length("p_name") + 1) - 1).alias("chars"))


@query("agg59_rescore", f"SELECT source, count(*) AS n, round(avg((l = lang)::INTEGER), 6) AS accuracy FROM (SELECT source, lang, list_last(regexp_extract_all(response, '(de|en|es|fr)', 1)) AS l FROM ({RESPONSES})) GROUP BY source")
def agg59(t: Tables) -> DataFrame:
    d = responses(t).select("source", "lang", text.last(text.all_matches(F.col("response"), "(de|en|es|fr)")).alias("l"))
    return d.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg((F.col("l") == F.col("lang")).cast("double"))).alias("accuracy"))


@query("agg60_best_checkpoint", "SELECT p_brand AS checkpoint, round(score, 6) AS score FROM (SELECT p_brand, avg(p_retailprice) + avg(p_size) AS score, avg(p_size) AS tie FROM part GROUP BY p_brand) ORDER BY score DESC, tie DESC LIMIT 1")
def agg60(t: Tables) -> DataFrame:
    d = t.part.groupBy("p_brand").agg((F.avg("p_retailprice") + F.avg("p_size")).alias("score"), F.avg("p_size").alias("tie"))
    return d.agg(F.max_by(F.struct("p_brand", "score"), F.struct("score", "tie")).alias("b")).select(F.col("b.p_brand").alias("checkpoint"), r6(F.col("b.score")).alias("score"))
