"""Hand-checked vectors and invariants of the engine's functions and operators."""

import io
import json
import math
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from plumbline import streaming
from plumbline.functions import equations, hashing, scores, text
from plumbline.functions.json import scan_object
from plumbline.operators import calibration, cells, datasets, gates, memory, metrics, ordered, policy, retrieval, selection, series, shape, stats, trajectory
from plumbline.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_text_functions(spark):
    s = F.lit
    r = one(
        spark,
        answer=text.normal_answer(s(" 1,500。")),
        think=text.thinking(s("<think>a</think><think> </think>")),
        box=text.boxed(s("x \\boxed{1} \\boxed{ 2 }")),
        marked=text.boxed(s("because\n#### 72\n")),
        bad=text.confidence(s("<confidence>1.5</confidence>")),
        good=text.confidence(s("<confidence> 0.25 </confidence>")),
        nan=text.confidence(s("<confidence>NaN</confidence>")),
        strict=text.strict_think_box(s("<think>r</think>\\boxed{A}")),
        loose=text.strict_think_box(s("<think>r</think>\\boxed{A}x")),
        same=text.same_number(s("$1,200.0"), s("1200")),
        other=text.same_number(s("12a"), s("12")),
        tokens=text.search_tokens(s("政治a经")),
        empty=text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")),
    )
    assert (r.answer, r.think, r.box, r.marked, r.bad, r.good, r.nan) == ("1500", "a", "2", "72", None, 0.25, None)
    assert r.strict and not r.loose and r.same and not r.other and r.empty == 1.0
    assert r.tokens == ["a", "政治", "经", "政治"]


def test_entry_needs_no_session():
    """Queries and their SQL can be listed before a session exists."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)


def test_clamps_keep_null(spark):
    none = F.lit(None).cast("double")
    r = one(spark, a=scores.sigmoid(none), b=scores.log_reward(none, F.lit(1.0)), c=text.judge_score(F.lit("no score")), d=scores.probability(F.lit(2.0)))
    assert (r.a, r.c) == (None, 0.0) and math.isclose(r.b, math.log(0.01)) and r.d == 1 - 1e-6


def test_equations():
    found = [[holds for _, _, holds in equations.equations(x)] for x in ("3 * 4 = 12", "1/3 + 1/3 = 0.66", "2 + 2 = 5", "10 / 4 = 2.5", "1 = 1", "¥1,200 ÷ 4 = $300", "2 × (3 + 1) = 8", "x3 + 1 = 4")]
    assert found == [[True], [False], [False], [True], [], [True], [True], []]
    question, answer = "A pen is 3 and a book 1,200", "1,203"
    assert equations.calculation("3 + 1200 = 1203", question, answer) == (1, 1, 1.0)
    assert equations.calculation("3 * 2 = 6 and 3 * 3 = 8", question, answer) == (2, 1, 0.375)
    assert equations.calculation("7 + 7 = 14", question, answer) == (0, 0, 0.0)
    assert equations.calculation("600 + 603 = 1203, 3 + 3 = 7", question, answer) == (2, 1, 0.5)
    assert equations.evaluate("__import__('os')") is None and equations.evaluate("1/0") is None and equations.evaluate("9**9") is None
    assert equations.evaluate("+".join(["1"] * 100)) is None


def test_feature_hashing():
    v = hashing.vector(["a", "b", "a"])
    assert len(v) == 256 and math.isclose(float((v * v).sum()), 1.0) and not hashing.vector([]).any()


def test_tolerant_json():
    assert scan_object('x { {"a": 1} {"decision": {"k": "}"}} z', "decision") == {"decision": {"k": "}"}}
    assert scan_object("{", "a") is None and scan_object(None, "a") is None


def test_discounted_returns(spark):
    d = spark.createDataFrame([(1, 0, 0.5), (1, 1, 2.0), (2, 0, 3.0)], "g int, t int, r double")
    got = {(x.g, x.t): x.discounted for x in series.discounted(d, "g", "t", "r", 0.5).collect()}
    assert got == {(1, 0): 1.5, (1, 1): 2.0, (2, 0): 3.0}


def test_quantile_definitions(spark):
    d = spark.createDataFrame([("a", float(x)) for x in (20, 40, 80, 100)], "g string, v double")
    wanted = {"linear": selection.linear(0.95), "nearest": selection.nearest(0.95), "floor": selection.floor(0.5), "rounded": selection.rounded(0.5)}
    for group_rows in (10, 0):
        r = selection.quantiles(d, ["g"], "v", wanted, group_rows).first()
        assert (round(r.linear, 6), r.nearest, r.floor, r.rounded) == (97.0, 100.0, 80.0, 80.0)


def test_quantiles_of_large_groups(spark):
    """A group with nine tenths of the rows, values over all magnitudes, both signs, zeros, ties, nulls, NaN and infinities."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(3))
    wild = np.concatenate((rng.choice([-1, 1], 3000) * 10.0 ** rng.integers(-300, 300, 3000), rng.normal(5, 1e-9, 3000), np.zeros(700), np.full(900, 5.0), rng.integers(0, 50, 1400), [5e-324, -5e-324, 1.7e308]))
    groups = {"hot": wild, "few": rng.normal(0, 1, 900), None: np.array([3.0, 1.0]), "one": np.array([-0.0, 0.0]), "same": np.full(40, 7.0)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("none", float("nan")), ("few", None)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, v double").repartition(8)
    shares = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    wanted = {f"{kind.__name__}{k}": kind(p) for kind in (selection.linear, selection.nearest, selection.floor, selection.rounded) for k, p in enumerate(shares)}
    got = {r.g: r for r in selection.quantiles(d, ["g"], "v", wanted, 0).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        v, n = np.sort(v), len(v)
        for k, p in enumerate(shares):
            at = p * (n - 1)
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            with np.errstate(over="ignore"):
                assert got[g][f"linear{k}"] == low + (at - np.floor(at)) * (high - low)
            assert got[g][f"nearest{k}"] == v[max(int(np.ceil(n * p - 1e-6)), 1) - 1]
            assert got[g][f"floor{k}"] == v[min(int(np.floor(n * p)), n - 1)]
            assert got[g][f"rounded{k}"] == v[int(np.rint(at))]
    same = {r.g: r for r in selection.quantiles(d, ["g"], "v", wanted).collect()}
    assert same == got


def test_running_sums_of_large_groups(spark):
    """Nine tenths of the rows in one group, nearly all of one value: parts of all groups, none with much more than its share."""
    import random

    from pyspark.sql import Window as W

    rng = random.Random(8)
    rows = [(k, "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), 7 if rng.random() < 0.8 else rng.randrange(100), rng.choice([1, 2, None])) for k in range(20_000)]
    d = spark.createDataFrame(rows, "k long, g string, v long, w long").repartition(5)
    order = [F.col("v").desc(), F.col("k")]
    by = W.partitionBy("g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    want = d.select("k", F.row_number().over(by).alias("place"), F.coalesce(F.sum("w").over(by), F.lit(0)).alias("total"))
    got = ordered.running(d, ["g"], order, {"place": F.lit(1), "total": F.col("w")}, 100, 1500)
    assert got.columns == [*d.columns, "place", "total"]
    assert sorted(map(tuple, got.select("k", "place", "total").collect())) == sorted(map(tuple, want.collect()))
    parts = ordered.parts_of(d, ["g"], order, "part", 14).groupBy("part").count().collect()
    assert len(parts) == 14 and max(r["count"] for r in parts) < 3 * 20_000 / 14
    # rows that are equal in all are parted too
    same = spark.range(9000).select(F.lit(1).alias("g"))
    assert sorted(r.place for r in ordered.running(same, ["g"], [], {"place": F.lit(1)}, 100, 1000).collect()) == list(range(1, 9001))
    whole = ordered.running(d, [], order, {"place": F.lit(1)}, 100, 1500)
    assert sorted(r.place for r in whole.collect()) == list(range(1, 20_001))
    mid = {(r.g, r.v): r.m for r in ordered.mid_ranks(d.select("g", "v"), ["g"], "v", "m", 10, 20).distinct().collect()}
    for g in ("hot", "a", None):
        v = sorted(x[2] for x in rows if x[1] == g)
        assert all(mid[g, x] == v.index(x) + (v.count(x) + 1) / 2 for x in set(v))
    assert ordered.running(d.limit(0), ["g"], order, {"place": F.lit(1)}).count() == ordered.running(d.limit(0), [], order, {"place": F.lit(1)}, -1).count() == 0


def test_risk_threshold(spark):
    d = spark.createDataFrame([(0.95, 1), (0.9, 1), (0.3, 0), (0.2, 0)], "c double, t int")
    r = calibration.risk_threshold(d, "c", "t", 0.0).first()
    assert (r.threshold, r.coverage, r.risk) == (0.9, 0.5, 0.0)
    none = calibration.risk_threshold(d.withColumn("t", F.lit(0)), "c", "t", 0.0).first()
    assert (none.threshold, none.coverage, none.risk) == (1.0, 0.0, None)
    assert calibration.auroc(d, "c", "t").first().auroc == 1.0
    assert calibration.auroc(d.withColumn("t", F.lit(1)), "c", "t").first().auroc is None


def test_platt_single_class(spark):
    d = spark.createDataFrame([(0.1 * k, 1) for k in range(8)], "s double, t int")
    w, b = calibration.fit_platt(d, "s", "t", 50)
    assert w == 0.0 and 0.7 < 1 / (1 + math.exp(-b)) < 1


def test_logistic_learns(spark):
    d = spark.createDataFrame([(float(k), float(-k % 3), int(k > 10)) for k in range(20)], "a double, b double, t int")
    m = calibration.fit_logistic(d, ["a", "b"], "t", 800)
    p = d.select("t", calibration.predict_logistic([F.col("a"), F.col("b")], m).alias("p")).collect()
    assert all((x.p > 0.5) == bool(x.t) for x in p)


def test_softmax_is_reweighting(spark):
    d = spark.createDataFrame([(1, 0.2, 0.5), (1, -0.4, -1.0), (1, 1.0, 0.1)], "g int, z double, a double")
    from pyspark.sql import Window as W

    by = W.partitionBy("g")
    x = metrics.softmax(d.withColumn("zc", F.col("z") + 2 * F.col("a")), "zc", by, "p")
    y = metrics.softmax(d, "z", by, "p0").withColumn("q", F.col("p0") * F.exp(2 * F.col("a"))).withColumn("q", F.col("q") / F.sum("q").over(by))
    assert all(abs(a.p - b.q) < 1e-12 for a, b in zip(x.orderBy("z").collect(), y.orderBy("z").collect(), strict=True))


def test_exceptions_are_bound(spark):
    rows = [(1, 10, "PASS", 5, []), (1, 11, "REJECT", 1, [10]), (1, 12, "REVIEW", 9, []), (2, 10, "PASS", 5, []), (2, 11, "REJECT", 1, [10]), (3, None, None, None, None)]
    d = spark.createDataFrame(rows, "c int, rule_id long, decision string, priority int, exception_ids array<bigint>")
    got = {r.c: (r.decision, r.reason_code) for r in policy.decide(d, "c").collect()}
    assert got == {1: ("REVIEW", "risk"), 2: ("PASS", "all_exempt"), 3: ("REVIEW", "no_rule")}


def test_rule_switches(spark):
    rules = spark.createDataFrame([(1, True), (2, True)], "rule_id long, enabled boolean")
    assert {r.rule_id: r.enabled for r in policy.set_rules(rules, [1], False).collect()} == {1: False, 2: True}
    assert policy.set_rules(rules, [1], None).count() == 1
    with pytest.raises(KeyError):
        policy.set_rules(rules, [3], True)


def test_condensation(spark):
    d = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 0.9), ("s", "a", 0.8), ("s", "b", 0.1), ("s", "b", 0.2), ("s", "c", 0.0), ("t", "a", 1.0)], "state string, action string, v double")
    got = memory.condense(d, "state", "action", "v").collect()
    assert [(r.state, r.action, r.evidence_count, round(r.confidence, 9)) for r in got] == [("s", "a", 6, 0.65)]
    assert got[0].rule_id.startswith("condensed_") and len(got[0].rule_id) == 20
    table = d.limit(0).select(F.lit("x").alias("rule_id"), "state")
    assert memory.upsert(table, memory.condense(d, "state", "action", "v")).count() == 1


def candidates(spark, actions="abc", k=1):
    return spark.createDataFrame([(k, x, 0.0) for x in actions], "k int, action string, logit double")


def test_logits_of_one_memory(spark):
    """Returns 1 and 0 of two neighbours, v = 0.5: an unseen action has q = 0, or v + alpha / n where it is lucky."""
    near = spark.createDataFrame([(1, 1.0, "a", 1.0), (1, 1.0, "b", 0.0)], "k int, similarity double, action string, return_value double")
    base = candidates(spark).unionByName(candidates(spark, "ab", 2))
    got = {(r.k, r.action): r.corrected for r in memory.corrected_logits(base, near, "k", 2.0).collect()}
    assert got == {(1, "a"): 2.0, (1, "b"): -2.0, (1, "c"): -2.0, (2, "a"): 0.0, (2, "b"): 0.0}
    lucky = {r.action: (r.q, r.advantage) for r in memory.advantages(base.where("k = 1"), near, "k", unseen=1.0, alpha=5.0).collect()}
    assert lucky == {"a": (1.0, 0.5), "b": (0.0, -0.5), "c": (3.0, 2.5)}


def test_signal_of_matched_entries(spark):
    """Scores are centred and scaled over the candidates; the confidence is the state's."""
    states = spark.createDataFrame([(1, "x y"), (2, "q"), (3, "")], "k int, state string")
    entries = spark.createDataFrame([("e", "x y", "a", 1.0, 0.9, True), ("f", "x y", "b", 0.5, 0.3, True), ("g", "x y", "a", 9.0, 1.0, False), ("h", "x y", "other", 9.0, 1.0, True), ("i", "", "b", 1.0, 0.4, True)], "e string, state string, action string, score double, confidence double, enabled boolean")
    base = candidates(spark, "ab").unionByName(candidates(spark, "ab", 2)).unionByName(candidates(spark, "ab", 3))
    got = {(r.k, r.action): (r.signal, round(r.confidence, 9), r.n_matched) for r in memory.matched_signal(base, states, entries, "k", "e", 0.5).collect()}
    assert got == {(1, "a"): (1.0, 0.6, 2), (1, "b"): (-1.0, 0.6, 2), (2, "a"): (0.0, 0.0, 0), (2, "b"): (0.0, 0.0, 0), (3, "a"): (-1.0, 0.4, 1), (3, "b"): (1.0, 0.4, 1)}


def test_three_sources(spark):
    """Cases, a support library and rules for one state; hand-computed contributions."""
    base, states = candidates(spark), spark.createDataFrame([(1, "x y")], "k int, state string")
    cases = spark.createDataFrame([(n, "x y", a, v) for n, (a, v) in enumerate([("a", 2.0)] * 2 + [("b", -1.0)] * 2 + [("c", -1.0)] * 2)], "step int, state string, action string, return_value double")
    entries = spark.createDataFrame([("doc1", "x y", "a", 1.0, 0.9, True)], "e string, state string, action string, score double, confidence double, enabled boolean")
    rules = spark.createDataFrame([("soft", "x y", "a", "recommend", 1.0, 0.8, True, False), ("hard", "x y", "c", "forbid", 1.0, 1.0, True, True), ("off", "x y", "b", "recommend", 1.0, 1.0, False, False)], "e string, state string, action string, effect string, strength double, confidence double, enabled boolean, hard boolean")
    near = memory.neighbours(states, cases, "k", 0.95, 10)
    case = {r.action: r for r in memory.case_signal(base, near, "k").collect()}
    # v = 0, advantages 2, -1, -1; deviation sqrt(2); six neighbours cover the four that are asked for
    assert case["a"].n_matched == 6 and math.isclose(case["a"].confidence, 1 / (1 + math.sqrt(2)))
    assert [round(case[x].signal, 9) for x in "abc"] == [1.0, -0.5, -0.5]
    signals = {"cases": (2.0, memory.case_signal(base, near, "k")), "support": (1.0, memory.matched_signal(base, states, entries, "k", "e", 0.95)), "rules": (1.0, memory.matched_signal(base, states, memory.rule_entries(rules), "k", "e", 0.95))}
    trust = 2 / (1 + math.sqrt(2))
    for gated, want in ((True, trust + 0.9 + 0.9), (False, 2 + 1 + 1)):
        got = {r.action: r for r in memory.three_sources(base, signals, "k", gated).collect()}
        assert math.isclose(got["a"].corrected, want) and got["c"].corrected == memory.FORBIDDEN
        assert math.isclose(got["b"].corrected, -want / 2)


def test_mcnemar_and_bootstrap(spark):
    assert stats.mcnemar_p(0, 0) == 1.0 and math.isclose(stats.mcnemar_p(10, 0), 2 / 2**10)
    for a, b in ((3, 9), (40, 60), (500, 420), (7, 7)):
        exact = min(1, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
        assert math.isclose(stats.mcnemar_p(a, b), exact, rel_tol=1e-9)
    assert 0 < stats.mcnemar_p(10**8, 10**8 + 30_000) < 1
    a = spark.createDataFrame([(k, 0.0, 0.1 * (k % 3)) for k in range(60)], "id long, x double, y double")
    b = spark.createDataFrame([(k, float(k % 4 > 0), 0.1 * (k % 3)) for k in range(60)], "id long, x double, y double")
    got = {r.metric: r for r in stats.bootstrap(stats.paired(a, b, "id", ["x", "y"]), ["x", "y"], "id", 1000).collect()}
    assert got["x"].difference == 0.75 and 0.55 < got["x"].low < 0.75 < got["x"].high < 0.95
    assert got["y"].difference == got["y"].low == got["y"].high == 0.0


@pytest.mark.parametrize("rows", [1_000, 10_000, 100_000])
def test_bootstrap_width_at_any_size(spark, rows):
    """Half the interval is 1.96 standard errors, however rows are dealt and however many are alike."""
    d = spark.range(rows).select("id", (F.col("id") % 2).cast("double").alias("x"))
    want = 1.96 * 0.5 / math.sqrt(rows)
    found = []
    for frame in (d.repartition(3), d.coalesce(1)):
        r = stats.bootstrap(frame, ["x"], "id", 2000).first()
        found.append((round(r.low, 9), round(r.high, 9)))
        assert 0.9 < (r.high - r.low) / 2 / want < 1.1
    assert found[0] == found[1]


def test_trajectory_rewards(spark):
    p = trajectory.Protocol({"look": 0.5, "end": 1.0}, final="end", max_steps=3)
    clean = [(1, 0, "look", 1.0), (1, 1, "end", 1.0), (1, 2, "look", 1.0)]
    noisy = [(2, 0, "what", 1.0), (2, 1, "look", 1.0), (2, 2, "look", 1.0)]
    d = spark.createDataFrame(clean + noisy, "k long, t long, a string, v double")
    got = {r.k: r for r in trajectory.replay(d, p, "k", "t", "a", "v").collect()}
    assert (got[1].steps, got[1].total_reward, got[1].done) == (2, 1.5, True)
    assert got[2].done and got[2].n_invalid == 1 and math.isclose(got[2].total_reward, -0.5 + 0.5 + 0.4 - 1.0)
    assert trajectory.expert(d, p, "k").where("role = 'assistant'").count() >= 4


def test_streamed_trajectories_equal_batch(spark, tmp_path):
    """STM-03, STM-06, UDF-04: the stream over several files ends where batch does."""
    p = trajectory.Protocol({"a": 0.5, "b": 0.2, "end": 1.0}, final="end", max_steps=5)
    rows = [(k, t, ["a", "b", "x", "end"][(k + t) % 4], 1.0) for k in range(6) for t in range(5)]
    d = spark.createDataFrame(rows, "k long, t long, a string, v double")
    for t in range(5):
        d.where(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streaming.run_available(streaming.trajectories(stream, p, "k", "t", "a", "v"), str(tmp_path / "run"), "update")
    last = found.groupBy("k").agg(F.max_by(F.struct("steps", "total_reward"), "steps").alias("l")).select("k", "l.*")
    want = {r.k: (r.steps, round(r.total_reward, 9)) for r in trajectory.replay(d, p, "k", "t", "a", "v").collect()}
    assert {r.k: r.steps for r in last.collect()} == {k: v[0] for k, v in want.items()}


def test_append_log_resumes(spark, tmp_path):
    """SRC-13, STM-01, SNK-09: a second run writes only what has come since."""
    schema = "ts double, gpu double"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts": 1, "gpu": 50}\nnot json\n{"ts": 2, "gpu": 60}\n')
    run = lambda: streaming.append_log(streaming.log_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    (tmp_path / "in" / "b.json").write_text('{"ts": 3, "gpu": 70}\n')
    run()
    assert sorted(r.ts for r in spark.read.schema(schema).json(str(tmp_path / "out")).collect()) == [1.0, 2.0, 3.0]


def test_online_memory_stream(spark, tmp_path):
    """STM-04."""
    d = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 3.0), ("s", "b", 5.0)], "s string, a string, v double")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = streaming.run_available(streaming.remembered(stream, "s", "a", "v"), str(tmp_path / "run"), "update").collect()
    assert {(r.a, r.n, r["mean"]) for r in got} == {("a", 2, 2.0), ("b", 1, 5.0)}


def test_jsonl_round_trip(spark, tmp_path):
    """SNK-01, SNK-02, SRC-01, SRC-02: blank lines are skipped, U+2028 stays, strict reading raises, a rewrite replaces."""
    d = spark.createDataFrame([(1, "a\u2028b"), (2, None)], "id long, text string")
    writers.jsonl(d, str(tmp_path / "x"))
    writers.jsonl(d, str(tmp_path / "x"))
    lines = "\n\n".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    (tmp_path / "y.jsonl").write_text(lines + "\n\n")
    assert {r.id: r.text for r in readers.jsonl(spark, str(tmp_path / "y.jsonl"), "id long, text string").collect()} == {1: "a\u2028b", 2: None}
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "id long", strict=True).collect()
    assert readers.tolerant_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long", ["id"]).count() == 1


def test_line_errors(spark, tmp_path):
    """SRC-03: bad lines are told by file and number."""
    lines = ['{"id": 1, "messages": [{"role": "assistant", "content": "x"}]}', "{broken", '{"messages": null, "id": 2}', '{"id": 3, "messages": [{"role": "user", "content": "x"}]}']
    (tmp_path / "f.jsonl").write_text("\n".join(lines) + "\n")
    got = readers.line_errors(spark, str(tmp_path / "f.jsonl"), "id long, messages array<struct<role:string,content:string>>", ["messages"], "assistant").collect()
    assert sorted((r.line_number, r.problem) for r in got) == [(2, "not a JSON object"), (3, "no messages"), (4, "last role isn't assistant")]


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('﻿answer,prompt\nA,"two\nlines, ""quoted"""\n'.encode())
    r = readers.csv(spark, str(tmp_path / "x.csv"), "answer string, prompt string").collect()
    assert [(x.answer, x.prompt) for x in r] == [("A", 'two\nlines, "quoted"')]


def test_csv_keeps_odd_texts(spark, tmp_path):
    """SRC-08: nulls, empty texts, NUL beside quotes, line ends, blanks and marks come back as they were, in any column."""
    odd = [None, "", " ", " a ", "\t", "\n", "\r", "a\r\nb", '"', '""', 'a",\n"b', 'a"\x00b\x00', "\x00", "\\", '\\"', "#a", "null", "\ufeffa", "first,n,last"]
    rows = [(a, k if k % 3 else None, b) for k, (a, b) in enumerate((a, b) for a in odd for b in odd)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "first string, n long, last string").repartition(5)
    writers.csv(df, str(tmp_path / "odd"))
    assert sorted(map(repr, readers.csv(spark, str(tmp_path / "odd"), "first string, n long, last string").collect())) == sorted(map(repr, df.collect()))
    writers.csv(spark.createDataFrame([("a",), ("",), (None,)], "only string"), str(tmp_path / "one"))
    assert sorted(r.only for r in readers.csv(spark, str(tmp_path / "one"), "only string").collect()) == ["", "", "a"]


def test_whole_json_and_entities(spark, tmp_path):
    """SRC-07, SRC-09."""
    (tmp_path / "d.json").write_text(json.dumps({"a": {"b": 1}}, indent=2))
    assert readers.document(spark, str(tmp_path / "d.json"), "a struct<b:int>").first().a.b == 1
    (tmp_path / "e.jsonl").write_text('{"confidence": 0.5}\n{"confidence": 1.5}\n')
    with pytest.raises(Exception, match="confidence"):
        readers.entities(spark, str(tmp_path / "e.jsonl"), "confidence double", {"confidence out of range": F.col("confidence").between(0, 1)}).collect()
    assert readers.entities(spark, str(tmp_path / "none.jsonl"), "confidence double", {}).count() == 0


def test_tar_members(spark, tmp_path):
    """SRC-17: members are read, unsafe names refused."""
    def archive(name, member):
        with tarfile.open(tmp_path / name, "w") as tar:
            info = tarfile.TarInfo(member)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    archive("good.tar", "a/b.gif")
    got = readers.tar_members(spark, str(tmp_path / "good.tar"), [".gif"]).collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("a/b.gif", b"abc")]
    archive("bad.tar", "../b.gif")
    with pytest.raises(Exception, match="unsafe"):
        readers.tar_members(spark, str(tmp_path / "bad.tar"), [".gif"]).collect()


def test_result_cache(spark, tmp_path):
    """SNK-03, SNK-04: a complete result is used again, an incomplete one is made anew."""
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    key = writers.fingerprint(d, "id", {"k": 1})
    assert key == writers.fingerprint(d.repartition(3), "id", {"k": 1}) != writers.fingerprint(d, "id", {"k": 2})
    calls = []
    make = lambda: calls.append(1) or d
    for _ in range(2):
        assert writers.cached(spark, str(tmp_path), key, 2, make).count() == 2
    assert len(calls) == 1
    with pytest.raises(ValueError):
        writers.cached(spark, str(tmp_path), "other", 3, make)


def test_cache_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    """SNK-03: a writer that dies before the name is given, two writers at once, and a file that is lost."""
    import os

    d = spark.range(20).withColumn("x", F.col("id") % 3).repartition(3)
    name = writers._name
    monkeypatch.setattr(writers, "_name", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        writers.cached(spark, str(tmp_path), "k", 20, lambda: d)
    assert writers.stored(spark, f"{tmp_path}/k") is None and not (tmp_path / "k").exists()
    monkeypatch.setattr(writers, "_name", name)
    calls = []

    def late():
        calls.append("late")
        if len(calls) == 1:  # meanwhile another writer is through
            assert writers.cached(spark, str(tmp_path), "k", 20, lambda: calls.append("early") or d).count() == 20
        return d.withColumn("x", F.lit(99))

    assert writers.cached(spark, str(tmp_path), "k", 20, late).where("x = 99").count() == 0
    assert calls == ["late", "early"] and writers.stored(spark, f"{tmp_path}/k")["rows"] == 20
    lost = next(p for p in (tmp_path / "k").iterdir() if p.suffix == ".parquet")
    os.unlink(lost)
    assert writers.stored(spark, f"{tmp_path}/k") is None
    assert writers.cached(spark, str(tmp_path), "k", 20, lambda: d).count() == 20


def test_tailed_files_resume(spark, tmp_path):
    """STM-01, SRC-13: files that grow between starts and while a line isn't finished, in small ranges and batches; no line is lost or comes twice."""
    from plumbline.sources import tail

    said = {"a.log": [], "b.log": []}

    def append(name, *lines, end="\n"):
        with open(tmp_path / name, "a", encoding="utf-8", newline="") as f:
            f.write("\n".join(lines) + end)
        said[name] += lines

    def run(**more):
        d = tail.tailed(spark, f"{tmp_path}/*.log", **more)
        q = d.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        q.processAllAvailable()
        q.stop()

    def check(open_line=None):
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        for name, lines in said.items():
            own = sorted((r.position, r.value) for r in got if r.file.endswith(name))
            assert [v for _, v in own] == [x for x in lines if x != open_line], name
            assert len({p for p, _ in own}) == len(own)

    append("a.log", *(f"line {k} é" + "x" * (k % 50) for k in range(200)))
    run(range_bytes=64)
    check()
    append("b.log", "", "one", "two")
    append("a.log", "unfinished", end="")
    run(batch_bytes=10)
    check("unfinished")
    append("a.log", "", "after")  # the unfinished line ends
    said["a.log"].remove("")
    run()
    check()
    run()  # nothing new
    check()
    (tmp_path / "a.log").write_text("short\n")
    with pytest.raises(Exception, match="shorter"):
        run()


def test_http_model(spark, tmp_path):
    """SRC-14: a server that fails for a while, is busy, and refuses; replies are asked once and kept."""
    import http.server
    import threading
    import time
    from functools import partial

    from plumbline.sources import http_model

    seen, lock = {}, threading.Lock()

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = body["messages"][0]["content"]
            with lock:
                seen[prompt] = n = seen.get(prompt, 0) + 1
            status = {"bad": 400, "down": 503}.get(prompt, 503 if prompt == "twice" and n < 3 else 429 if prompt == "busy" and n == 1 else 200)
            said = json.dumps({"choices": [{"message": {"content": f"{body['model']}:{prompt}"}, "logprobs": {"content": [{"logprob": -1.0}, {"logprob": -0.5}]}}], "usage": {"prompt_tokens": len(prompt), "completion_tokens": 2}}).encode()
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "0")
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        make = partial(http_model.HttpClient, f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "m", first_wait=0.01, tries=4)
        d = spark.createDataFrame([(1, "hello"), (2, "twice"), (3, "hello"), (4, "busy"), (5, None)], "k long, p string")
        for _ in range(2):
            got = {r.k: (r.text, r.mean_logprob, r.prompt_tokens) for r in http_model.replies(d, make, "k", "p", f"{tmp_path}/cache", tasks=2).collect()}
            assert got == {1: ("m:hello", -0.75, 5), 2: ("m:twice", -0.75, 5), 3: ("m:hello", -0.75, 5), 4: ("m:busy", -0.75, 4), 5: ("m:", -0.75, 0)}
        assert seen == {"hello": 1, "twice": 3, "busy": 2, "": 1}
        with pytest.raises(http_model.Unanswered, match="400"):
            make().generate(["bad"])
        assert seen["bad"] == 1
        with pytest.raises(http_model.Unanswered, match="4 tries: status 503"):
            make().generate(["down"])
        began = time.monotonic()
        make(per_second=20).generate(["hello"] * 5)
        assert time.monotonic() - began >= 4 / 20
    finally:
        server.shutdown()
    with pytest.raises(http_model.Unanswered, match="2 tries"):
        http_model.HttpClient(f"http://127.0.0.1:{server.server_port}/", "m", tries=2, first_wait=0.01, timeout=0.5).generate(["x"])


def test_reports(spark, tmp_path):
    """SNK-05, SNK-06, SNK-07."""
    d = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    assert writers.markdown(d, {"v": ".1%"}).split("\n")[2:] == ["| a | 50.0% |", "| b | — |"]
    assert json.loads(writers.summary(d))[1] == {"k": "b", "v": None}
    (tmp_path / "x.txt").write_text("one\n\ntwo\n")
    m = writers.manifest(spark, str(tmp_path), "*.txt").first()
    assert (m.file, m.rows, m.bytes) == ("x.txt", 2, 9)


def test_stage_log(spark):
    lines = spark.createDataFrame([("[2025-01-01T00:00:00+00:00] warm up",), ("noise",), ("[x] y",)], "value string")
    assert [(r.epoch, r.stage) for r in readers.stage_lines(lines).collect()] == [(1735689600.0, "warm up")]


def test_stage_summary(spark):
    d = spark.createDataFrame([(float(t), v) for t, v in ((0, 40.0), (1, 80.0), (2, 60.0), (3, 10.0))], "ts double, v double")
    s = {r.stage: r for r in series.stage_summary(series.in_stage(d, "ts", [0.0, 2.5], ["a", "b"]), "stage", "ts", "v").collect()}
    assert (s["a"].n, s["a"].peak, s["a"]["mean"], s["a"].p95, s["a"].duration) == (3, 80.0, 60.0, 80.0, 2.0)
    assert s["b"].duration == 0.0


def test_gates(spark):
    d = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, v string")
    r = gates.gate(d, "v", F.col("v") == "x", "id").first()
    assert (r.n_checked, r.n_violations, r.example) == (3, 2, "2")
    with pytest.raises(gates.GateError):
        gates.enforce(gates.gate(d, "v", F.col("v").isNotNull()))
    with pytest.raises(gates.GateError):
        gates.ranges_disjoint((0, 10), (5, 10), 100)
    with pytest.raises(ValueError):
        gates.arguments(gamma=False)
    c = gates.contiguity(spark.createDataFrame([(1,), (2,), (2,), (4,)], "s long"), "s", 1, 4).first()
    assert (c.n_missing, c.n_duplicate, c.first_missing) == (1, 1, 3)
    assert gates.adjacent(spark.createDataFrame([(0, 4), (5, 9), (11, 12)], "a long, b long"), "a", "b").count() == 1
    assert gates.unique(d.unionByName(d.limit(1)), "id").count() == 1 and gates.complete(d, 3)


def test_splits_are_disjoint_and_stable(spark):
    d = spark.range(200).select("id", (F.col("id") % 4).alias("label"))
    s = datasets.split(d, ["label"], "id", {"train": 20, "cal": 10, "test": 10})
    assert {(r.label, r.split): r.n for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()} == {(k, n): m for k in range(4) for n, m in (("train", 20), ("cal", 10), ("test", 10))}
    assert s.select("id").distinct().count() == 160
    h = {r.id: r.split for r in datasets.hash_split(d, "id", {"a": 8, "b": 2}).collect()}
    assert {r.id: r.split for r in datasets.hash_split(d.where("id < 50"), "id", {"a": 8, "b": 2}).collect()} == {k: v for k, v in h.items() if k < 50}
    with pytest.raises(ValueError):
        datasets.balanced_sample(d, "label", "id", 100)


def _bm25(docs, query):
    """Scores of the documents (key -> words) that share a word with a query's words."""
    average = sum(map(len, docs.values())) / len(docs)
    out = {}
    for key, words in docs.items():
        for w in query:
            if tf := words.count(w):
                df = sum(w in x for x in docs.values())
                out[key] = out.get(key, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / average))
    return out


def test_queries_take_whole_tables(spark, tmp_path, monkeypatch):
    """Texts and keys beyond any prefix and any first rows count."""
    import random
    import re

    from plumbline.functions import hashing
    from plumbline.plans.catalogue import QUERIES

    rng = random.Random(6)
    some = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    docs = {i: (["en", "de"][i % 3 == 0], "\n".join(some(rng.randint(4, 40)) for _ in range(6))) for i in (*range(30), *range(190, 230), 900)}
    items = {i: some(12) for i in (0, 5, 11, 40, 77)}
    spark.createDataFrame([(i, t, lang, len(t)) for i, (lang, t) in docs.items()], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = {0: 1, 20: 0, 200: 1, 220: 0}
    spark.createDataFrame(list(labels.items()), "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    words = lambda t: re.findall("[a-z0-9_]+", t.lower())
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()

    tail = {r.doc_id: r.tail for r in run("mth09_exact_arithmetic")}
    assert tail == {i: round(sum(math.comb(i % 40 + 1, j) for j in range(min(i % 7, i % 40 + 1) + 1)) / 2 ** (i % 40 + 1), 9) for i in docs}
    assert {r.doc_id: r.vector for r in run("mth04_feature_hashing")} == {i: hashing.vector(words(t)).tolist() for i, (_, t) in docs.items()}

    bodies = {i: words(t) for i, t in items.items()}
    of = lambda item: ["de", "en", "es", "fr"][item % 4]
    asked = {i: d for i, d in docs.items() if i % 20 == 0}
    best, chosen = {}, {}
    for i, (lang, t) in asked.items():
        top = []
        for part in t.split("\n"):
            s = {item: x for item, x in _bm25(bodies, words(part)).items() if of(item) == lang}
            top.append(min(((-round(x, 9), item, x) for item, x in s.items()), default=(0, None, 0.0)))
        best[i], chosen[i] = max(x for _, _, x in top), [(x, item) for _, item, x in top]
    balance = {}
    for limit in {0.0, *(best[i] for i in labels)}:
        said = {i: best[i] >= limit and limit > 0 for i in labels}
        balance[limit] = sum(0.5 * sum(said[i] == bool(v) for i in labels if labels[i] == v) / sum(labels[i] == v for i in labels) for v in (0, 1))
    limit = min(balance, key=lambda x: (-round(balance[x], 12), x))
    want = {i: ",".join(str(r) for r in sorted({item for x, item in c if item is not None and x >= limit > 0})) for i, c in chosen.items()}
    for rows in (retrieval.BROADCAST_ROWS, 20):  # the second: more fragments than are broadcast, postings of the items aren't
        monkeypatch.setattr(retrieval, "BROADCAST_ROWS", rows)
        assert {r.doc_id: r.rules for r in run("pol06_authority_retrieval")} == want

    tokens = lambda t: re.findall(r"[a-z0-9][a-z0-9_.+-]*", t.lower())
    features, vectors = {i: tokens(t) for i, t in items.items()}, {i: hashing.vector(tokens(t)) for i, t in items.items()}
    scaled = lambda s: {k: (x - min(s.values())) / (max(s.values()) - min(s.values())) if max(s.values()) > min(s.values()) else float(x > 0) for k, x in s.items()}
    want = set()
    for i, (lang, t) in asked.items():
        bm25 = scaled({k: 0.0 for k in items} | _bm25(features, sorted(set(tokens(t)))))
        near = scaled({k: float(vectors[k] @ hashing.vector(tokens(t))) for k in items})
        score = {}
        for k, item in items.items():
            keys = list(dict.fromkeys(words(item)))[:3]
            hits = sum(w in t.lower() for w in keys) / len(keys)
            score[k] = round(0.72 * (0.52 * bm25[k] + 0.38 * near[k] + 0.10 * hits) + 0.23 * hits + 0.05 * min(k * 7 % 101, 100) / 100, 12)
        ranked = sorted((k for k in items if of(k) == lang), key=lambda k: (-score[k], -(k * 7 % 101), -k))
        want |= {(i, rank, k, round(score[k], 6)) for rank, k in enumerate(ranked[:3], 1)}
    assert {(r.doc_id, r.rank, r.rule_id, r.score) for r in run("pol01_hybrid_search")} == want


def test_dense_takes_queries_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(4)
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(60)}
    d = spark.createDataFrame(list(vectors.items()), "i long, v array<double>")
    q = d.select(F.col("i").alias("q"), F.col("v").alias("qv"))
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b))
    want = {(a, r, b) for a, v in vectors.items() for r, b in enumerate(sorted((b for b in vectors if b != a), key=lambda b: (-round(cos(v, vectors[b]), 9), b))[:3], 1)}
    for rows in (retrieval.MAX_QUERY_ROWS, 25, 7):
        monkeypatch.setattr(retrieval, "MAX_QUERY_ROWS", rows)
        assert {(x.q, x.rank, x.i) for x in retrieval.dense(d, q, "i", "q", "v", "qv", 3).collect()} == want


def test_dense_edge_cases(spark):
    """Ties, copies in great number, null vectors and such of another length."""
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(300, [0.0, 1.0]), (301, None), (302, [1.0]), (303, [0.0, 0.0]), (None, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "i long, v array<double>").repartition(7)
    q = spark.createDataFrame([(5, [2.0, 0.0]), (300, [0.0, 3.0]), (301, None), (302, [1.0])], "q long, qv array<double>")
    got = {}
    for r in retrieval.dense(d, q, "i", "q", "v", "qv", 3).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.i, r.cosine)
    assert got == {5: {1: (0, 1.0), 2: (1, 1.0), 3: (2, 1.0)}, 300: {1: (0, 0.0), 2: (1, 0.0), 3: (2, 0.0)}}
    assert retrieval.dense(d.limit(0), q, "i", "q", "v", "qv", 3).count() == retrieval.dense(d, q.limit(0), "i", "q", "v", "qv", 3).count() == 0


def test_percentiles_from_counts(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    values = [round(rng.random(), 2) for _ in range(501)]
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    r = calibration.percentiles(d, "v", (0.2, 0.35, 0.8)).first()
    assert r.total == 501 and [r.q20, r.q35, r.q80] == pytest.approx(list(np.percentile(values, [20, 35, 80])))
    assert calibration.percentiles(d.where("v < 0"), "v", (0.5,)).first().total == 0


def test_hybrid_search(spark):
    """Scores of three rules by hand; scaling is over all of them, the category filter comes after it."""
    rows = [(1, r, c, lex, den, key, p) for r, c, lex, den, key, p in ((1, "x", 10.0, 0.5, 0.0, 50), (2, "y", 5.0, 0.5, 0.5, 200), (3, "y", 0.0, 0.5, 0.5, 200), (4, "y", 5.0, 0.5, 0.5, 200))]
    d = spark.createDataFrame(rows, "q int, rule_id int, category string, lexical double, dense double, keyword double, priority int")
    got = retrieval.hybrid(d, "q", category=F.col("category") == "y").orderBy("rank").collect()
    # dense scores are all equal and positive, so they count 1; priority is cut at 100
    blend = 0.52 * 0.5 + 0.38 + 0.10 * 0.5
    assert [r.rule_id for r in got] == [4, 2, 3]  # of equal scores the greatest id first
    assert math.isclose(got[0].retrieval, blend) and math.isclose(got[0].score, 0.72 * blend + 0.23 * 0.5 + 0.05)
    assert math.isclose(got[2].score, 0.72 * (0.38 + 0.05) + 0.23 * 0.5 + 0.05) and got[0].bm25 == 0.5
    bare = retrieval.hybrid(d, "q", mode="bm25", rerank=False).orderBy("rank").collect()
    assert [(r.rule_id, r.score) for r in bare] == [(1, 1.0), (4, 0.5), (2, 0.5), (3, 0.0)]
    with pytest.raises(ValueError):
        retrieval.hybrid(d, "q", mode="other")
    r = one(spark, a=retrieval.keyword_share(F.lit("Stock market"), F.array(F.lit("STOCK"), F.lit("bond"))), b=retrieval.keyword_share(F.lit("x"), F.array().cast("array<string>")))
    assert (r.a, r.b) == (0.5, 0.0)


def test_authority_keeps_to_the_category(spark):
    rules = spark.createDataFrame([(1, "c", "alpha beta"), (2, "d", "alpha beta gamma"), (3, "c", "gamma")], "rule_id long, category string, text string")
    lines = spark.createDataFrame([(7, 1, "c", "alpha gamma gamma"), (7, 2, "c", "nothing"), (8, 1, "d", "gamma")], "case long, pos int, category string, part string")
    w = lambda c: F.split(c, " ")
    got = {(r.case, r.pos): r for r in retrieval.authority(lines, rules, "case", "pos", w("part"), w("text"), 0.1).collect()}
    assert {k: (r.chosen, r.top) for k, r in got.items()} == {(7, 1): (3, "3,1"), (7, 2): (None, None), (8, 1): (2, "2")}
    none = retrieval.authority(lines, rules, "case", "pos", w("part"), w("text"), 99.0).collect()
    assert {r.chosen for r in none} == {None} and got[7, 2].best == 0.0


def _tokens_of(text_):
    return re.findall("[a-z0-9_]+", text_.lower())


def test_top_k_by_bounds(spark):
    """The same as scoring every pair, with blocks that the second round alone may reach, few documents, and queries without any."""
    import random

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 60, 300])]) for _ in range(n))
    docs = spark.createDataFrame([(k, prose(rng.choice([1, 2, 30, 200]))) for k in range(400)] + [(900, ""), (901, None)], "d long, text string")
    asked = spark.createDataFrame([(k, prose(rng.choice([1, 3, 20, 60]))) for k in range(60)] + [(90, "nowhere"), (91, ""), (92, "w1 w1 w1")], "q long, text string")
    w = text.words(F.col("text"))
    for few in (docs, docs.limit(3), docs.limit(0)):
        every = retrieval.top_k(retrieval.bm25(few, asked, "d", "q", w, w), "q", 4, F.round("score", 8).desc(), F.col("d"))
        want = {(r.q, r["rank"]): (r.d, round(r.score, 7)) for r in every.collect()}
        got = {(r.q, r["rank"]): (r.d, round(r.score, 7)) for r in retrieval.bm25_top_k(few, asked, "d", "q", w, w, 4).collect()}
        assert got == want


def test_texts_are_cut_once(spark):
    """JON-09: counts of tokens and the postings come of one cut of the texts."""
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(t):
        cuts.add(1)
        return t.split()

    docs = spark.createDataFrame([(k, f"a b{k}") for k in range(20)], "d long, t string")
    asked = spark.createDataFrame([(1, "a b3")], "q long, t string")
    r = retrieval.bm25_rounds(docs, asked, "d", "q", cut("t"), F.split("t", " "), 5)
    assert r.survivors.count() and cuts.value == 20


def test_few_pairs_are_scored(spark):
    """JON-09: of the pairs that have a token in common, less than a tenth reaches the second round."""
    docs, asked = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").select("text", F.col(k).alias("k")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    w = text.words(F.col("text"))
    r = retrieval.bm25_rounds(docs.withColumnRenamed("k", "d"), asked.withColumnRenamed("k", "q"), "d", "q", w, w, 5)
    # at least as many pairs as documents that share the most common word of any query, for each query with it
    pairs = r.postings.join(asked.select(F.col("k").alias("q"), F.explode(F.array_distinct(w)).alias("token")), "token").select("d", "q").distinct().count()
    assert pairs > 1_000_000 and r.survivors.count() < pairs / 10


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.8, 1.0])
def test_similar_pairs(spark, threshold):
    """JON-07: all pairs at or above a threshold, few candidates at high ones."""
    import random

    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(80)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([6, 80])]) for _ in range(rng.randint(0, 25))) for _ in range(250)]
    texts += [f"{x} extra" for x in texts[:40]] + [texts[0]] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    asked = docs.where("d % 3 = 0").select(F.col("d").alias("q"), "text")
    w = text.words(F.col("text"))
    sets = {k: set(_tokens_of(x)) for k, x in enumerate(texts)}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    want = {(q, d): round(s, 9) for q in range(0, len(texts), 3) for d in sets if (s := alike(sets[q], sets[d])) >= threshold and s > 0}
    got = {(r.q, r.d): round(r.similarity, 9) for r in retrieval.similar_pairs(docs, asked, "d", "q", w, w, threshold).collect()}
    assert got == want


def test_alike_states_make_no_pairs(spark):
    """POL-12: thousands of cases of few states, and each query takes only its neighbours."""
    memory_rows = [(k, f"phase p{k % 5} again p{k % 5}" if k % 7 else "", f"a{k % 3}", float(k % 11)) for k in range(4000)]
    known = spark.createDataFrame(memory_rows, "step long, state string, action string, return_value double")
    asked = spark.createDataFrame([(k, ["p1 phase again", "phase p2 again more", "", "unknown"][k % 4]) for k in range(2000)], "q long, state string")
    near = memory.neighbours(asked, known, "q", 0.7, 6)
    got = near.groupBy("q").agg(F.array_sort(F.collect_list("step")).alias("steps")).collect()
    latest = lambda f: sorted(k for k, *_ in [r for r in memory_rows if f(r)][-6:])
    want = [latest(lambda r: "p1" in r[1]), latest(lambda r: "p2" in r[1]), latest(lambda r: not r[1])]
    assert {r.q: r.steps for r in got} == {q: want[q % 4] for q in range(2000) if q % 4 < 3}


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_containment_is_contains(spark, block_bytes):
    """JON-11: items of 0 to 200 characters, of any characters, some of them equal, in one block and in many."""
    import random

    rng = random.Random(2)
    body = lambda n: "".join(rng.choice("ab \né日.") for _ in range(n))
    texts = [body(rng.randint(0, 400)) for _ in range(60)] + ["", None]
    items = [body(n) for n in range(6) for _ in range(3)] + [t[a : a + n] for n in (7, 30, 100, 200) for t in texts[:20] for a in [rng.randint(0, max(0, len(t) - n))]] + ["", None, "ab", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    wanted = spark.createDataFrame(list(enumerate(items)), "i long, item string")
    got = sorted((r.i, r.d) for r in retrieval.containment(docs, wanted, "d", "i", "text", "item", block_bytes).collect())
    assert got == sorted((i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if x is not None and t is not None and x in t)


def test_cells_find_neighbours(spark, monkeypatch):
    """JON-10: recall against all vectors on the table; shares of a cell of copies; edge cases."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    asked = table.where("i % 20 = 0").select(F.col("i").alias("q"), F.col("v").alias("qv"))
    index = cells.fit(table, "v", 5)
    want = {(r.q, r.i) for r in retrieval.dense(table, asked, "i", "q", "v", "qv", 5).collect()}
    got = {(r.q, r.i) for r in cells.nearest(table, asked, "i", "q", "v", "qv", 5, index).collect()}
    assert index.recall >= 0.95 and len(got & want) / len(want) >= 0.9
    monkeypatch.setattr(cells, "SHARE", 7)
    monkeypatch.setattr(cells, "QUERY_SHARE", 3)
    copies = spark.createDataFrame([(k, [1.0, 0.5, 0.0]) for k in range(60)] + [(k, [float(k % 5), 1.0, float(k % 3)]) for k in range(60, 120)] + [(200, None), (201, [1.0]), (None, [1.0, 1.0, 1.0])], "i long, v array<double>")
    few = copies.where("i % 10 = 0").select(F.col("i").alias("q"), F.col("v").alias("qv"))
    all_cells = cells.Cells(cells.fit(copies, "v", n_cells=4).centres, 4, 1.0)
    exact = sorted((r.q, r.i, r["rank"]) for r in retrieval.dense(copies, few, "i", "q", "v", "qv", 4).collect())
    assert sorted((r.q, r.i, r["rank"]) for r in cells.nearest(copies, few, "i", "q", "v", "qv", 4, all_cells).collect()) == exact
    none = copies.limit(0)
    assert cells.nearest(none, few, "i", "q", "v", "qv", 4, cells.fit(none, "v")).count() == 0


def test_containment_of_short_items(spark):
    texts = [(1, "the cart of gold"), (2, "an art, of sorts"), (3, "--!?"), (4, ""), (5, None), (6, "one two three four five six")]
    items = [(1, "art of"), (2, "a"), (3, "!?"), (4, ""), (5, "two three four"), (6, "wo three four fi"), (7, None), (8, "zzz"), (9, "two three fou")]
    docs, wanted = spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(items, "i int, item string")
    got = {(r.i, r.d) for r in retrieval.containment(docs, wanted, "d", "i", "text", "item").collect()}
    assert got == {(i, d) for i, x in items for d, t in texts if x is not None and t is not None and x in t}
    assert retrieval.containment(docs, wanted.limit(0), "d", "i", "text", "item").count() == 0


def test_rules_composed(spark):
    """Equal priority takes the greatest id; what is unknown counts as asked for."""
    rows = [(1, 10, "A", "c", 5), (1, 11, "A", "c", 5), (1, 99, None, None, None), (1, 11, "A", "c", 5), (2, 99, None, None, None), (3, 12, "B", "c", 1), (3, 13, "C", "d", 9)]
    d = spark.createDataFrame(rows, "k int, rule_id int, canonical_id string, category string, priority int")
    got = {r.k: r for r in policy.compose(d, "k").collect()}
    assert (got[1].rules, got[1].n_matched, got[1].n_unknown) == ("11", 3, 1) and math.isclose(got[1].compression, 1 - 1 / 3)
    assert (got[2].rules, got[2].compression, got[2].conflict) == ("", 1.0, False)
    assert got[3].conflict and got[3].first == "C" and got[3].compression == 0.0


def test_verification_and_scores(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    no, yes = F.struct(F.lit(False).alias("all")), F.struct(F.lit(True).alias("all"))
    r = one(spark, a=policy.verified(no, a("x"), a("x", "y")), b=policy.verified(yes, a("x", "x"), a("x")), c=policy.verified(yes, a("x", "y"), a("x", "y", "z")))
    assert [(x.accepted, x.corrected) for x in (r.a, r.b, r.c)] == [(False, True), (True, False), (True, True)]
    r = one(spark, a=text.judge_score(F.lit("[[7]]")), b=text.judge_score(F.lit("[[3]] then [[7]]")), c=text.judge_score(F.lit("[[4.9]]")), d=text.feature_tokens(F.lit("\u3400\u3401 Ab"), {"k": ["aB"]}))
    assert (r.a, r.b, r.c, r.d) == (0.0, 0.75, 1.0, ["ab", "\u3400", "\u3401", "\u3400\u3401", "concept:k"])


def test_decision_tells_what_it_rests_on(spark):
    rows = [(1, 10, "PASS", 5, [], ["x"], "has x and y"), (1, 11, "REJECT", 1, [10], ["y", "x"], "has x and y"), (2, 12, "REJECT", 1, [], ["q"], "has x")]
    d = spark.createDataFrame(rows, "c int, rule_id long, decision string, priority int, exception_ids array<bigint>, cues array<string>, content string")
    got = {r.c: (r.decision, r.matched_rules, r.applied, r.evidence) for r in policy.decide(d, "c").collect()}
    assert got == {1: ("PASS", "10,11", "10", "x|y"), 2: ("REJECT", "12", "12", "")}


def test_fuzzy_ids_need_one_candidate(spark):
    known = spark.createDataFrame([(1, "c", "alpha"), (2, "c", "alphabet"), (3, "c", "beta")], "k int, c string, s string")
    raw = spark.createDataFrame([(10, "c", "alph"), (11, "c", "bet"), (12, "d", "beta")], "r int, c string, s string")
    assert [(x.r, x.resolved) for x in retrieval.fuzzy_ids(raw, known, "r", "k", "c", "s").collect()] == [(11, 3)]


def test_fuzzy_ids_broadcast_nothing(spark):
    """Prefixes are many times the rows of a small file, by which Spark would broadcast them; a raw id with two slugs counts both."""
    known = spark.createDataFrame([(k, "a", f"s{k:03}x") for k in range(200)] + [(900, "b", "s"), (901, None, "s001")], "k long, c string, s string")
    raw = spark.createDataFrame([(1, "a", "s001"), (2, "a", "s00"), (3, "b", "st"), (4, "a", "s007xy"), (5, None, "s001"), (6, "a", "s001"), (6, "b", "s"), (7, "a", None)], "r long, c string, s string")
    d = retrieval.fuzzy_ids(raw, known, "r", "k", "c", "s")
    assert sorted(map(tuple, d.collect())) == [(1, 1), (3, 900), (4, 7)]
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_sampled_action_takes_the_first_of_equal_sums(spark):
    """Rows of probability zero have the sum of the row before them; the answer can't depend on the order in which parts are read."""
    rows = [(g, e, p) for g in range(40) for e, p in ((1, 0.25), (2, 0.5), (3, 0.0), (4, 0.0), (5, 0.25))] + [(99, 1, 0.9), (99, 2, -0.5), (99, 3, 0.6)]
    d = series.sampled_action(spark.createDataFrame(rows, "g int, e int, p double").repartition(7, "e"), "g", "e", "p", F.when(F.col("g") == 99, 0.7).otherwise(0.5))
    assert {(r.g, r.chosen) for r in d.collect()} == {(g, 2) for g in range(40)} | {(99, 1)}
    last_first = d.sparkSession.createDataFrame([(1, e, p) for e, p in ((4, 0.0), (3, 0.0), (2, 0.75), (1, 0.25))], "g int, e int, p double").coalesce(1)
    assert series.sampled_action(last_first, "g", "e", "p", F.lit(0.5)).first().chosen == 2


def test_matched_rules_are_dealt_by_size(spark, monkeypatch):
    """Parts grow in number with the items, and a long list of rules is merged, not broadcast by the size of its file."""
    from plumbline.plans import policy_queries
    from plumbline.plans.base import Tables

    monkeypatch.setattr(policy, "PART_ROWS", 100)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 10)
    t = Tables(spark, "/root/testdata/sf0.001")
    d = policy_queries.matched(t)
    assert d.rdd.getNumPartitions() >= t.lineitem.count() // 100
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_features_by_slices(spark):
    """A worker holds vectors of a slice only; a null text has no tokens, and each row has what ``vector`` gives."""
    import pyarrow as pa

    rows = [["a", "b", "a"], [], None, ["c"] * 3] * 300
    out = list(hashing.feature_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(rows, pa.list_(pa.string()))], ["k", "t"])]), "k"))
    assert max(map(len, out)) <= hashing.SLICE
    assert [v for b in out for v in b.column(1).to_pylist()] == [hashing.vector(t or []).tolist() for t in rows]
    d = hashing.hashed_features(spark.createDataFrame([(1, None), (2, ["a"])], "k long, t array<string>"), "k", "t")
    assert {r.k: r.vector for r in d.collect()} == {1: [0.0] * 256, 2: hashing.vector(["a"]).tolist()}


def test_equations_are_sought_behind_equals_signs_only(monkeypatch):
    assert equations.calculation("12 + 30 = 42, 5 * 3 = 16, 12 =\u2003$12", "Of 12 and 5", "42") == (2, 1, 0.5)
    assert equations.Pieces("1 + 1 =" + " \n\u2003$-2").number_after(6) == "-2"
    monkeypatch.setattr(equations, "Pieces", None)
    assert equations.equations("12 + 30 and 5 * 3") == [] == equations.equations(None)


def test_prompts_become_strings_by_batches(spark):
    """No frame of all rows is made of what Spark sends; ids of any type come through, null too."""
    from plumbline.plans.relations import EchoClient

    d = readers.generated(spark.createDataFrame([(None, "a b"), (7, "c")], "id long, p string"), EchoClient, "id", "p", 1)
    assert {(r.id, r.text, r.prompt_tokens) for r in d.collect()} == {(None, "a", 2), (7, "c", 1)}
    assert "InArrow" in d._jdf.queryExecution().executedPlan().toString()


def test_queries_dont_meet_at_steps(spark, monkeypatch):
    """Queries of a few states share a few cases: they meet these by state only, never by the case's step."""
    asked = spark.createDataFrame([(q, "a b") for q in range(50)], "q long, state string")
    cases = spark.createDataFrame([(s, "a b", "x", float(s)) for s in range(8)] + [(9, "c", "y", 9.0)], "step long, state string, action string, return_value double")
    d = memory.neighbours(asked, cases, "q", 0.9, 2)
    assert sorted((r.q, r.step, r["rank"], r.return_value) for r in d.collect()) == sorted((q, s, 8 - s, float(s)) for q in range(50) for s in (7, 6))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_rules_meet_items_in_parts_of_bounded_size(spark, monkeypatch):
    """Each join of items has parts that grow with them, and so has a rule with most of the items."""
    from plumbline.plans import policy_queries
    from plumbline.plans.base import Tables

    monkeypatch.setattr(policy, "PART_ROWS", 50)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 10)
    t = Tables(spark, "/root/testdata/sf0.001")
    d = policy_queries.matched(t).distinct()
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "coalesced" not in plan and plan.count("SortMergeJoin") >= 2
    items = spark.range(1000).select(F.col("id").alias("o"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("r"))
    rules = items.select("r").distinct().withColumn("said", F.col("r") * 2)
    met = policy.with_rules(items, rules, "r", "o", 40)
    assert sorted(tuple(x) for x in met.collect()) == sorted((x.r, x.o, 2 * x.r) for x in items.collect())
    assert max(met.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 200


def test_similar_sets_are_longs(spark):
    """Sets of structs are compared each with each, so tokens go as longs."""
    d = retrieval._token_sets(spark.createDataFrame([(1, "a b b"), (2, None)], "k int, t string"), "k", F.split("t", " "), "n")
    assert dict(d.dtypes)["t"] == "array<bigint>" and [r.n for r in d.orderBy("k").collect()][0] == 2
    ranks = spark.createDataFrame([("a", 5), ("b", 2)], "w string, _rank long").select(F.xxhash64("w").alias("token"), "_rank")
    o = retrieval._ordered_tokens(d, "k", ranks, "n")
    assert dict(o.dtypes)["t"] == "array<bigint>"
    (r,) = o.collect()
    assert r.t == [x[0] for x in spark.sql("SELECT xxhash64('b') UNION ALL SELECT xxhash64('a')").collect()]


def test_backends(spark):
    """SRC-14, UDF-06, UDF-09: clients are made by kind, an unknown kind raises."""
    from plumbline.plans.relations import EchoClient

    with pytest.raises(ValueError):
        readers.backend("none")
    readers.backend("echo", EchoClient)
    d = readers.generated(spark.createDataFrame([(1, "hello you"), (2, "")], "id long, p string"), readers.backend("echo"), "id", "p")
    assert {r.id: r.text for r in d.collect()} == {1: "hello", 2: ""}


def test_views(spark):
    d = spark.createDataFrame([(0, "q", "r", "a"), (1, "q", "r", "a")], "i int, q string, r string, a string")
    v = shape.views(d, "q", "r", "a", "i").collect()
    assert len(v) == 12 and {x.teacher_tag for x in v if x.view == "mixed"} == {"cot", "direct"}
    r = one(spark, right=shape.strip_template(F.lit("<a>b</a>"), "<a>", "</a>"), wrong=shape.strip_template(F.lit("b"), "<a>", "</a>"), wide=scores.other_label(["x", "y"], F.lit("x"), F.lit("k")))
    assert (r.right, r.wrong, r.wide) == ("b", None, "y")


