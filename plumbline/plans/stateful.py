"""Queries of trajectories, online memory, segmented logs and the function registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry, scores, text
from ..operators import series, trajectory
from ..session import shared_folder
from .base import EVENTS, RESPONSES, SCORED, Tables, events, long, query, r6, responses, scored

PROTOCOL = trajectory.Protocol({"view": 0.1, "click": 0.2, "cart": 0.5, "purchase": 1.0}, final="purchase", max_steps=6)


def _steps(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type", (F.col("value") / 100).alias("value"))


WORTH = " ".join(f"WHEN '{a}' THEN {r}" for a, r in PROTOCOL.rewards.items())
TRACE = f"""first AS (SELECT user_id, event_id, event_type, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events QUALIFY step <= {PROTOCOL.max_steps}),
ended AS (SELECT *, min(CASE WHEN event_type = '{PROTOCOL.final}' THEN step END) OVER (PARTITION BY user_id) AS fin FROM first),
kept AS (SELECT *, CASE event_type {WORTH} END AS worth, row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) > 1 AS again FROM ended WHERE fin IS NULL OR step <= fin),
trace AS (SELECT user_id, step, event_id AS \"at\", event_type AS action, CASE WHEN worth IS NULL THEN {PROTOCOL.invalid_penalty} ELSE worth * v + CASE WHEN again THEN {PROTOCOL.repeat_penalty} ELSE 0 END END + CASE WHEN step >= {PROTOCOL.max_steps} AND event_type <> '{PROTOCOL.final}' THEN {PROTOCOL.timeout_penalty} ELSE 0 END AS reward,
event_type = '{PROTOCOL.final}' OR step >= {PROTOCOL.max_steps} AS done, worth IS NULL AS invalid FROM kept)"""
REPLAY = f"WITH {TRACE} SELECT user_id, max(step) AS steps, bool_or(done) AS done, round(sum(reward), 6) AS total_reward, count(*) FILTER (invalid) AS n_invalid FROM trace GROUP BY user_id"


@query("stm03_trajectory", REPLAY)
def stm03(t: Tables) -> DataFrame:
    return trajectory.replay(_steps(t), PROTOCOL, "user_id", "event_id", "event_type", "value").withColumn("total_reward", r6(F.col("total_reward")))


@query("stm06_step_trace", f"WITH {TRACE} SELECT user_id, step, \"at\", action, round(reward, 6) AS reward, round(sum(reward) OVER (PARTITION BY user_id ORDER BY step), 6) AS total, done, invalid FROM trace")
def stm06(t: Tables) -> DataFrame:
    return trajectory.trace(_steps(t), PROTOCOL, "user_id", "event_id", "event_type", "value").withColumns({"reward": r6(F.col("reward")), "total": r6(F.col("total"))})


def _expert_sql() -> str:
    s, said = trajectory.Episode(), []
    while not s.done:
        a = PROTOCOL.next_action(s)
        said.append((2 * s.steps, "assistant", f'<think>step {s.steps + 1}</think>{{"action":"{a}"}}'))
        r = PROTOCOL.step(s, a, 1.0)
        said.append((2 * s.steps - 1, "user", f"reward {r:.2f}"))
    return f"SELECT user_id, turn, role, content FROM (SELECT DISTINCT user_id FROM events), (VALUES {', '.join(map(str, said))}) m(turn, role, content)"


@query("stm08_expert_policy", _expert_sql())
def stm08(t: Tables) -> DataFrame:
    return trajectory.expert(t.events.select(F.col("user_id").cast("long").alias("user_id")).distinct(), PROTOCOL, "user_id")


@query("prj27_expert_messages", f"SELECT user_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(content, chr(10) ORDER BY turn) AS conversation FROM ({_expert_sql()}) GROUP BY user_id")
def prj27(t: Tables) -> DataFrame:
    """The expert's messages as one training row for each key."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    d = stm08(t).groupBy("user_id").agg(said.alias("m"))
    return d.select("user_id", long(F.size("m")).alias("n_messages"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.array_join(F.transform("m", lambda x: x["content"]), "\n").alias("conversation"))


@query("stm02_stage_windows", f"SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(max(value), 6) AS peak, round(avg(value), 6) AS mean FROM events GROUP BY time_bucket(INTERVAL '6 hours', ts)")
def stm02(t: Tables) -> DataFrame:
    d = events(t).groupBy(F.window("ts", "6 hours")).agg(F.count("*").alias("n"), r6(F.max("value")).alias("peak"), r6(F.avg("value")).alias("mean"))
    return d.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "peak", "mean")


@query("stm05_rounds", "SELECT DISTINCT user_id, (user_id % 4 + 1)::INTEGER AS turns, true AS done FROM events")
def stm05(t: Tables) -> DataFrame:
    shared_folder(t.spark)
    start = t.events.select("user_id").distinct().select("user_id", F.lit(0).alias("turns"), (F.col("user_id") < 0).alias("done"))
    advance = lambda d: d.withColumn("turns", F.when(F.col("done"), F.col("turns")).otherwise(F.col("turns") + 1)).withColumn("done", F.col("turns") >= F.col("user_id") % 4 + 1)
    return trajectory.rounds(start, advance, 8)[0]


def _run_folder(t: Tables) -> str:
    """A new folder that driver and executors share, for a stream's checkpoint."""
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(t: Tables) -> DataFrame:
    from .. import streaming

    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return streaming.event_time(raw)


@query("stm01_event_stream", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(max(value), 6) AS peak, round(avg(value), 6) AS mean FROM events GROUP BY time_bucket(INTERVAL '1 day', ts)")
def stm01(t: Tables) -> DataFrame:
    from .. import streaming

    found = streaming.run_available(streaming.window_summary(_event_stream(t), "ts", "value", "1 day", "40 days"), _run_folder(t), "complete")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", r6(F.col("peak")).alias("peak"), r6(F.col("mean")).alias("mean"))


@query("src13_metrics_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def src13(t: Tables) -> DataFrame:
    from .. import streaming

    return streaming.run_available(_event_stream(t).groupBy("event_type").agg(F.count("*").alias("n")), _run_folder(t), "complete")


@query("udf04_environment_stream", REPLAY)
def udf04(t: Tables) -> DataFrame:
    from .. import streaming

    trajectory.environment("shop", PROTOCOL)
    steps = _event_stream(t).select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type", (F.col("value") / 100).alias("value"))
    found = streaming.run_available(streaming.trajectories(steps, trajectory.environment("shop"), "user_id", "event_id", "event_type", "value"), _run_folder(t), "update")
    last = found.groupBy("user_id").agg(F.max_by(F.struct("steps", "done", "total_reward", "n_invalid"), "batch").alias("s"))
    return last.select("user_id", "s.steps", "s.done", r6(F.col("s.total_reward")).alias("total_reward"), "s.n_invalid")


@query("udf06_backend_factory", "SELECT doc_id, coalesce(regexp_extract(text, '[^\\s]+'), '') AS text FROM documents")
def udf06(t: Tables) -> DataFrame:
    from ..sources.readers import backend, generated
    from .relations import EchoClient

    backend("echo", EchoClient)
    return generated(t.documents.select("doc_id", F.col("text").alias("prompt")), backend("echo"), "doc_id", "prompt").select("doc_id", "text")


@query("udf08_builtin_aggregates", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, array_to_string(list_sort(list(DISTINCT source))[1:3], ',') AS sources FROM documents GROUP BY lang")
def udf08(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.array_join(F.slice(F.array_sort(F.collect_set("source")), 1, 3), ",").alias("sources"))


@query("snk05_summary", """SELECT '[' || chr(10) || string_agg('  {' || chr(10) || '    "lang": "' || lang || '",' || chr(10) || '    "n": ' || n || chr(10) || '  }', ',' || chr(10) ORDER BY lang) || chr(10) || ']' AS summary FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def snk05(t: Tables) -> DataFrame:
    from ..sources import writers

    return t.spark.createDataFrame([(writers.summary(t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")),)], "summary string")


@query("stm07_segmented_logs", "SELECT segment, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'a' AS segment, value FROM events WHERE event_id BETWEEN 0 AND 299 UNION ALL SELECT 'b', value FROM events WHERE event_id BETWEEN 300 AND 899) GROUP BY segment")
def stm07(t: Tables) -> DataFrame:
    d = series.merge_segments({"a": (t.events, 0, 299), "b": (t.events, 300, 899)}, "event_id")
    return d.groupBy("segment").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("udf01_reward_registry", f"SELECT doc_id, CASE WHEN contains(response, 'boxed') THEN 1.0 ELSE 0.0 END::DOUBLE AS boxed_format, CASE WHEN coalesce(list_last(regexp_extract_all(response, 'boxed\\{{(de|en|es|fr)\\}}', 1)), list_last(regexp_extract_all(response, '(de|en|es|fr)', 1))) = lang THEN 1.0 ELSE 0.0 END::DOUBLE AS label_accuracy FROM ({RESPONSES})")
def udf01(t: Tables) -> DataFrame:
    return registry.apply(responses(t), ["boxed_format", "label_accuracy"], response="response", label="lang").select("doc_id", "boxed_format", "label_accuracy")


@query("udf03_masked_metric", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN correct::DOUBLE END AS decision_accuracy FROM {SCORED}")
def udf03(t: Tables) -> DataFrame:
    return scored(t).select("doc_id", registry.for_task(F.col("doc_id") % 3 == 0, F.col("correct").cast("double")).alias("decision_accuracy"))


@query("udf05_accuracy_rewards", f"SELECT doc_id, CASE WHEN a IS NOT NULL AND upper(a) = upper(lang) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM (SELECT doc_id, lang, rtrim(list_last(list_filter(list_transform(regexp_extract_all(response, '<answer>(.*?)</answer>', 1, 'si'), lambda x: trim(x)), lambda x: x <> '')), '.') AS a FROM ({RESPONSES}))")
def udf05(t: Tables) -> DataFrame:
    return registry.apply(responses(t), ["answer_accuracy"], response="response", label="lang").select("doc_id", F.col("answer_accuracy").alias("reward"))


@query("udf09_batched_inference", "SELECT doc_id, coalesce(regexp_extract(text, '[^\\s]+'), '') AS text, -0.5 AS mean_logprob, len(regexp_extract_all(text, '[^\\s]+')) AS prompt_tokens, 1 AS completion_tokens FROM documents")
def udf09(t: Tables) -> DataFrame:
    from ..sources.readers import generated
    from .relations import EchoClient

    return generated(t.documents.select("doc_id", F.col("text").alias("prompt")), EchoClient, "doc_id", "prompt", 32).drop("elapsed_seconds")


@query("udf02_async_reward", f"SELECT doc_id, least(length(response) / 1e2, 1.0)::DOUBLE AS score FROM ({RESPONSES})")
def udf02(t: Tables) -> DataFrame:
    return registry.async_scores(responses(t).select("doc_id", "response"), "doc_id", "response", registry.LengthJudge)


@query("snk09_append_log", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def snk09(t: Tables) -> DataFrame:
    """The stream's rows appended to a log, and read from there."""
    from .. import streaming

    folder, steps = _run_folder(t), _event_stream(t).select("event_id", "event_type", "value")
    streaming.append_log(steps, f"{folder}/log", f"{folder}/checkpoint")
    return t.spark.read.schema(steps.schema).json(f"{folder}/log").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
