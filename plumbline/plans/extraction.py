"""Queries of text, JSON, array, number, hash and time functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, scores, text
from .base import LANGS, RESPONSES, Tables, h, query, r6, responses

R = f"({RESPONSES})"


def over_responses(name: str, sql: str, **columns) -> None:
    """A query of one or more expressions over the responses; ``sql`` is its select list."""

    @query(name, f"SELECT doc_id, {sql} FROM {R}")
    def run(t: Tables) -> DataFrame:
        d = responses(t)
        return d.select("doc_id", *(c(F.col("response")).alias(k) for k, c in columns.items()))


def last_of(pattern: str, of: str = "response", group: int = 1, options: str = "s") -> str:
    return f"list_last(list_filter(list_transform(regexp_extract_all({of}, '{pattern}', {group}, '{options}'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> ''))"


over_responses("str01_think_block", f"{last_of('<think>(.*?)</think>')} AS thinking", thinking=text.thinking)
over_responses(
    "str02_boxed",
    rf"coalesce(trim(list_last(regexp_extract_all(right(response, 1000), '\\boxed\{{([^{{}}]*)\}}', 1))), trim(list_last(regexp_extract_all(right(response, 1000), '####[ \t]*([^\n]+)', 1)))) AS answer",
    answer=text.boxed,
)
over_responses(
    "str03_label",
    r"coalesce(list_last(regexp_extract_all(response, '\\boxed\{\s*(de|en|es|fr)\s*\}', 1)), list_last(regexp_extract_all(response, '(de|en|es|fr)', 1))) AS label",
    label=lambda c: text.label_answer(c, LANGS),
)
over_responses("str04_answer_tag", f"{last_of('<answer>(.*?)</answer>', options='si')} AS answer", answer=text.answer_tag)
@query("str05_confidence", f"SELECT doc_id, CASE WHEN c BETWEEN 0 AND 1 THEN c END AS confidence FROM (SELECT doc_id, try_cast(regexp_extract_all(response, '<confidence>\\s*(.*?)\\s*</confidence>', 1)[1] AS DOUBLE) AS c FROM {R})")
def str05(t: Tables) -> DataFrame:
    return responses(t).select("doc_id", text.confidence(F.col("response")).alias("confidence"))


over_responses(
    "str06_strict_formats",
    r"""regexp_full_match(response, '\s*<think>.+?</think>\s*\\boxed\{[^{}]+\}\s*', 's') AS think_box,
regexp_full_match(response, '\s*\\boxed\{[^{}]+\}\s*') AS box_only, regexp_full_match(response, '\s*<think>.*?</think>\s*<answer>[^<]+</answer>\s*', 's') AND length(trim(regexp_extract(response, '<think>(.*?)</think>', 1, 's'))) BETWEEN 20 AND 12000 AS think_answer""",
    think_box=text.strict_think_box,
    box_only=text.strict_box_only,
    think_answer=text.strict_answer,
)


@query("str07_normal_answer", f"SELECT doc_id, regexp_replace(regexp_replace(upper(answer), '[\\s,，]', '', 'g'), '^[.。:：;；!！?？''\"()（）]+|[.。:：;；!！?？''\"()（）]+$', '', 'g') AS answer FROM (SELECT doc_id, {last_of('<answer>(.*?)</answer>', options='si')} AS answer FROM {R}) WHERE answer IS NOT NULL")
def str07(t: Tables) -> DataFrame:
    d = responses(t).select("doc_id", text.answer_tag(F.col("response")).alias("answer")).where("answer IS NOT NULL")
    return d.select("doc_id", text.normal_answer(F.col("answer")).alias("answer"))


@query(
    "str08_number_compare",
    f"""SELECT doc_id, try_cast(replace(a, ',', '') AS DECIMAL(38, 12))::DOUBLE AS number, coalesce(abs(try_cast(replace(a, ',', '') AS DECIMAL(38, 12)) - (1100 + doc_id % 900)) <= 0.00000001, trim(a) = CAST(1100 + doc_id % 900 AS VARCHAR)) AS same
FROM (SELECT doc_id, trim(list_last(regexp_extract_all(response, '####[ \\t]*([^\\n]+)', 1))) AS a FROM {R}) WHERE a IS NOT NULL""",
)
def str08(t: Tables) -> DataFrame:
    d = responses(t).select("doc_id", text.strip(text.last(text.all_matches(F.col("response"), r"####[ \t]*([^\n]+)"))).alias("a")).where("a IS NOT NULL")
    return d.select("doc_id", text.decimal_of(F.col("a")).cast("double").alias("number"), text.same_number(F.col("a"), (1100 + F.col("doc_id") % 900).cast("string")).alias("same"))


DISTINCT = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
NUMBERS = "list_transform(regexp_extract_all({c}, '([-+]?\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda v: regexp_replace(v, '[,$\\s+]', '', 'g'))"


@query("str09_number_set", f"SELECT doc_id, array_to_string(list_filter(n, lambda v, i: list_position(n, v) = i), '|') AS numbers FROM (SELECT doc_id, {NUMBERS.format(c='response')} AS n FROM {R})")
def str09(t: Tables) -> DataFrame:
    return responses(t).select("doc_id", F.array_join(text.numbers(F.col("response")), "|").alias("numbers"))


@query("str10_equations")
def str10(t: Tables) -> DataFrame:
    from ..functions.equations import check_equations

    asked = responses(t).select("doc_id", "response", F.concat(F.lit("Of 12 and "), (F.col("doc_id") % 30).cast("string")).alias("question"), F.lit("42").alias("answer"))
    return check_equations(asked, "doc_id", "response", "question", "answer")


@query("str11_state_tokens", "SELECT doc_id, len(list_distinct(w))::BIGINT AS n, array_to_string(list_sort(list_distinct(w))[1:5], '|') AS head FROM (SELECT doc_id, regexp_extract_all(lower(text), '([\\x{4e00}-\\x{9fff}]|[a-z0-9_]+)', 1) AS w FROM documents)")
def str11(t: Tables) -> DataFrame:
    w = text.state_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(F.slice(F.array_sort(w), 1, 5), "|").alias("head"))


CJK = "'政治a经济 b12 ' || source || '法'"


@query(
    "str12_search_tokens",
    f"""SELECT doc_id, array_to_string(list_concat(list_concat(regexp_extract_all(lower(s), '([a-z0-9_]+)', 1), runs), flatten(list_transform(runs, lambda r: list_transform(range(1, length(r)), lambda k: r[k:k+1])))), '|') AS tokens
FROM (SELECT doc_id, s, regexp_extract_all(s, '([\\x{{4e00}}-\\x{{9fff}}]+)', 1) AS runs FROM (SELECT doc_id, {CJK} AS s FROM documents))""",
)
def str12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.expr(CJK).alias("s")).select("doc_id", F.array_join(text.search_tokens(F.col("s")), "|").alias("tokens"))


@query(
    "str13_feature_tokens",
    f"""SELECT doc_id, array_to_string(list_concat(list_concat(regexp_extract_all(lower(s), '([a-z0-9][a-z0-9_.+-]*)', 1), flatten(list_transform(runs, lambda r: list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda k: r[k:k+1]))))),
list_filter([CASE WHEN contains(s, '政治') OR contains(s, '法') THEN 'concept:state' END, CASE WHEN contains(s, 'src1') THEN 'concept:first' END], lambda x: x IS NOT NULL)), '|') AS tokens
FROM (SELECT doc_id, s, regexp_extract_all(lower(s), '([\\x{{3400}}-\\x{{9fff}}]+)', 1) AS runs FROM (SELECT doc_id, {CJK} AS s FROM documents))""",
)
def str13(t: Tables) -> DataFrame:
    concepts = {"state": ["政治", "法"], "first": ["src1"]}
    return t.documents.select("doc_id", F.expr(CJK).alias("s")).select("doc_id", F.array_join(text.feature_tokens(F.col("s"), concepts), "|").alias("tokens"))


WORDS = "regexp_extract_all(lower({c}), '([a-z0-9_]+)', 1)"


@query(
    "str14_jaccard",
    f"""SELECT doc_id, CASE WHEN len(u) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(u), 6) END::DOUBLE AS similarity
FROM (SELECT doc_id, a, b, list_distinct(list_concat(a, b)) AS u FROM (SELECT doc_id, list_distinct({WORDS.format(c='text')}) AS a, list_distinct({WORDS.format(c='substr(text, strpos(text, chr(10)) + 1)')}) AS b FROM documents))""",
)
def str14(t: Tables) -> DataFrame:
    a, b = text.state_tokens(F.col("text")), text.state_tokens(F.expr("substr(text, locate('\\n', text) + 1)"))
    return t.documents.select("doc_id", r6(text.jaccard(a, b)).alias("similarity"))


@query("str15_keyword_count", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'de', ''))) // 2)::BIGINT AS hits FROM documents")
def str15(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (text.occurrences(F.col("text"), "the") + text.occurrences(F.col("text"), "de")).alias("hits"))


@query("str16_evidence_coverage", "SELECT doc_id, round((contains(text, 'the')::INTEGER + contains(text, 'ion')::INTEGER + contains(text, 'zzz')::INTEGER) / 3.0::DOUBLE, 6) AS coverage FROM documents")
def str16(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", r6(text.coverage(F.col("text"), F.lit("the|||ion|||zzz"))).alias("coverage"))


@query("str17_consistency", f"SELECT doc_id, contains(thinking, answer) AS consistent FROM (SELECT doc_id, {last_of('<think>(.*?)</think>')} AS thinking, list_last(regexp_extract_all(response, '(de|en|es|fr)', 1)) AS answer FROM {R}) WHERE thinking IS NOT NULL")
def str17(t: Tables) -> DataFrame:
    d = responses(t).select("doc_id", text.thinking(F.col("response")).alias("thinking"), text.last(text.all_matches(F.col("response"), "(de|en|es|fr)")).alias("answer")).where("thinking IS NOT NULL")
    return d.select("doc_id", F.contains("thinking", F.col("answer")).alias("consistent"))


@query(
    "str18_grounding",
    f"""SELECT doc_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, r))::DOUBLE / len(q), 6) ELSE 0 END::DOUBLE AS grounding
FROM (SELECT doc_id, list_distinct({NUMBERS.format(c="('12 of 30 and ' || doc_id)")}) AS q, list_distinct({NUMBERS.format(c='response')}) AS r FROM {R})""",
)
def str18(t: Tables) -> DataFrame:
    question = F.concat(F.lit("12 of 30 and "), F.col("doc_id").cast("string"))
    return responses(t).select("doc_id", r6(text.grounding(question, F.col("response"))).alias("grounding"))


over_responses("str19_failure_words", "contains(response, 'cannot see') OR contains(response, 'no image') OR contains(response, 'unable to') AS failed", failed=lambda c: text.mentions(c, ["cannot see", "no image", "unable to"]))


@query("str20_display", "SELECT doc_id, printf('doc-%04d', doc_id) AS id, printf('%.4f', n_chars / 7e0) AS fixed, printf('%+.2f', n_chars / 7e0 - 100) AS signed, printf('%.1f%%', n_chars % 1000 / 1e1) AS percent, regexp_replace(regexp_replace(printf('%.3f', n_chars / 8e0), '0+$', ''), '\\.$', '') AS plain FROM documents")
def str20(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.documents.select("doc_id", text.padded_id("doc", F.col("doc_id")).alias("id"), F.format_string("%.4f", n / 7.0).alias("fixed"), F.format_string("%+.2f", n / 7.0 - 100).alias("signed"), F.format_string("%.1f%%", n % 1000 / 10.0).alias("percent"), text.plain_number(n / 8.0, 3).alias("plain"))


# JSON

MEMORY = """'note <memory>{"rule_ids": ["r' || CAST(doc_id % 5 AS STRING) || '", "r1"], "decision": "' || CASE doc_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REJECT' ELSE 'other' END || '", "facts": ["f"], "priority": ' || CASE doc_id % 4 WHEN 0 THEN '"7"' WHEN 1 THEN '3' ELSE 'null' END || '}' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '</memory>' END"""


@query(
    "jsn01_tagged_json",
    f"""SELECT doc_id, j IS NOT NULL AS valid, coalesce(array_to_string(list_filter(from_json(j->'rule_ids', '["VARCHAR"]'), lambda v, i: list_position(from_json(j->'rule_ids', '["VARCHAR"]'), v) = i), ','), '') AS rule_ids, CASE WHEN j->>'decision' IN ('PASS', 'REVIEW', 'REJECT') THEN j->>'decision' ELSE 'REVIEW' END AS decision, coalesce(try_cast(j->>'priority' AS INTEGER), 0) AS priority
FROM (SELECT doc_id, try_cast(nullif(regexp_extract(m, '<memory>\\s*(\\{{.*\\}})\\s*</memory>', 1, 's'), '') AS JSON) AS j FROM (SELECT doc_id, {MEMORY} AS m FROM documents))""",
)
def jsn01(t: Tables) -> DataFrame:
    from ..functions.json import tagged_memory

    d = t.documents.select("doc_id", tagged_memory(F.expr(MEMORY)).alias("m"))
    return d.select("doc_id", "m.valid", F.array_join("m.rule_ids", ",").alias("rule_ids"), "m.decision", "m.priority")


@query("jsn02_tolerant_scan", """SELECT doc_id, '{"decision": {"k": "}"}, "n": ' || doc_id || '}' AS found FROM documents""")
def jsn02(t: Tables) -> DataFrame:
    from ..functions.json import first_object_with

    noisy = F.concat(F.lit("x {not json} {\"a\": 1} {\"decision\": {\"k\": \"}\"}, \"n\": "), F.col("doc_id").cast("string"), F.lit("} tail"))
    return first_object_with(t.documents.select("doc_id", noisy.alias("reply")), "doc_id", "reply", "decision")


ACTION = """CASE doc_id % 4 WHEN 0 THEN '<think>x</think>{"action": "search", "k": 3}' WHEN 1 THEN 'well {"action": "finish"} ok' WHEN 2 THEN 'no action' ELSE '<think>x</think>{"action": "broken"' END"""


@query("jsn03_action", f"""SELECT doc_id, CASE WHEN regexp_full_match(a, '\\s*<think>.+?</think>\\s*\\{{.*\\}}\\s*', 's') THEN 1.0 WHEN regexp_matches(a, '\\{{.*\\}}') THEN 0.5 ELSE 0.0 END::DOUBLE AS protocol, json_extract_string(try_cast(nullif(regexp_extract(a, '(\\{{.*\\}})', 1, 's'), '') AS JSON), '$.action') AS action FROM (SELECT doc_id, {ACTION} AS a FROM documents)""")
def jsn03(t: Tables) -> DataFrame:
    from ..functions.json import parsed_action

    d = t.documents.select("doc_id", parsed_action(F.expr(ACTION)).alias("a"))
    return d.select("doc_id", "a.protocol", "a.action")


@query("jsn04_canonical", """SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents""")
def jsn04(t: Tables) -> DataFrame:
    from ..sources.writers import canonical

    return t.documents.select("doc_id", F.sha2(canonical("source", "n_chars", "lang"), 256).alias("digest"))


@query("jsn05_regex_ids", f"SELECT doc_id, array_to_string(list_filter(n, lambda v, i: list_position(n, v) = i), ',') AS ids FROM (SELECT doc_id, regexp_extract_all(response, '(rule-\\d+)', 1) AS n FROM {R})")
def jsn05(t: Tables) -> DataFrame:
    return responses(t).select("doc_id", F.array_join(text.first_ids(F.col("response"), r"rule-\d+"), ",").alias("ids"))


@query("jsn06_coercion", "SELECT doc_id, greatest(1, least(20, coalesce(try_cast(k AS INTEGER), 5))) AS k FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '99' WHEN 1 THEN 'x' WHEN 2 THEN '-3' ELSE CAST(doc_id % 30 AS VARCHAR) END AS k FROM documents)")
def jsn06(t: Tables) -> DataFrame:
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN '99' WHEN 1 THEN 'x' WHEN 2 THEN '-3' ELSE CAST(doc_id % 30 AS STRING) END")
    return t.documents.select("doc_id", arrays.clamped_int(raw, 1, 20, 5).alias("k"))


@query("jsn07_finish_schema", f"""SELECT doc_id, a = 'search' AS known, a IS NOT NULL AND a IN ('search', 'finish') AS listed FROM (SELECT doc_id, json_extract_string(try_cast(nullif(regexp_extract(a, '(\\{{.*\\}})', 1, 's'), '') AS JSON), '$.action') AS a FROM (SELECT doc_id, {ACTION} AS a FROM documents))""")
def jsn07(t: Tables) -> DataFrame:
    from ..functions.json import parsed_action

    d = t.documents.select("doc_id", parsed_action(F.expr(ACTION))["action"].alias("a"))
    return d.select("doc_id", (F.col("a") == "search").alias("known"), F.coalesce(F.col("a").isin("search", "finish"), F.lit(False)).alias("listed"))


@query("jsn08_set_algebra", "SELECT doc_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, len(list_distinct(list_concat(a, b)))::BIGINT AS n_any, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a FROM (SELECT doc_id, [lang, source, 'x'] AS a, ['en', 'src0', 'y'] AS b FROM documents)")
def jsn08(t: Tables) -> DataFrame:
    a, b = F.array("lang", "source", F.lit("x")), F.array(F.lit("en"), F.lit("src0"), F.lit("y"))
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("both"), F.size(F.array_union(a, b)).cast("long").alias("n_any"), F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("only_a"))


@query("jsn09_subsequence", "SELECT doc_id, coalesce(list_min(list_filter(range(0, 6), lambda i: xs[i + 1] = 1 AND xs[i + 2] = 2)), -1)::INTEGER AS at FROM (SELECT doc_id, [doc_id % 2, doc_id % 3, 1, 2, doc_id % 5, 0, 0] AS xs FROM documents)")
def jsn09(t: Tables) -> DataFrame:
    xs = F.expr("array(doc_id % 2, doc_id % 3, 1L, 2L, doc_id % 5, 0L, 0L)")
    return t.documents.select("doc_id", arrays.find(xs, F.expr("array(1L, 2L)")).cast("int").alias("at"))


# numbers, hashes, time


def over_documents(name: str, sql: str, **columns) -> None:
    """A query of expressions over the documents, each made when it runs: ``sql`` is its select list."""

    @query(name, f"SELECT doc_id, {sql} FROM documents")
    def run(t: Tables) -> DataFrame:
        return t.documents.select("doc_id", *(c().alias(k) for k, c in columns.items()))


def _chars() -> Column:
    return F.col("n_chars").cast("double")


def _unit() -> Column:
    return scores.hash_unit(F.col("doc_id"))


def _some() -> Column:
    return F.when(F.col("doc_id") % 5 != 0, _unit())


def _parity() -> Column:
    return (F.col("doc_id") % 2).cast("double")


UNIT = f"({h('doc_id', 1000)} / 1e3)"
over_documents(
    "mth01_sigmoid_logit",
    f"round(1 / (1 + exp(-greatest(-30, least(30, n_chars / 1e3 - 1)))), 6) AS sigmoid, round(ln(greatest(1e-6, least(1 - 1e-6, {UNIT})) / (1 - greatest(1e-6, least(1 - 1e-6, {UNIT})))), 6) AS logit",
    sigmoid=lambda: r6(scores.sigmoid(_chars() / 1000 - 1)),
    logit=lambda: r6(scores.logit(_unit())),
)
over_documents("mth02_exp_logprob", f"round(exp(greatest(-30, least(0, {UNIT} * -40 + 1))), 6) AS p", p=lambda: r6(scores.exp_logprob(_unit() * -40 + 1)))
over_documents("mth03_log_share", f"round(ln(greatest({UNIT} - 0.2, 0) / 3.0 + 1e-12), 6) AS log_share", log_share=lambda: r6(scores.log_share(_unit() - 0.2, F.lit(3.0))))


@query("mth04_feature_hashing")
def mth04(t: Tables) -> DataFrame:
    from ..functions.hashing import hashed_features

    return hashed_features(t.documents.select("doc_id", text.words(F.col("text")).alias("tokens")), "doc_id", "tokens")


over_documents(
    "mth05_hash_ids",
    f"sha256(doc_id || ':' || lang) AS sha256, sha1(doc_id || ':' || lang)[1:10] AS sha1, {h('doc_id', 97)} AS bucket",
    sha256=lambda: F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "lang"), 256),
    sha1=lambda: F.substring(F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), "lang")), 1, 10),
    bucket=lambda: scores.hash_int(F.col("doc_id"), 97),
)
CLIPPED = f"greatest(0.01, least(0.99, {UNIT}))"
over_documents(
    "mth06_proper_scores",
    f"round(CASE WHEN doc_id % 5 = 0 THEN -1 ELSE -power({UNIT} - doc_id % 2, 2) END, 6) AS brier, round(CASE WHEN doc_id % 5 = 0 THEN ln(0.01) WHEN doc_id % 2 = 1 THEN ln({CLIPPED}) ELSE ln(1 - {CLIPPED}) END, 6) AS log_score",
    brier=lambda: r6(scores.brier_reward(_some(), _parity())),
    log_score=lambda: r6(scores.log_reward(_some(), _parity())),
)
over_responses("mth07_judge_score", r"coalesce(try_cast(list_last(regexp_extract_all(response, '\[\[\s*([0-4](?:\.\d+)?)\s*\]\]', 1)) AS DOUBLE), 0) / 4 AS score", score=text.judge_score)
over_documents("mth08_blend", f"round(0.52 * {UNIT} + 0.38 * {h('lang', 100)} / 1e2 + 0.10 * (doc_id % 2), 6) AS blend", blend=lambda: r6(scores.blend(a=(0.52, _unit()), b=(0.38, scores.hash_unit(F.col("lang"), 100)), c=(0.10, _parity()))))


@query(
    "mth09_exact_arithmetic",
    "WITH d AS (SELECT doc_id, doc_id % 40 + 1 AS n, doc_id % 7 AS k FROM documents), e AS (SELECT doc_id, n, unnest(range(0, least(n, k) + 1)) AS i FROM d) SELECT doc_id, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 9) AS tail FROM e GROUP BY doc_id",
)
def mth09(t: Tables) -> DataFrame:
    from ..functions.equations import binomial_tail

    return binomial_tail(t.documents.select("doc_id", (F.col("doc_id") % 40 + 1).alias("n"), (F.col("doc_id") % 7).alias("k")), "doc_id").withColumn("tail", F.round("tail", 9))


@query("tim01_iso_epoch", "SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS epoch FROM events")
def tim01(t: Tables) -> DataFrame:
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return t.events.select("event_id", F.round(F.unix_micros(F.to_timestamp(iso)) / 1e6, 3).alias("epoch"))


@query("tim02_run_id")
def tim02(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.date_format(F.current_timestamp(), "'run_'yyyyMMdd'T'HHmmss'Z'").alias("run_id"))


@query("tim03_stage_duration", "SELECT event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration FROM events GROUP BY event_type")
def tim03(t: Tables) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.groupBy("event_type").agg(F.round(F.max(ts) - F.min(ts), 3).alias("duration"))
