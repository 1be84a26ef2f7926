"""Queries of message arrays and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import shape
from .base import LANGS, RESPONSES, SCORED, Tables, h, long, query, r6, responses, scored

WRONG = f"['de', 'en', 'es', 'fr'][(list_position(['de', 'en', 'es', 'fr'], lang) - 1 + {h('doc_id', 3)} + 1) % 4 + 1]"


@query("prj01_answer_split", f"SELECT doc_id, CASE WHEN contains(response, '####') THEN trim(string_split(response, chr(10) || '####')[1]) END AS reason, CASE WHEN contains(response, '####') THEN trim(string_split(response, '####')[2]) END AS final FROM ({RESPONSES}) WHERE doc_id % 8 IN (2, 4)")
def prj01(t: Tables) -> DataFrame:
    reason, final = shape.split_answer(F.col("response"))
    return responses(t).where(F.col("doc_id") % 8 == 2).select("doc_id", reason.alias("reason"), final.alias("final")).unionByName(responses(t).where(F.col("doc_id") % 8 == 4).select("doc_id", reason.alias("reason"), final.alias("final")))


def _views(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("text").alias("q"), F.col("source").alias("r"), F.col("lang").alias("a"))
    return shape.views(d, "q", "r", "a", "doc_id")


@query(
    "prj02_six_views",
    """SELECT doc_id, view, teacher_tag, n_messages, last_content FROM (SELECT doc_id, unnest([
{'view': 'cot', 'teacher_tag': 'cot', 'n_messages': 2::BIGINT, 'last_content': c}, {'view': 'direct', 'teacher_tag': 'direct', 'n_messages': 2, 'last_content': lang},
{'view': 'mixed', 'teacher_tag': CASE WHEN doc_id % 2 = 0 THEN 'cot' ELSE 'direct' END, 'n_messages': 2, 'last_content': CASE WHEN doc_id % 2 = 0 THEN c ELSE lang END},
{'view': 'prompts_cot', 'teacher_tag': 'cot', 'n_messages': 1, 'last_content': q}, {'view': 'prompts_direct', 'teacher_tag': 'direct', 'n_messages': 1, 'last_content': q},
{'view': 'prompts_multi', 'teacher_tag': CASE WHEN doc_id % 2 = 0 THEN 'cot' ELSE 'direct' END, 'n_messages': 1, 'last_content': q}], recursive := true)
FROM (SELECT doc_id, lang, text AS q, '<think>' || source || '</think>' || lang AS c FROM documents))""",
)
def prj02(t: Tables) -> DataFrame:
    return _views(t).select("doc_id", "view", "teacher_tag", F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last_content"))


@query(
    "prj03_alignment_views",
    f"""SELECT doc_id AS record_id, view, k AS n_rows, digest FROM (SELECT doc_id, unnest([{{'view': 'sft', 'k': 1::BIGINT, 'digest': lang}}, {{'view': 'prompts', 'k': 1, 'digest': ''}}, {{'view': 'pairwise', 'k': 1, 'digest': {WRONG}}}, {{'view': 'rm', 'k': 2, 'digest': {WRONG}}}, {{'view': 'kto', 'k': 2, 'digest': {WRONG}}}, {{'view': 'opsd', 'k': 1, 'digest': 'The answer is ' || lang || '. Explain it.'}}], recursive := true) FROM documents)""",
)
def prj03(t: Tables) -> DataFrame:
    v = shape.alignment_views(t.documents.withColumn("q", F.col("text")), "q", "lang", "doc_id", LANGS)
    each = {
        "sft": F.first("label"),
        "prompts": F.lit(""),
        "pairwise": F.first("rejected_response"),
        "rm": F.max(F.when(F.col("negative_type") == "wrong_label", F.col("rejected_response"))),
        "kto": F.max(F.when(~F.col("label"), F.col("answer"))),
        "opsd": F.first("teacher_prompt"),
    }
    out = None
    for name, digest in each.items():
        d = v[name].groupBy("record_id").agg(F.count("*").alias("n_rows"), F.max(digest).alias("digest") if name == "prompts" else digest.alias("digest")).withColumn("view", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out.select("record_id", "view", "n_rows", "digest")


CHAT = "(SELECT conv_id, list({'turn': turn, 'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


def _chat(t: Tables) -> DataFrame:
    return shape.conversations(t.conversations)


@query("prj04_prompt_only", f"SELECT conv_id, len(list_filter(m, lambda x: x.role <> 'assistant'))::BIGINT AS n, md5(array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'assistant'), lambda x: x.content), '|')) AS digest FROM {CHAT}")
def prj04(t: Tables) -> DataFrame:
    d = _chat(t).select("conv_id", shape.prompt_only(F.col("messages")).alias("m"))
    return d.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "|")).alias("digest"))


@query("prj05_user_message", f"SELECT conv_id, list_last(list_filter(m, lambda x: x.role = 'user')).content AS last, list_first(list_filter(m, lambda x: x.role = 'user')).content AS first FROM {CHAT}")
def prj05(t: Tables) -> DataFrame:
    m = F.col("messages")
    return _chat(t).select("conv_id", shape.user_message(m, -1).alias("last"), shape.user_message(m, 1).alias("first"))


@query("prj06_system_prompt", f"SELECT conv_id, (1 + len(list_filter(m, lambda x: x.role <> 'system')))::BIGINT AS n, 'Think first.' AS head FROM {CHAT}")
def prj06(t: Tables) -> DataFrame:
    d = _chat(t).select("conv_id", shape.with_system(F.col("messages"), "Think first.").alias("m"))
    return d.select("conv_id", F.size("m").cast("long").alias("n"), F.get("m", F.lit(0))["content"].alias("head"))


@query("prj07_last_user_rewrite", f"SELECT conv_id, md5(array_to_string(list_transform(m, lambda x, i: CASE WHEN i = list_max(list_filter(list_transform(m, lambda y, j: CASE WHEN y.role = 'user' THEN j END), lambda z: z IS NOT NULL)) THEN 'teacher' ELSE x.content END), '|')) AS digest FROM {CHAT}")
def prj07(t: Tables) -> DataFrame:
    d = _chat(t).select("conv_id", shape.rewrite_last_user(F.col("messages"), F.lit("teacher")).alias("m"))
    return d.select("conv_id", F.md5(F.array_join(F.transform("m", lambda x: x["content"]), "|")).alias("digest"))


@query("prj08_template_strip", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN text END AS inner_text FROM documents")
def prj08(t: Tables) -> DataFrame:
    wrapped = F.concat(F.when(F.col("doc_id") % 4 != 0, "Article: ").otherwise("Text: "), F.col("text"), F.lit(" End."))
    return t.documents.select("doc_id", shape.strip_template(wrapped, "Article: ", " End.").alias("inner_text"))


@query("prj09_body", r"SELECT doc_id, md5(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 600)) AS digest FROM documents")
def prj09(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.body(F.col("text"))).alias("digest"))


@query("prj10_sanitise", "SELECT doc_id, replace(replace(replace('<think>' || text || '</think>' || chr(7), chr(7), ' '), '<think>', '＜think＞'), '</think>', '＜/think＞') AS clean FROM documents")
def prj10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", shape.sanitise(F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\x07"))).alias("clean"))


@query("prj11_candidate_pairs", f"SELECT doc_id, c.candidate_label AS candidate_label, c.candidate_correct AS candidate_correct FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 10 = 0 THEN [{{'candidate_label': ['de', 'en', 'es', 'fr'][{h('doc_id', 4)} + 1], 'candidate_correct': false}}] ELSE [{{'candidate_label': lang, 'candidate_correct': true}}, {{'candidate_label': ['de', 'en', 'es', 'fr'][list_position(['de', 'en', 'es', 'fr'], lang) % 4 + 1], 'candidate_correct': false}}] END) AS c FROM documents)")
def prj11(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", (F.col("doc_id") % 10 == 0).alias("is_ood"))
    return shape.candidate_pairs(d, "doc_id", "lang", LANGS, "is_ood").select("doc_id", "candidate_label", "candidate_correct")


@query("prj12_calibration_rows", f"SELECT doc_id, round(({h('doc_id', 9)} + 1) / 1e1, 6) AS placeholder, '<answer>' || lang || '</answer><confidence>' || printf('%.1f', ({h('doc_id', 9)} + 1) / 1e1) || '</confidence>' AS response FROM documents")
def prj12(t: Tables) -> DataFrame:
    return shape.calibration_rows(t.documents, "doc_id", "lang").select("doc_id", r6(F.col("placeholder")).alias("placeholder"), "response")


@query("prj13_wrong_class", f"SELECT doc_id, {WRONG} AS wrong FROM documents")
def prj13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scores.other_label(LANGS, F.col("lang"), F.col("doc_id")).alias("wrong"))


@query("prj14_graded_candidates", "SELECT doc_id, score, (n_chars + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END * CASE score WHEN 5 THEN 0 WHEN 4 THEN 1 WHEN 3 THEN 5 WHEN 2 THEN 20 ELSE 100 END)::BIGINT AS candidate FROM documents, (VALUES (1), (2), (3), (4), (5)) s(score)")
def prj14(t: Tables) -> DataFrame:
    return shape.graded_candidates(t.documents, "doc_id", "n_chars")


@query("prj15_tasks", "SELECT doc_id, task, CASE WHEN task = 'decision' THEN 6 ELSE 4 END AS max_steps FROM documents, (VALUES ('retrieve'), ('compose'), ('decision')) t(task)")
def prj15(t: Tables) -> DataFrame:
    return shape.tasks(t.documents.select("doc_id"), "doc_id")


@query("prj16_explode_regroup", "SELECT doc_id, array_to_string(list_transform(p, lambda x: '<' || x), '|') AS joined, len(p)::BIGINT AS n_parts FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def prj16(t: Tables) -> DataFrame:
    parts = shape.exploded_in_order(t.documents, "doc_id", F.split("text", "\n")).withColumn("part", F.concat(F.lit("<"), "part"))
    return shape.regrouped(parts, "doc_id")


@query("prj17_ids", "SELECT doc_id, printf('%s-%04d', lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS record_id FROM documents")
def prj17(t: Tables) -> DataFrame:
    d = shape.with_ordinal(t.documents.select("doc_id", "lang"), ["doc_id"], ["lang"])
    return d.select("doc_id", F.format_string("%s-%04d", "lang", "ordinal").alias("record_id"))


@query("prj18_defaults", "SELECT doc_id, coalesce(nullif(lang, 'en'), source, 'x') AS value FROM documents")
def prj18(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", shape.defaults(F.nullif("lang", F.lit("en")), F.col("source"), F.lit("x")).alias("value"))


@query("prj19_nested_path", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN round(n_chars / 3e0, 6) ELSE 0 END::DOUBLE AS value FROM documents")
def prj19(t: Tables) -> DataFrame:
    nested = F.when(F.col("doc_id") % 3 != 0, F.struct(F.struct((F.col("n_chars") / 3).alias("b")).alias("a")))
    return t.documents.select("doc_id", nested.alias("s")).select("doc_id", r6(F.coalesce("s.a.b", F.lit(0.0))).alias("value"))


@query("prj20_public_fields", "SELECT p_partkey, '{\"p_partkey\":' || p_partkey || ',\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}' AS line FROM part")
def prj20(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", shape.public_fields(["p_partkey", "p_brand", "p_size"]).alias("line"))


@query("prj21_clue", "SELECT doc_id, md5(list_last(list_filter(list_transform(string_split(replace('Clue: ' || text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''))) AS digest FROM documents")
def prj21(t: Tables) -> DataFrame:
    c = F.replace(F.concat(F.lit("Clue: "), "text"), F.lit("\n"), F.lit("\n\n"))
    return t.documents.select("doc_id", F.md5(shape.clue(c)).alias("digest"))


@query("prj22_prompt_template", "SELECT doc_id, 'Language ' || lang || ', source ' || source || ': ' || text || '?' AS prompt FROM documents")
def prj22(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.format_string("Language %s, source %s: %s?", "lang", "source", "text").alias("prompt"))


@query("prj23_multimodal", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'choice' END AS modality, (CASE doc_id % 3 WHEN 0 THEN '' ELSE '<image>' END || text || CASE doc_id % 3 WHEN 2 THEN chr(10) || 'A' || chr(10) || 'B' ELSE '' END) AS content, CASE WHEN doc_id % 3 = 2 THEN 2 END AS n_options FROM documents")
def prj23(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    none = F.array().cast("array<string>")
    options = F.when(k == 2, F.array(F.lit("A"), F.lit("B"))).otherwise(none)
    images = F.when(k == 0, none).otherwise(F.array(F.lit("a.png")))
    d = shape.multimodal(t.documents.select("doc_id", "text"), F.col("text"), options, images, F.when(k == 0, "text").when(k == 1, "image").otherwise("choice"))
    return d.select("doc_id", "modality", F.get("messages", F.lit(0))["content"].alias("content"), F.when(F.col("options").isNotNull(), F.size("options")).alias("n_options"))


@query("prj24_rule_clones", "SELECT printf('clone-%05d', c.range) AS clone_id, n_name FROM range(80) c JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) n ON n.k = c.range % 25")
def prj24(t: Tables) -> DataFrame:
    return shape.cloned(t.nation, "n_nationkey", 80).select("clone_id", "n_name")


@query("prj25_qa_expansion", "SELECT n_nationkey, CASE WHEN k < 8 THEN 'train' ELSE 'val' END AS split, k::INTEGER AS template, 'q' || k || ': what does rule ' || n_nationkey || ' say on ' || n_name || '?' AS question FROM nation, (SELECT unnest(range(10)) AS k)")
def prj25(t: Tables) -> DataFrame:
    return shape.qa_rows(t.nation, "n_nationkey", "n_name")


@query("prj26_case_synthesis", "SELECT lang, a.k AS ordinal, doc_id, l_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) a JOIN (SELECT p_partkey AS l_id, CASE p_size % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS lang, row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) - 1 AS k FROM part) b USING (lang, k)")
def prj26(t: Tables) -> DataFrame:
    rules = t.part.select(F.col("p_partkey").alias("l_id"), F.element_at(F.array(*(F.lit(x) for x in LANGS)), (F.col("p_size") % 4 + 1).cast("int")).alias("lang"))
    return shape.paired_cases(t.documents, rules, "lang", "doc_id", "l_id").withColumn("ordinal", long("ordinal"))


@query("prj28_searchable", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, array_to_string([p_type, 'size' || p_size], ' ')) AS body FROM part")
def prj28(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", shape.searchable([F.col("p_name"), F.col("p_brand")], [F.array("p_type", F.concat(F.lit("size"), F.col("p_size").cast("string")))]).alias("body"))


@query("prj29_evidence_views", "SELECT doc_id, 'The text names “' || source || '”、“' || lang || '”, so it is ' || lang || '.' AS reason FROM documents")
def prj29(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", shape.evidence_reason(F.array("source", "lang"), F.col("lang")).alias("reason"))


@query("prj30_parse_normalise", f"SELECT doc_id, coalesce(list_last(regexp_extract_all(response, '(de|en|es|fr)', 1)), 'unknown') AS label, length(response)::BIGINT AS completion_chars, contains(response, 'boxed') AS valid FROM ({RESPONSES})")
def prj30(t: Tables) -> DataFrame:
    c = F.col("response")
    return responses(t).select("doc_id", F.coalesce(text.last(text.all_matches(c, "(de|en|es|fr)")), F.lit("unknown")).alias("label"), F.length(c).cast("long").alias("completion_chars"), F.contains(c, F.lit("boxed")).alias("valid"))
