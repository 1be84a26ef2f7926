"""Message arrays and the views built from labelled rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from .ordered import running

MESSAGE = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(*parts: tuple[str, Column]) -> Column:
    return F.array(*(message(r, c) for r, c in parts))


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns gathered into one message array per conversation, in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def prompt_only(m: Column) -> Column:
    return F.filter(m, lambda x: x["role"] != "assistant")


def user_message(m: Column, which: int = -1) -> Column:
    """Content of the last (-1) or first (1) user message; null if there is none."""
    return F.try_element_at(F.filter(m, lambda x: x["role"] == "user"), F.lit(which))["content"]


def with_system(m: Column, content: str) -> Column:
    """A given system prompt first, in place of any there is."""
    return F.concat(F.array(message("system", F.lit(content))), F.filter(m, lambda x: x["role"] != "system"))


def rewrite_last_user(m: Column, content: Column) -> Column:
    places = F.filter(F.transform(m, lambda x, i: F.when(x["role"] == "user", i)), lambda i: i.isNotNull())
    at = F.array_max(places)
    return F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), F.when(i == at, content).otherwise(x["content"]).alias("content")))


def split_answer(c: Column) -> tuple[Column, Column]:
    """Reasoning and final answer around the last ``#### `` marker; both null without one."""
    reason = F.regexp_extract(c, r"(?s)^(.*?)\s*\n?####[ \t]*([^\n]*?)\s*\z", 1)
    final = F.regexp_extract(c, r"(?s)^(.*?)\s*\n?####[ \t]*([^\n]*?)\s*\z", 2)
    has = F.contains(c, F.lit("####"))
    return F.when(has, reason), F.when(has, final)


def views(rows: DataFrame, question: str, reason: str, final: str, ordinal: str) -> DataFrame:
    """Six views of each row: cot, direct, mixed by parity, and three prompt-only ones."""
    q, r, a = F.col(question), F.col(reason), F.col(final)
    cot = messages(("user", q), ("assistant", F.concat(F.lit("<think>"), r, F.lit("</think>"), a)))
    direct = messages(("user", q), ("assistant", a))
    even = F.col(ordinal) % 2 == 0
    kinds = [
        ("cot", F.lit("cot"), cot),
        ("direct", F.lit("direct"), direct),
        ("mixed", F.when(even, "cot").otherwise("direct"), F.when(even, cot).otherwise(direct)),
        ("prompts_cot", F.lit("cot"), prompt_only(cot)),
        ("prompts_direct", F.lit("direct"), prompt_only(direct)),
        ("prompts_multi", F.when(even, "cot").otherwise("direct"), prompt_only(cot)),
    ]
    each = F.array(*(F.struct(F.lit(v).alias("view"), tag.alias("teacher_tag"), m.alias("messages")) for v, tag, m in kinds))
    return rows.select("*", F.explode(each).alias("_v")).select(*rows.columns, "_v.view", "_v.teacher_tag", "_v.messages")


def alignment_views(rows: DataFrame, prompt: str, label: str, key: str, labels: Sequence[str]) -> dict[str, DataFrame]:
    """Preference and prompt views of labelled rows, one or two rows for each."""
    wrong = scores.other_label(list(labels), F.col(label), F.col(key))
    chat = lambda c: messages(("user", F.col(prompt)), ("assistant", c))
    base = rows.select(F.col(key).alias("record_id"), F.col(label).alias("label"), F.col(prompt), wrong.alias("wrong"))
    both = F.inline
    return {
        "sft": base.select("record_id", "label", chat(F.col("label")).alias("messages")),
        "prompts": base.select("record_id", "label", messages(("user", F.col(prompt))).alias("messages")),
        "pairwise": base.select("record_id", "label", chat(F.col("label")).alias("messages"), F.col("wrong").alias("rejected_response"), F.lit(1.0).alias("margin")),
        "rm": base.select(
            "record_id",
            "label",
            chat(F.col("label")).alias("messages"),
            both(F.array(F.struct(F.lit("wrong_label").alias("negative_type"), F.col("wrong").alias("rejected_response")), F.struct(F.lit("bad_format").alias("negative_type"), F.concat(F.lit("maybe "), F.col("label")).alias("rejected_response")))),
        ),
        "kto": base.select("record_id", F.col("label").alias("gold_label"), both(F.array(F.struct(F.col("label").alias("answer"), F.lit(True).alias("label")), F.struct(F.col("wrong").alias("answer"), F.lit(False).alias("label"))))),
        "opsd": base.select("record_id", "label", messages(("user", F.col(prompt))).alias("messages"), F.concat(F.lit("The answer is "), F.col("label"), F.lit(". Explain it.")).alias("teacher_prompt")),
    }


def strip_template(c: Column, prefix: str, suffix: str) -> Column:
    """What is between an exact prefix and suffix; null where they aren't there."""
    inner = F.substring(c, F.lit(len(prefix) + 1), F.greatest(F.length(c) - len(prefix) - len(suffix), F.lit(0)))
    return F.when(F.startswith(c, F.lit(prefix)) & F.endswith(c, F.lit(suffix)) & (F.length(c) >= len(prefix) + len(suffix)), inner)


def sanitise(c: Column) -> Column:
    """Control characters become blanks, and think tags can't be read as such."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return F.replace(F.replace(plain, F.lit("<think>"), F.lit("＜think＞")), F.lit("</think>"), F.lit("＜/think＞"))


def candidate_pairs(rows: DataFrame, key: str, label: str, labels: Sequence[str], is_ood: str) -> DataFrame:
    """Candidates with a verdict: the right and the adjacent label for rows within the domain, one wrong label for others."""
    names = F.array(*(F.lit(x) for x in labels))
    at = F.array_position(names, F.col(label)).cast("int")
    adjacent = F.get(names, at % len(labels))
    fallback = F.get(names, scores.hash_int(F.col(key), len(labels)).cast("int"))
    pair = lambda c, ok: F.struct(c.alias("candidate_label"), F.lit(ok).alias("candidate_correct"))
    each = F.when(F.col(is_ood), F.array(pair(fallback, False))).otherwise(F.array(pair(F.col(label), True), pair(adjacent, False)))
    return rows.select(F.col(key), F.col(label), F.col(is_ood), F.inline(each))


def calibration_rows(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Answer and confidence in the wire format; the placeholder confidence is 0.1 to 0.9 by the key's hash."""
    tenths = scores.hash_int(F.col(key), 9) + 1
    return rows.select(key, label, (tenths / 10.0).alias("placeholder"), F.format_string("<answer>%s</answer><confidence>%.1f</confidence>", F.col(label), tenths / 10.0).alias("response"))


def graded_candidates(rows: DataFrame, key: str, value: str, grades: DataFrame | None = None) -> DataFrame:
    """Each row with five candidates of grades 1 to 5; the grade says how far off the value is."""
    spark = rows.sparkSession
    grades = grades if grades is not None else spark.range(1, 6).select(F.col("id").cast("int").alias("score"))
    sign = F.when(F.col(key) % 2 == 0, 1).otherwise(-1)
    off = F.when(F.col("score") == 5, 0).when(F.col("score") == 4, 1).when(F.col("score") == 3, 5).when(F.col("score") == 2, 20).otherwise(100)
    return rows.crossJoin(F.broadcast(grades)).select(key, "score", (F.col(value) + sign * off).alias("candidate"))


def tasks(rows: DataFrame, key: str, names: Sequence[str] = ("retrieve", "compose", "decision")) -> DataFrame:
    """Each record with each task, and the task's step limit."""
    each = F.explode(F.array(*(F.lit(t) for t in names)))
    return rows.select("*", each.alias("task")).withColumn("max_steps", F.when(F.col("task") == "decision", 6).otherwise(4))


def exploded_in_order(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    return rows.select(key, F.posexplode(parts).alias("pos", "part"))


def regrouped(parts: DataFrame, key: str, value: str = "part", separator: str = "|") -> DataFrame:
    """The parts of each owner joined again in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), separator).alias("joined"), F.count("*").alias("n_parts"))


def with_ordinal(rows: DataFrame, order: Sequence[Column | str], partition: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """Zero-based place by an explicit order, in groups of any size or among all rows."""
    placed = running(rows, partition, [F.col(c) if isinstance(c, str) else c for c in order], {name: F.lit(1)})
    return placed.withColumn(name, F.col(name) - 1)


def clue(c: Column, marks: Sequence[str] = (), tail: int = 500) -> Column:
    """The last non-empty paragraph, else the last ``tail`` characters; without a leading label."""
    parts = text.non_empty(F.transform(F.split(c, r"\n\s*\n"), text.strip))
    found = F.coalesce(text.last(parts), F.substring(c, -tail, tail))
    for m in marks:
        found = F.when(F.startswith(found, F.lit(m)), F.substr(found, F.lit(len(m) + 1))).otherwise(found)
    return found


def fragments(c: Column, marks: Sequence[str]) -> Column:
    """Pieces between marker phrases, stripped, without empty ones."""
    return text.non_empty(F.transform(F.split(c, "|".join(f"\\Q{m}\\E" for m in marks)), text.strip))


def multimodal(rows: DataFrame, question: Column, options: Column, images: Column, modality: Column) -> DataFrame:
    """Options and images only where there are any, and one image mark for each image."""
    marks = F.concat(F.repeat(F.lit("<image>"), F.size(images)), question)
    listed = F.when(F.size(options) > 0, F.concat(marks, F.lit("\n"), F.array_join(options, "\n"))).otherwise(marks)
    return rows.select("*", modality.alias("modality"), F.when(F.size(options) > 0, options).alias("options"), F.when(F.size(images) > 0, images).alias("images"), messages(("user", listed)).alias("messages"))


def cloned(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows repeated up to ``n`` rows, with a new id each; of more than ``n`` rows the first."""
    count = min(rows.count(), n)
    ranked = with_ordinal(rows.orderBy(key).limit(n), [key], name="_at")
    ids = rows.sparkSession.range(n).withColumn("_at", (F.col("id") % max(count, 1)).cast("int"))
    return ids.join(ranked, "_at").select(F.format_string("clone-%05d", F.col("id")).alias("clone_id"), *rows.columns)


def qa_rows(rules: DataFrame, key: str, title: str, train: int = 8, val: int = 2) -> DataFrame:
    """Questions for each rule: ``train`` and ``val`` templates."""
    each = F.array(*(F.struct(F.lit("train" if k < train else "val").alias("split"), F.lit(k).alias("template"), F.format_string(f"q{k}: what does rule %s say on %s?", F.col(key).cast("string"), F.col(title)).alias("question")) for k in range(train + val)))
    return rules.select(key, F.inline(each))


def adjacent_pairs(rules: DataFrame, key: str, group: str) -> DataFrame:
    """Consecutive rules of a group, two and two."""
    ranked = with_ordinal(rules, [key], [group]).withColumn("pair", F.floor(F.col("ordinal") / 2))
    return ranked.groupBy(group, "pair").agg(F.min(key).alias("first_id"), F.max(key).alias("second_id"), F.count("*").alias("n")).where("n = 2").select(group, "pair", "first_id", "second_id")


def searchable(parts: Sequence[Column], lists: Sequence[Column]) -> Column:
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts), *(F.array_join(x, " ") for x in lists))


def evidence_reason(terms: Column, label: Column) -> Column:
    quoted = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("“"), t, F.lit("”"))), "、")
    return F.concat(F.lit("The text names "), quoted, F.lit(", so it is "), label, F.lit("."))


def paired_cases(rows: DataFrame, rules: DataFrame, group: str, row_key: str, rule_key: str) -> DataFrame:
    """The k-th row of a group with its k-th rule, both by key order; each row is used once."""
    a = with_ordinal(rows.select(row_key, group), [row_key], [group])
    b = with_ordinal(rules.select(rule_key, group), [rule_key], [group])
    return a.join(b, [group, "ordinal"]).select(group, "ordinal", row_key, rule_key)


def public_fields(fields: Sequence[str]) -> Column:
    """Chosen columns as compact JSON, in the order given."""
    return F.to_json(F.struct(*fields))


def defaults(row: Column, *fallbacks: Column) -> Column:
    return F.coalesce(row, *fallbacks)


def by_label(mapping: Mapping[str, str], c: Column) -> Column:
    """A mapped label; null for one that isn't listed."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), c)
