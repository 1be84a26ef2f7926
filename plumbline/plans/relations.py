"""Queries of sources, sinks, gates and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells, datasets, gates, retrieval, series, shape
from ..session import shared_folder
from ..sources import readers, writers
from .base import EVENTS, LANGS, NORMAL, RESPONSES, SCORED, Tables, events, long, query, r6, responses, scored

# sources and sinks: what the engine writes to the shared folder, read back from there


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _lines(t: Tables, name: str, lines: DataFrame) -> str:
    """Writes a column of lines; the path."""
    path = _folder(t, name)
    lines.write.text(path)
    return path


DOC = "doc_id long, lang string, source string, n_chars long"


@query("src01_jsonl", "SELECT doc_id, lang, source, n_chars FROM documents")
def src01(t: Tables) -> DataFrame:
    """With a blank line after every seventh row."""
    line = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    return readers.jsonl(t.spark, _lines(t, "src01", t.documents.select(F.concat(line, F.when(F.col("doc_id") % 7 == 0, "\n").otherwise("")))), DOC)


@query("src02_jsonl_strict", "SELECT doc_id, lang, source, n_chars FROM documents")
def src02(t: Tables) -> DataFrame:
    path = _folder(t, "src02")
    writers.jsonl(t.documents.select("doc_id", "lang", "source", "n_chars"), path)
    return readers.jsonl(t.spark, path, DOC, strict=True)


BROKEN = "CASE doc_id % 5 WHEN 0 THEN '{\"id\": ' || CAST(doc_id AS STRING) WHEN 1 THEN '{\"other\": ' || CAST(doc_id AS STRING) || '}' ELSE '{\"id\": ' || CAST(doc_id AS STRING) || ', \"label\": \"' || lang || '\"}' END"


@query("src03_line_errors", "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'not a JSON object' ELSE 'no id' END AS problem FROM documents WHERE doc_id % 5 < 2")
def src03(t: Tables) -> DataFrame:
    """Each faulty line's number must lead back to the line that holds its id."""
    path = _lines(t, "src03", t.documents.select(F.expr(BROKEN)))
    found = readers.line_errors(t.spark, path, "id long, label string", ["id"])
    d = found.join(readers.numbered_lines(t.spark, path), ["file", "line_number"])
    return d.select(F.regexp_extract("value", "([0-9]+)", 1).cast("long").alias("id"), "problem")


@query("src04_tolerant", "SELECT doc_id AS id, lang AS label FROM documents WHERE doc_id % 5 >= 2")
def src04(t: Tables) -> DataFrame:
    return readers.tolerant_jsonl(t.spark, _lines(t, "src04", t.documents.select(F.expr(BROKEN))), "id long, label string", ["id", "label"])


@query("src05_offset_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40 OFFSET 25")
def src05(t: Tables) -> DataFrame:
    return datasets.page(t.documents.select("doc_id"), "doc_id", 25, 40)


@query("src06_capped_per_key", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def src06(t: Tables) -> DataFrame:
    return datasets.capped(t.documents.select("doc_id", "source"), "source", "doc_id", 3)


@query("src07_whole_json", "SELECT n_nationkey AS id, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def src07(t: Tables) -> DataFrame:
    """A file for each nation, with one JSON document over several lines."""
    d = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))
    document = F.concat(F.lit('{\n  "id": '), F.col("n_nationkey").cast("string"), F.lit(',\n  "of": {\n    "name": "'), "n_name", F.lit('",\n    "region": "'), "r_name", F.lit('"\n  }\n}'))
    path = _folder(t, "src07")
    d.select(document.alias("value"), F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(path)
    return readers.document(t.spark, path, "id long, of struct<name:string,region:string>").select("id", "of.name", "of.region")


@query("src08_csv", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def src08(t: Tables) -> DataFrame:
    path = _folder(t, "src08")
    writers.csv(t.documents.select("doc_id", "lang", "text"), path)
    return readers.csv(t.spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("src09_validated_entities", f"SELECT doc_id, conf::DOUBLE AS conf FROM {SCORED}")
def src09(t: Tables) -> DataFrame:
    path = _folder(t, "src09")
    writers.jsonl(scored(t).select("doc_id", "conf"), path)
    return readers.entities(t.spark, path, "doc_id long, conf double", {"confidence isn't within [0, 1]": F.col("conf").between(0.0, 1.0)})


@query("src10_rule_base", "SELECT 'r' || p_partkey AS rule_id, p_brand AS canonical_id, p_size AS priority FROM part WHERE p_size > 5")
def src10(t: Tables) -> DataFrame:
    rules = t.part.select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_brand").alias("canonical_id"), F.col("p_size").alias("priority"), F.when(F.col("p_size") > 5, "active").otherwise("retired").alias("status"))
    return readers.checked_rules(rules).select("rule_id", "canonical_id", "priority")


@query("src11_stage_log", f"SELECT day AS stage, round(epoch_us(min(ts)) / 1e6, 3) AS epoch FROM {EVENTS} GROUP BY day")
def src11(t: Tables) -> DataFrame:
    lines = events(t).groupBy("day").agg(F.min("ts").alias("ts")).select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00] "), "day").alias("value"))
    return readers.stage_log(t.spark, _lines(t, "src11", lines)).select("stage", F.round("epoch", 3).alias("epoch"))


@query("src12_newest_file")
def src12(t: Tables) -> DataFrame:
    return readers.newest(t.spark, t.sf_dir, "*.parquet").select(F.substring_index("path", "/", -1).alias("file"), "length")


class EchoClient:
    """A client for tests: its reply is the prompt's first word."""

    def generate(self, prompts: list[str]) -> list[dict]:
        return [{"text": p.split()[0] if p.split() else "", "prompt_tokens": len(p.split()), "completion_tokens": 1, "mean_logprob": -0.5} for p in prompts]


@query("src14_model_source", "SELECT doc_id, prompt_tokens, round(prompt_tokens / 1e3 * 0.5 + 1 / 1e3, 6) AS estimated_cost FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+'))::BIGINT AS prompt_tokens FROM documents)")
def src14(t: Tables) -> DataFrame:
    d = readers.generated(t.documents.select("doc_id", F.col("text").alias("prompt")), EchoClient, "doc_id", "prompt")
    return readers.with_cost(d, 0.5, 1.0).select("doc_id", "prompt_tokens", r6(F.col("estimated_cost")).alias("estimated_cost"))


@query("src17_tar_members", "SELECT r_name || '.txt' AS member, length(r_regionkey || ': ' || r_name)::BIGINT AS bytes, sha256(r_regionkey || ': ' || r_name) AS sha256 FROM region")
def src17(t: Tables) -> DataFrame:
    """An archive with a file for each region, and one that isn't asked for."""
    path = f"{_folder(t, 'src17')}/regions.tar"
    files = {f"{r.r_name}.txt": f"{r.r_regionkey}: {r.r_name}".encode() for r in t.region.collect()}  # five rows
    writers.tar(t.spark, path, files | {"README.md": b"not asked for"})
    return readers.tar_members(t.spark, path, [".txt"]).select("member", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("src18_literal_tables", "SELECT * FROM (VALUES ('PASS', 0), ('REVIEW', 1), ('REJECT', 2)) l(decision, level)")
def src18(t: Tables) -> DataFrame:
    from ..operators.policy import LEVELS

    return t.spark.createDataFrame(list(LEVELS.items()), "decision string, level int")


@query("src19_merged_views", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN doc_id % 3 = 0 THEN '/abs/' || doc_id ELSE '/data/img/' || doc_id END AS image FROM documents")
def src19(t: Tables) -> DataFrame:
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/abs/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("img/"), F.col("doc_id").cast("string")))
    d = t.documents.select("doc_id", F.array(path).alias("images"))
    m = readers.merged_views({"train": d.where("doc_id % 10 <> 0"), "val": d.where("doc_id % 10 = 0")}, "/data")
    return m.select("doc_id", "split", F.get("images", F.lit(0)).alias("image"))


@query("src20_parameters", "SELECT * FROM (VALUES ('gamma', 0.5), ('beta', 8.0), ('threshold', 0.5)) p(parameter, \"default\")")
def src20(t: Tables) -> DataFrame:
    gates.arguments(gamma=0 <= 0.5 <= 1, k=5 >= 1)
    return t.spark.createDataFrame([("gamma", 0.5), ("beta", 8.0), ("threshold", 0.5)], "parameter string, default double")


@query("snk01_jsonl_lines", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS value FROM documents")
def snk01(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars"), {"ignoreNullFields": "false"}).alias("value"))


@query("snk02_entities", "SELECT doc_id, quality, toxic FROM labels")
def snk02(t: Tables) -> DataFrame:
    """Written twice, as a later version replaces the earlier, and read with its guards."""
    path = _folder(t, "snk02")
    for rows in (t.labels.limit(10), t.labels):
        writers.jsonl(rows.select("doc_id", "quality", "toxic"), path)
    return readers.entities(t.spark, path, "doc_id long, quality long, toxic long", {"labels are 0 or 1": F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)})


@query("snk03_atomic_cache", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def snk03(t: Tables) -> DataFrame:
    """A result under its fingerprint: made once, then read; an incomplete one would be made again."""
    folder, rows = _folder(t, "snk03"), t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    print_, n = writers.fingerprint(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", {"by": "lang"}), t.documents.select("lang").distinct().count()

    def again() -> DataFrame:
        raise AssertionError("the stored result isn't found")

    writers.cached(t.spark, folder, print_, n, lambda: rows)
    return writers.cached(t.spark, folder, print_, n, again)


@query("snk04_fingerprint")
def snk04(t: Tables) -> DataFrame:
    print_ = writers.fingerprint(t.labels.select("doc_id", "quality"), "doc_id", {"k": 5})
    return t.spark.createDataFrame([(print_,)], "fingerprint string")


@query("snk06_manifest")
def snk06(t: Tables) -> DataFrame:
    d = t.spark.read.format("binaryFile").option("pathGlobFilter", "{region,nation}.parquet").load(f"{t.sf_dir}/*.parquet")
    return d.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("snk07_markdown", "SELECT '| lang | n | mean |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' | ' || printf('%.1f', mean) || ' |', chr(10) ORDER BY lang) AS markdown FROM (SELECT lang, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY lang)")
def snk07(t: Tables) -> DataFrame:
    table = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")).orderBy("lang")
    return t.spark.createDataFrame([(writers.markdown(table, {"mean": ".1f"}),)], "markdown string")


@query("snk08_trimmed_export", f"SELECT doc_id, 'doc-' || doc_id || '.txt' AS path, guess FROM {SCORED} WHERE guess <> gold")
def snk08(t: Tables) -> DataFrame:
    d = scored(t).withColumn("path", F.concat(F.lit("/home/x/out/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return writers.trimmed(d, ["doc_id", "path", "guess"], ["path"], F.col("guess") != F.col("gold"))


# gates

GATE = "SELECT '{name}' AS gate, count(*) AS n_checked, count(*) FILTER (NOT coalesce({ok}, false)) AS n_violations FROM {of}"


def gate_query(name: str, ok: str, of: str, f) -> None:
    @query(name, GATE.format(name=name, ok=ok, of=of))
    def run(t: Tables) -> DataFrame:
        rows, condition = f(t)
        return gates.gate(rows, name, condition).select("gate", "n_checked", "n_violations")


gate_query("flt01_candidate", "regexp_full_match(lang, '[a-f]+') AND length(text) BETWEEN 30 AND 5000 AND n_chars <= 9000", "documents", lambda t: (t.documents, F.col("lang").rlike(r"^[a-f]+\z") & F.length("text").between(30, 5000) & (F.col("n_chars") <= 9000)))


@query("flt02_allowed_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' END AS label FROM documents WHERE lang IN ('en', 'de')")
def flt02(t: Tables) -> DataFrame:
    names = {"en": "English", "de": "German"}
    return t.documents.where(F.col("lang").isin(*names)).select("doc_id", shape.by_label(names, F.col("lang")).alias("label"))


TURNS = "(SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"


def _conversations(t: Tables) -> DataFrame:
    return shape.conversations(t.conversations)


gate_query(
    "flt03_message_structure",
    "len(talk) > 0 AND len(list_filter(talk, lambda r, i: r <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AND len(list_filter(texts, lambda x: length(trim(x)) = 0)) = 0",
    f"(SELECT *, CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END AS talk FROM {TURNS})",
    lambda t: (_conversations(t), gates.message_structure(F.col("messages"))),
)


@query("flt04_balance", "SELECT l.lang, l.expected::BIGINT AS expected, coalesce(n, 0) AS found FROM (VALUES ('en', 100), ('de', 100), ('xx', 5)) l(lang, expected) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d USING (lang) WHERE coalesce(n, 0) <> expected UNION ALL SELECT lang, 0, count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'xx') GROUP BY lang")
def flt04(t: Tables) -> DataFrame:
    return gates.balance(t.documents, "lang", {"en": 100, "de": 100, "xx": 5})


gate_query("flt05_label_leak", "NOT (contains(text, source) OR contains(text, 'doc-' || doc_id))", "documents", lambda t: (t.documents, gates.no_leak(F.array("source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))), F.col("text"))))
gate_query("flt06_evidence", "contains(text, left(text, 4)) AND contains(text, 'the') AND contains(text, 'ion') AND left(text, 4) <> 'the' AND left(text, 4) <> 'ion'", "documents", lambda t: (t.documents, gates.evidence_holds(F.array(F.substring("text", 1, 4), F.lit("the"), F.lit("ion")), F.col("text"))))


@query("flt07_assets", "SELECT 'documents' AS gate, count(*) AS n_checked, 0::BIGINT AS n_violations FROM documents UNION ALL SELECT 'labels_known', count(*), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) FROM labels UNION ALL SELECT 'chars', count(*), count(*) FILTER (n_chars <> length(text)) FROM documents")
def flt07(t: Tables) -> DataFrame:
    known = t.labels.join(t.documents.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return gates.report(gates.gate(t.documents, "documents", F.col("doc_id").isNotNull()), gates.gate(known, "labels_known", F.col("known")), gates.gate(t.documents, "chars", F.col("n_chars") == F.length("text"))).select("gate", "n_checked", "n_violations")


@query("flt08_protocol_equality", "SELECT 'n_regions' AS key, true AS equal UNION ALL SELECT 'nation', count(DISTINCT n_regionkey) <= 1 FROM nation")
def flt08(t: Tables) -> DataFrame:
    runs = t.nation.select(F.lit(5).alias("n_regions"), F.col("n_regionkey").alias("nation"))
    return gates.same_protocol(runs, ["n_regions", "nation"])


@query("flt09_contiguity", "WITH g AS (SELECT doc_id AS step, count(*) AS n FROM labels WHERE doc_id BETWEEN 0 AND 99 GROUP BY doc_id), w AS (SELECT range AS step, n FROM range(100) LEFT JOIN g ON g.step = range) SELECT count(*) AS n_expected, count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (n > 1) AS n_duplicate, min(step) FILTER (n IS NULL) AS first_missing FROM w")
def flt09(t: Tables) -> DataFrame:
    return gates.contiguity(t.labels, "doc_id", 0, 99)


@query("flt13_length_audit", "SELECT lang, count(*) AS n, min(n_chars) AS shortest, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, max(n_chars) AS longest, count(*) FILTER (n_chars > 4608) AS n_over FROM documents GROUP BY lang")
def flt13(t: Tables) -> DataFrame:
    return gates.length_audit(t.documents, "lang", "n_chars", 4608).withColumns({"p50": r6(F.col("p50")), "p95": r6(F.col("p95"))})


@query("flt15_offset_ranges", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 120) a WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 80 OFFSET 120)")
def flt15(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id")
    gates.ranges_disjoint((0, 120), (120, 80), d.count())
    return datasets.page(d, "doc_id", 0, 120).join(datasets.page(d, "doc_id", 120, 80), "doc_id", "left_anti").agg(F.count("*").alias("n"))


@query("flt16_completeness", "SELECT lang, count(*) AS n, count(*) = 100 AS complete FROM documents GROUP BY lang")
def flt16(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).withColumn("complete", F.col("n") == 100)


@query("flt12_arguments", "SELECT 'ok' AS arguments")
def flt12(t: Tables) -> DataFrame:
    gates.arguments(gamma=0 <= 0.9 <= 1, temperature=1.0 > 0, unique_actions=len({"a", "b"}) == 2)
    return t.spark.createDataFrame([("ok",)], "arguments string")


# joins


@query("jon01_lookup", "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def jon01(t: Tables) -> DataFrame:
    s, n, r = t.supplier, t.nation, t.region
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("jon02_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jon02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("toxic = 1"), "doc_id", "left_semi")


@query("jon03_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 40 = 0)")
def jon03(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderkey % 40 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jon04_key_sets", "SELECT 'right' AS missing_in, count(*) AS n_missing, array_to_string(list(doc_id ORDER BY doc_id)[1:10], ',') AS examples FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon04(t: Tables) -> DataFrame:
    return gates.key_sets_equal(t.documents, t.labels, "doc_id")


@query("jon05_positional", "SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, lang FROM documents) a JOIN (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS k, lang FROM documents) b USING (lang, k)")
def jon05(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "n_chars")
    a = shape.with_ordinal(d, ["doc_id"], ["lang"]).select("lang", "ordinal", F.col("doc_id").alias("left_id"))
    b = shape.with_ordinal(d, ["n_chars", "doc_id"], ["lang"]).select("lang", "ordinal", F.col("doc_id").alias("right_id"))
    return a.join(b, ["lang", "ordinal"]).select("left_id", "right_id")


@query("jon06_cross", "SELECT r_name, n_name FROM region, nation")
def jon06(t: Tables) -> DataFrame:
    return t.region.select("r_name").crossJoin(F.broadcast(t.nation.select("n_name")))


TOKENS = "list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1))"


@query(
    "jon07_jaccard_topk",
    f"""WITH d AS (SELECT doc_id, unnest(w) AS t, len(w) AS n FROM (SELECT doc_id, {TOKENS} AS w FROM documents)), q AS (SELECT item_id, unnest(w) AS t, len(w) AS n FROM (SELECT item_id, {TOKENS} AS w FROM benchmark)),
s AS (SELECT item_id, doc_id, count(*) / (any_value(d.n) + any_value(q.n) - count(*))::DOUBLE AS similarity FROM d JOIN q USING (t) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id DESC) AS rank FROM s WHERE similarity >= 0.15) WHERE rank <= 5""",
)
def jon07(t: Tables) -> DataFrame:
    d = retrieval.jaccard_top_k(t.documents, t.benchmark, "doc_id", "item_id", text.state_tokens(F.col("text")), text.state_tokens(F.col("text")), 0.15, 5)
    return d.select("item_id", long("rank").alias("rank"), "doc_id", r6(F.col("similarity")).alias("similarity"))


WORDS = "regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)"


@query(
    "jon09_bm25",
    f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, unnest(w) AS t, len(w) AS l FROM d) GROUP BY doc_id, t),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS}) AS t FROM benchmark) GROUP BY ALL),
f AS (SELECT t, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY t, n),
c AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM p JOIN q USING (t) JOIN f USING (t), s GROUP BY ALL)
SELECT item_id, rank, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM c) WHERE rank <= 5""",
)
def jon09(t: Tables) -> DataFrame:
    w = text.words(F.col("text"))
    c = retrieval.bm25_top_k(t.documents, t.benchmark, "doc_id", "item_id", w, w, 5)
    return c.select("item_id", long("rank").alias("rank"), "doc_id", F.round("score", 5).alias("score"))


@query("jon10_dense", "WITH p AS (SELECT q.vec_id AS q, e.vec_id AS vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT q, vec_id, rank, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, vec_id) AS rank FROM p) WHERE rank <= 5")
def jon10(t: Tables) -> DataFrame:
    q = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return retrieval.dense(t.embeddings, q, "vec_id", "q", "embedding", "qv", 5).select("q", "vec_id", long("rank").alias("rank"), F.round("cosine", 5).alias("cosine"))


@query("jon10_dense_cells")
def jon10_cells(t: Tables) -> DataFrame:
    """The same queries by way of an index of cells; what it finds is held against ``jon10_dense`` in the tests."""
    q = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    found = cells.nearest(t.embeddings, q, "vec_id", "q", "embedding", "qv", 5, cells.fit(t.embeddings, "embedding", 5))
    return found.select("q", "vec_id", long("rank").alias("rank"), F.round("cosine", 5).alias("cosine"))


@query("jon11_containment", "SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def jon11(t: Tables) -> DataFrame:
    return retrieval.containment(t.documents, t.benchmark, "doc_id", "item_id", "text", "text").groupBy("item_id").agg(F.count("*").alias("n_docs"))


STAGES = ["warm", "train", "evaluate", "export"]


@query(
    "jon12_stage_interval",
    f"""WITH e AS (SELECT epoch, value FROM {EVENTS}), b AS (SELECT min(epoch) AS t0, max(epoch) AS t1 FROM e), s AS (SELECT unnest([{', '.join(repr(s) for s in STAGES)}]) AS stage, unnest([0, 0.1, 0.7, 0.9]) AS f),
w AS (SELECT stage, t0 + f::DOUBLE * (t1 - t0) AS a, coalesce(lead(t0 + f::DOUBLE * (t1 - t0)) OVER (ORDER BY f), t1 + 1e-6) AS z FROM s, b)
SELECT stage, count(*) AS n, round(max(epoch) - min(epoch), 2) AS duration, round(max(value), 6) AS peak, round(avg(value), 6) AS mean FROM e JOIN w ON epoch >= a AND epoch < z GROUP BY stage""",
)
def jon12(t: Tables) -> DataFrame:
    e = events(t)
    t0, t1 = e.agg(F.min("epoch"), F.max("epoch")).first()
    starts = [t0 + f * (t1 - t0) for f in (0.0, 0.1, 0.7, 0.9)]
    s = series.stage_summary(series.in_stage(e, "epoch", starts, STAGES), "stage", "epoch", "value")
    return s.select("stage", "n", F.round("duration", 2).alias("duration"), r6(F.col("peak")).alias("peak"), r6(F.col("mean")).alias("mean"))


@query("jon13_pairwise", "SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def jon13(t: Tables) -> DataFrame:
    n = t.nation
    a, b = n.select(F.col("n_nationkey").alias("left_key"), "n_regionkey"), n.select(F.col("n_nationkey").alias("right_key"), "n_regionkey")
    return a.join(b, "n_regionkey").where("left_key < right_key").select("left_key", "right_key")


@query("jon14_fuzzy_id", "WITH raw AS (SELECT p_partkey AS raw_id, p_brand AS c, left(p_name, length(p_name) - 1) AS s FROM part), known AS (SELECT p_partkey AS k, p_brand AS c, p_name AS n FROM part) SELECT raw_id, min(k) AS resolved FROM raw JOIN known USING (c) WHERE starts_with(s, n) OR starts_with(n, s) GROUP BY raw_id HAVING count(*) = 1")
def jon14(t: Tables) -> DataFrame:
    known = t.part.select("p_partkey", "p_brand", F.col("p_name").alias("slug"))
    raw = t.part.select(F.col("p_partkey").alias("raw_id"), "p_brand", F.expr("substring(p_name, 1, length(p_name) - 1)").alias("slug"))
    return retrieval.fuzzy_ids(raw, known, "raw_id", "p_partkey", "p_brand", "slug")


@query("jon15_task_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view_, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id")
def jon15(t: Tables) -> DataFrame:
    p = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).count().na.fill(0)
    n = t.events.groupBy("user_id").agg(F.count_distinct("event_type").alias("n_types"))
    return p.join(n, "user_id").select("user_id", "click", F.col("view").alias("view_"), "n_types")


@query("jon16_tag_routing", "SELECT doc_id, CASE lang WHEN 'en' THEN 'host-a' WHEN 'de' THEN 'host-b' ELSE 'host-c' END AS endpoint FROM documents")
def jon16(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce(shape.by_label({"en": "host-a", "de": "host-b"}, F.col("lang")), F.lit("host-c")).alias("endpoint"))


@query("jon17_leakage", f"WITH s AS (SELECT DISTINCT {NORMAL} AS k, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS s FROM documents) SELECT a.s AS left, b.s AS right, count(*) AS n_overlap FROM s a JOIN s b ON a.k = b.k AND a.s < b.s GROUP BY ALL")
def jon17(t: Tables) -> DataFrame:
    tenth = F.col("doc_id") % 10
    d = t.documents.withColumn("split", F.when(tenth < 8, "train").when(tenth == 8, "val").otherwise("test"))
    return datasets.overlaps(d, "split", F.xxhash64(text.body(F.col("text"))))
