"""Queries of windows, order, samples, splits and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import datasets, metrics, ordered, retrieval, series, shape
from .base import EVENTS, SCORED, Tables, events, h, long, query, r6, scored


@query("win01_rank_limit", "SELECT p_type, p_partkey, rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def win01(t: Tables) -> DataFrame:
    return retrieval.top_k(t.part, "p_type", 3, F.col("p_retailprice").desc(), F.col("p_size").desc(), F.col("p_partkey")).select("p_type", "p_partkey", long("rank").alias("rank"))


@query("win02_mid_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2e0 AS mid_rank FROM part")
def win02(t: Tables) -> DataFrame:
    return ordered.mid_ranks(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "mid_rank").select("p_partkey", "mid_rank")


@query("win03_cumulative_error", f"SELECT doc_id, round(sum(1 - correct) OVER w / row_number() OVER w, 6) AS risk FROM {SCORED} WINDOW w AS (PARTITION BY toxic ORDER BY conf DESC, doc_id ROWS UNBOUNDED PRECEDING)")
def win03(t: Tables) -> DataFrame:
    d = ordered.running(scored(t).select("doc_id", "toxic", "conf", "correct"), ["toxic"], [F.col("conf").desc(), F.col("doc_id")], {"errors": 1 - F.col("correct"), "place": F.lit(1)})
    return d.select("doc_id", r6(F.col("errors") / F.col("place")).alias("risk"))


@query("win04_lead_boundary", f"SELECT day, round(coalesce(lead(s) OVER (ORDER BY s), (SELECT max(epoch) + 1e-6 FROM {EVENTS})), 3) AS next_start FROM (SELECT day, min(epoch) AS s FROM {EVENTS} GROUP BY day)")
def win04(t: Tables) -> DataFrame:
    e = events(t)
    days = e.groupBy("day").agg(F.min("epoch").alias("start"))
    return series.stage_bounds(days, "start", e, "epoch").select("day", F.round("end", 3).alias("next_start"))


@query("win05_discounted", "SELECT event_id, round((SELECT sum(b.value * power(0.5, b.k - a.k)) FROM r b WHERE b.user_id = a.user_id AND b.k >= a.k AND b.k < a.k + 60), 6) AS discounted FROM r a".replace("SELECT event_id", "WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT event_id", 1))
def win05(t: Tables) -> DataFrame:
    return series.discounted(t.events, "user_id", "event_id", "value", 0.5).select("event_id", r6(F.col("discounted")).alias("discounted"))


@query("win06_last_rows", "SELECT event_type, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20 GROUP BY event_type")
def win06(t: Tables) -> DataFrame:
    return series.last_rows(t.events, ["event_type"], "event_id", 20).groupBy("event_type").agg(r6(F.avg("value")).alias("mean"))


@query("win07_row_buckets", "SELECT event_type, bucket::BIGINT AS bucket, min(event_id) || '-' || max(event_id) AS label, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS bucket FROM events) GROUP BY event_type, bucket")
def win07(t: Tables) -> DataFrame:
    return series.row_buckets(t.events, "event_type", "event_id", 100, "value").withColumns({"mean": r6(F.col("mean")), "bucket": long("bucket")})


@query("win08_running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM events")
def win08(t: Tables) -> DataFrame:
    return t.events.select("event_id", r6(series.running(F.col("value"), "mean", "user_id", "event_id")).alias("running_mean"))


@query("win09_running_best", "SELECT event_id, round(max(value) OVER w, 6) AS best, max(value) OVER w > 90 AS success FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def win09(t: Tables) -> DataFrame:
    best = series.running(F.col("value"), "best", "user_id", "event_id")
    return t.events.select("event_id", r6(best).alias("best"), (best > 90).alias("success"))


@query("win10_adjacent_rows", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p = event_type")
def win10(t: Tables) -> DataFrame:
    d = t.events.withColumn("p", F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id")))
    return d.where("p = event_type").select("event_id")


@query("win11_first_n", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 4")
def win11(t: Tables) -> DataFrame:
    return datasets.capped(t.documents.select("doc_id", "lang"), "lang", "doc_id", 4)


@query("win12_parity", "SELECT doc_id, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 2 = 0 THEN 'cot' ELSE 'direct' END AS style FROM documents")
def win12(t: Tables) -> DataFrame:
    d = shape.with_ordinal(t.documents.select("doc_id", "source"), ["doc_id"], ["source"])
    return d.select("doc_id", F.when(F.col("ordinal") % 2 == 0, "cot").otherwise("direct").alias("style"))


@query("win13_sampling_cdf", f"WITH p AS (SELECT user_id, event_id, value / sum(value) OVER (PARTITION BY user_id) AS p FROM events), c AS (SELECT user_id, event_id, sum(p) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS c FROM p) SELECT user_id, coalesce(min(event_id) FILTER (c >= {h('user_id', 1000)} / 1e3), max(event_id)) AS chosen FROM c GROUP BY user_id")
def win13(t: Tables) -> DataFrame:
    from ..functions.scores import hash_unit

    whole = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # the same rounding in every run
    p = t.events.select("user_id", "event_id", (F.col("value") / F.sum("value").over(whole)).alias("p"))
    return series.sampled_action(p, "user_id", "event_id", "p", hash_unit(F.col("user_id")))


ORDER = "sha256('42:' || doc_id)"


@query("srt01_hash_order", f"SELECT doc_id, k FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {ORDER}, doc_id) AS k FROM documents) WHERE k <= 10")
def srt01(t: Tables) -> DataFrame:
    return datasets.ranked(t.documents, ["lang"], "doc_id").where("_rank <= 10").select("doc_id", long("_rank").alias("k"))


@query("srt02_seeded_shuffle", f"SELECT doc_id FROM documents ORDER BY {ORDER}, doc_id LIMIT 100")
def srt02(t: Tables) -> DataFrame:
    return datasets.in_stable_order(t.documents, "doc_id").limit(100).select("doc_id")


@query("srt03_balanced_sample", f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDER}, doc_id) AS k FROM documents) SELECT lang, count(*) AS n, min(doc_id) AS min_key, max(doc_id) AS max_key FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) GROUP BY lang")
def srt03(t: Tables) -> DataFrame:
    return datasets.balanced_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("min_key"), F.max("doc_id").alias("max_key"))


@query("srt04_stratified_split", f"SELECT lang, split, count(*) AS n, min(doc_id) AS min_key, max(doc_id) AS max_key FROM (SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {ORDER}, doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.8) THEN 'train' ELSE 'val' END AS split FROM documents) GROUP BY ALL")
def srt04(t: Tables) -> DataFrame:
    return datasets.share_split(t.documents.select("doc_id", "lang"), ["lang"], "doc_id").groupBy("lang", "split").agg(F.count("*").alias("n"), F.min("doc_id").alias("min_key"), F.max("doc_id").alias("max_key"))


@query("srt05_triple_split", f"SELECT doc_id, CASE WHEN k <= 5 THEN 'train' WHEN k <= 10 THEN 'cal' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {ORDER}, doc_id) AS k FROM documents) WHERE k <= 15")
def srt05(t: Tables) -> DataFrame:
    return datasets.split(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", {"train": 5, "cal": 5, "test": 5}).select("doc_id", "split")


@query("srt06_positional_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, 'train' AS split FROM r WHERE k < 90 UNION ALL SELECT doc_id, 'val' FROM r WHERE k >= 90 AND k < 100 UNION ALL SELECT doc_id, 'smoke' FROM r WHERE k < 16")
def srt06(t: Tables) -> DataFrame:
    first = t.documents.select("doc_id").orderBy("doc_id").limit(100)
    return datasets.positional(first, "doc_id", {"train": (0, 90), "val": (90, 100), "smoke": (0, 16)})


@query("srt07_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def srt07(t: Tables) -> DataFrame:
    return datasets.clamped_top(t.documents.select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 50)


@query("srt08_best_candidate", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_brand, p_type, p_partkey LIMIT 1")
def srt08(t: Tables) -> DataFrame:
    return t.part.orderBy(F.col("p_size").desc(), F.col("p_retailprice").desc(), "p_brand", "p_type", "p_partkey").limit(1).select("p_partkey")


@query("srt09_sample", "SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 25")
def srt09(t: Tables) -> DataFrame:
    return datasets.sample(t.documents.select("doc_id"), "doc_id", 25, 7)


@query("set01_union", "SELECT 'calibration' AS evaluation_split, count(*) AS n FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'test', count(*) FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'ood', count(*) FROM documents WHERE doc_id % 3 = 2")
def set01(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id")
    parts = {name: d.where(F.col("doc_id") % 3 == k) for k, name in enumerate(("calibration", "test", "ood"))}
    return datasets.merged(parts).groupBy("evaluation_split").agg(F.count("*").alias("n"))


@query("set02_relations", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_both, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS n_only_left, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS n_only_right, false AS disjoint, false AS subset")
def set02(t: Tables) -> DataFrame:
    return datasets.set_relations(t.documents, t.labels, "doc_id")


@query("set03_ordered_distinct", "WITH w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9_]+)', 1) AS w FROM documents)), f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY ALL), s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id) SELECT doc_id, md5(coalesce(words, '')) AS digest FROM documents LEFT JOIN s USING (doc_id)")
def set03(t: Tables) -> DataFrame:
    from ..functions.text import words

    return t.documents.select("doc_id", F.md5(F.array_join(F.array_distinct(words(F.col("text"))), " ")).alias("digest"))


@query("set04_row_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT text FROM documents)")
def set04(t: Tables) -> DataFrame:
    return t.documents.select("text").dropDuplicates(["text"]).agg(F.count("*").alias("n"))


@query("set05_first_per_key", "SELECT source, min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY source")
def set05(t: Tables) -> DataFrame:
    return datasets.first_of_each(t.documents.select("source", "doc_id", "lang"), "source", "doc_id")


@query("agg36_retrieval_metrics", "WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS q, e.vec_id AS d, q.label = e.label AS rel, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, d) AS k FROM p), n AS (SELECT q, count(*) FILTER (rel) AS n FROM p GROUP BY q) SELECT r.q AS vec_id, round(coalesce(count(*) FILTER (rel AND k <= 5) / nullif(max(n.n), 0)::DOUBLE, 0), 6) AS recall, round(count(*) FILTER (rel AND k <= 5) / 5e0, 6) AS precision, round(coalesce(1e0 / min(k) FILTER (rel AND k <= 10), 0), 6) AS rr FROM r JOIN n USING (q) GROUP BY r.q")
def agg36(t: Tables) -> DataFrame:
    q = t.embeddings.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    near = retrieval.dense(t.embeddings, q, "vec_id", "q", "embedding", "qv", 10)
    total = t.embeddings.groupBy("label").agg(F.count("*").alias("_n"))
    d = near.join(t.embeddings.select("vec_id", "label"), "vec_id").join(q.select("q", "ql"), "q").join(total.withColumnRenamed("label", "ql"), "ql")
    d = d.withColumns({"relevant": F.col("label") == F.col("ql"), "n_relevant": F.col("_n") - 1})
    m = metrics.retrieval(d, "q", "relevant", "rank", 5, "n_relevant")
    return m.select(F.col("q").alias("vec_id"), r6(F.col("recall")).alias("recall"), r6(F.col("precision")).alias("precision"), r6(F.col("rr")).alias("rr"))
