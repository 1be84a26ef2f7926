"""Registering queries, and the views of the driver's tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under a name, with its SQL if there is any."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def h(key: str, n: int) -> str:
    """The hash of ``scores.hash_int`` in SQL."""
    return f"(('0x' || sha256(CAST({key} AS VARCHAR))[1:8])::BIGINT % {n})"


LANGS = ["de", "en", "es", "fr"]

#: Text in the shapes that models reply in, made of the documents; the same expression in both dialects.
RESPONSE = """CASE doc_id % 8
WHEN 0 THEN '<think> ' || text || ' </think>' || chr(10) || chr(92) || 'boxed{' || lang || '}'
WHEN 1 THEN '<think></think><answer> ' || upper(lang) || ' </answer>'
WHEN 2 THEN 'It is 1,' || CAST(100 + doc_id % 900 AS STRING) || ' and -2.50 of 3' || chr(10) || '#### 1,' || CAST(100 + doc_id % 900 AS STRING)
WHEN 3 THEN '<think>a</think> and <think>' || text || '</think><ANSWER>' || lang || '.</ANSWER><confidence>0.' || CAST(doc_id % 10 AS STRING) || '</confidence>'
WHEN 4 THEN chr(92) || 'boxed{en} then ' || chr(92) || 'boxed{' || lang || '}<confidence>1.7</confidence>'
WHEN 5 THEN 'score [[' || CAST(doc_id % 5 AS STRING) || ']] and [[' || CAST(doc_id % 6 AS STRING) || '.5]] as 12 + 30 = 42, 5 * 3 = 16'
WHEN 6 THEN 'I cannot see the image, so perhaps ' || lang || ' rule-0' || CAST(doc_id % 7 AS STRING) || ' rule-01'
ELSE text END"""

RESPONSES = f"SELECT doc_id, lang, source, text, {RESPONSE} AS response FROM documents"


def responses(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "text", F.expr(RESPONSE).alias("response"))


def scored(t: Tables) -> DataFrame:
    """Labels with a hash-derived confidence, a prediction that is right for seven keys of ten, and its correctness."""
    d = t.labels.select("doc_id", "quality", "toxic")
    d = d.withColumn("conf", scores.hash_unit(F.col("doc_id")))
    d = d.withColumn("pred", F.when(scores.hash_int(F.concat(F.col("doc_id").cast("string"), F.lit("p")), 10) < 7, F.col("quality")).otherwise(1 - F.col("quality")))
    gold = decision(F.col("toxic"), F.col("quality"))
    guess = F.element_at(F.array(F.lit("PASS"), F.lit("REVIEW"), F.lit("REJECT")), (scores.hash_int(F.concat(F.col("doc_id").cast("string"), F.lit("g")), 3) + 1).cast("int"))
    return d.withColumns({"correct": (F.col("pred") == F.col("quality")).cast("int"), "gold": gold, "guess": F.when(F.col("pred") == F.col("quality"), gold).otherwise(guess)})


def decision(toxic: Column, quality: Column) -> Column:
    return F.when(toxic == 1, "REJECT").when(quality == 0, "REVIEW").otherwise("PASS")


SCORED = f"""(SELECT *, (pred = quality)::INTEGER AS correct, CASE WHEN pred = quality THEN gold ELSE ['PASS', 'REVIEW', 'REJECT'][{h("doc_id || 'g'", 3)} + 1] END AS guess FROM (
SELECT doc_id, quality, toxic, {h("doc_id", 1000)} / 1e3 AS conf, CASE WHEN {h("doc_id || 'p'", 10)} < 7 THEN quality ELSE 1 - quality END AS pred,
CASE WHEN toxic = 1 THEN 'REJECT' WHEN quality = 0 THEN 'REVIEW' ELSE 'PASS' END AS gold FROM labels))"""


def events(t: Tables) -> DataFrame:
    """Events with epoch seconds and the day."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"epoch": F.unix_micros("ts") / 1e6, "day": F.date_format("ts", "yyyy-MM-dd")})


EVENTS = "(SELECT *, epoch_us(ts) / 1e6 AS epoch, strftime(ts, '%Y-%m-%d') AS day FROM events)"

NORMAL = r"left(trim(regexp_replace(text, '\s+', ' ', 'g')), 600)"
