"""URL filter: host and path rules, and gradient-boosted trees for the rest.

Features are lexical: lengths, depth, digit ratio, character entropy,
parameter counts, and statistics of the host's suffix.  Those are the suffix's
pages, of all rows, and the share of blocked among its labelled URLs, of all that
may be learnt from: a URL that the trees are trained on gets the share without
its own fold, so that no label tells itself.  No feature says which segment a
path has.  The trees are trained on URLs that carry a label (here the verdict of
a rule), a bounded sample of them by hash order; ``max_labelled`` is that bound.
Features and verdicts cover every row, in DataFrame functions and the DataFrame
machine-learning library.

The suffix statistics are counted and broadcast; where there are too many
suffixes for that, they meet the rows by suffix and one of ``SALTS`` shares of
its rows, as one suffix may hold most of them.

Defined results: a null URL, or one without ``://``, has empty host and path
and no rule; with no labelled URL the verdict is ``allow``, with labels of one
kind it is that kind; repeated rows give repeated results; equal URLs get equal
verdicts; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LABELLED = 20_000
FOLDS = 5
SALTS = 64
#: Rules are one expression up to here; more are joined on host suffixes.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    rule: str  # host/path
    block: bool

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


RULES = (
    Rule("com/en/", True),
    Rule("example.com/en/7", False),
    Rule("net/de/", False),
    Rule("example.net/de/8", True),
    Rule("org/es/", True),
)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    where = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", url.alias("url"), F.translate(F.regexp_extract(url, where, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, where, 2).alias("path"))


def _inline(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit("block" if r.block else "allow").alias("verdict"))).otherwise(out)
    return out


def with_rules(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled``, the rule's verdict."""
    if len(rules) <= INLINE_RULES:
        return urls.withColumn("_r", _inline(rules)).withColumns({"rule": F.col("_r.rule"), "ruled": F.col("_r.verdict")}).drop("_r")
    spark = urls.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.rule, "block" if r.block else "allow") for r in rules], "r_host string, r_path string, rule string, ruled string")
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    each = urls.select("page_id", "url", "host", "path").distinct()
    fits = each.withColumn("r_host", F.explode(suffixes)).join(listed, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruled")).alias("_b")).select("url", "_b.rule", "_b.ruled")
    return urls.join(best, "url", "left")


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS))


def suffix_statistics(urls: DataFrame, labelled: DataFrame, label: str = "ruled") -> DataFrame:
    """By suffix: pages among ``urls``, and by fold how many URLs of ``labelled`` carry a label and are blocked."""
    pages = urls.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("pages"))
    known = labelled.where(F.col(label).isNotNull()).select(suffix(F.col("host")).alias("suffix"), _fold(F.col("url")).alias("fold"), (F.col(label) == "block").alias("blocked"))
    by_fold = [F.count_if(F.col("fold") == k) for k in range(FOLDS)]
    blocked = [F.count_if((F.col("fold") == k) & F.col("blocked")) for k in range(FOLDS)]
    shares = known.groupBy("suffix").agg(F.array(*by_fold).alias("labels"), F.array(*blocked).alias("blocks"))
    none = F.array(*[F.lit(0).cast("long")] * FOLDS)
    return pages.join(shares, "suffix", "left").select("suffix", "pages", F.coalesce("labels", none).alias("labels"), F.coalesce("blocks", none).alias("blocks"))


def _with_statistics(urls: DataFrame, statistics: DataFrame) -> DataFrame:
    statistics = statistics.withColumnRenamed("suffix", "_suffix")
    urls = urls.withColumn("_suffix", suffix(F.col("host")))
    if statistics.count() <= BROADCAST_ROWS:
        return urls.join(F.broadcast(statistics), "_suffix", "left").drop("_suffix")
    salted = statistics.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return urls.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["_suffix", "_salt"], "left").drop("_suffix", "_salt")


def with_features(urls: DataFrame, statistics: DataFrame, out_of_fold: bool = False) -> tuple[DataFrame, list[str]]:
    """Adds lexical features and the statistics of the host's suffix; ``out_of_fold`` for rows to be trained on."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def entropy(c: Column) -> Column:
        n = F.greatest(F.length(c), F.lit(1)).cast("double")
        share = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n
        return F.aggregate(F.filter(F.array_distinct(F.split(c, "")), lambda x: x != ""), F.lit(0.0), lambda s, x: s - share(x) * F.log2(F.greatest(share(x), F.lit(1e-12))))

    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    ratio = lambda c, pattern: count(c, pattern) / F.greatest(F.length(c), F.lit(1))
    lexical = {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_labels": count(host, r"\."),
        "f_depth": count(path, r"/[^/]"),
        "f_digits": ratio(url, r"[0-9]"),
        "f_path_digits": count(path, r"[0-9]"),
        "f_host_vowels": ratio(host, r"[aeiou]"),
        "f_entropy": entropy(url),
        "f_host_entropy": entropy(host),
        "f_path_entropy": entropy(path),
        "f_params": F.when(F.length(query) > 0, count(query, "&") + 1.0).otherwise(0.0),
        "f_query_length": F.length(query).cast("double"),
        "f_punctuation": count(url, r"[-_%~=]"),
        "f_longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)).cast("double"),
        "f_secure": F.startswith(url, F.lit("https")).cast("double"),
        "f_file": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    own = lambda c: F.get(c, _fold(url).cast("int")) if out_of_fold else F.lit(0)
    counted = {
        "f_suffix_pages": F.log2(F.coalesce("pages", F.lit(1)).cast("double")),
        "f_suffix_blocked": F.coalesce((total(F.col("blocks")) - own(F.col("blocks")) + 1) / (total(F.col("labels")) - own(F.col("labels")) + 2), F.lit(0.5)).cast("double"),
    }
    return _with_statistics(urls, statistics).withColumns(lexical | counted).drop("pages", "labels", "blocks"), [*lexical, *counted]


def train(urls: DataFrame, statistics: DataFrame, label: str = "ruled", max_labelled: int = MAX_LABELLED, seed: int = 42):
    """A fitted model, or the only label there is (None without any).  Each URL counts once, however many rows have it."""
    labelled = urls.where(F.col(label).isNotNull()).select("url", "host", "path", label)
    sample = labelled.distinct().orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    rows, features = with_features(sample, statistics, out_of_fold=True)
    rows = keep(rows.select((F.col(label) == "block").cast("double").alias("label"), *features).repartition(2))
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return ("block" if kinds[0] else "allow") if kinds else None
    stages = [VectorAssembler(inputCols=features, outputCol="f"), GBTClassifier(featuresCol="f", labelCol="label", maxIter=20, maxDepth=4, maxBins=64, minInstancesPerNode=20, stepSize=0.1, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_labelled: int = MAX_LABELLED, seed: int = 42) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    urls = with_rules(parsed(pages), rules)
    statistics = keep(suffix_statistics(urls, urls))
    model = train(urls, statistics, max_labelled=max_labelled, seed=seed)
    if model is None or isinstance(model, str):
        said = urls.withColumn("_p", F.lit(model or "allow"))
    else:
        said = model.transform(with_features(urls, statistics)[0]).withColumn("_p", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))
    return said.select("page_id", "host", "path", "rule", F.coalesce("ruled", "_p").alias("verdict"))
