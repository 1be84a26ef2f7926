"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a site if more than ``ratio`` of the site's pages hold
it, and ``min_pages`` pages at least (a parameter; 2, as a line of one page only
is nobody's boilerplate).  Pages are counted once per line, before the shuffle;
lines travel as two 64-bit hashes and texts don't travel: what returns to the
pages is one list per site, and as a boilerplate line takes more than ``ratio``
of the pages, a site has at most (mean lines a page) / ratio of them.  The lists
are kept, their lines are counted, and they are broadcast up to
``BROADCAST_LINES``.  Beyond that pages meet their site's list by site and one of
``SALTS`` shares of its pages, so that a site with a third of all pages is no
single task's.

Defined results: lines are split at ``\\n`` and compared without white space at
their ends; blank lines are never counted or dropped; a null site is a site of
its own; a null text has no lines and stays null; repeated rows are pages of
their own.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

RATIO = 0.02
MIN_PAGES = 2
BLANK = " \t\x0b\x0c\r"
#: Lines of all lists up to which these are broadcast: at most 40 MB.
BROADCAST_LINES = 1_000_000
SALTS = 64


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit(1), _bare(line)).alias("b"))


def _full(line: Column) -> Column:
    return F.length(_bare(line)) > 0


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(b_site, lines): the keys of each site's boilerplate lines.  ``pages`` has site and text."""
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _full), _key))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    counts = pages.select("site", F.explode(keys).alias("line")).groupBy("site", "line").agg(F.count("*").alias("holding")).where(F.col("holding") >= min_pages)
    c, t = counts.alias("c"), totals.alias("t")
    common = c.join(t, F.col("c.site").eqNullSafe(F.col("t.site"))).where(F.col("holding") > F.lit(ratio) * F.col("pages"))
    return common.groupBy("c.site").agg(F.collect_list("line").alias("lines")).withColumnRenamed("site", "b_site")


def _with_lists(pages: DataFrame, found: DataFrame) -> DataFrame:
    found = keep(found)
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    by_site = F.col("site").eqNullSafe(F.col("b_site"))
    if size <= BROADCAST_LINES:
        return pages.join(F.broadcast(found), by_site, "left")
    salted = found.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
    return pages.withColumn("_salt", salt).join(salted, by_site & (F.col("_salt") == F.col("b_salt")), "left").drop("_salt", "b_salt")


def line_dedup(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, site, n_lines, n_dropped, text without the site's boilerplate lines."""
    pages = docs.select("doc_id", F.col(site).alias("site"), "text")
    lines = F.split("text", "\n")
    firsts = F.transform(lines, lambda x: F.xxhash64(_bare(x)))
    # one pass over the site's list by a hash set; what is compared line by line is only what the page has of it
    here = F.array_intersect(firsts, F.transform("lines", lambda k: k["a"]))
    own = F.filter("lines", lambda k: F.array_contains(F.col("_here"), k["a"]))
    joined = _with_lists(pages, boilerplate(pages, ratio, min_pages))
    joined = joined.withColumn("_here", F.coalesce(here, F.array().cast("array<bigint>"))).withColumn("_own", F.when(F.size("_here") > 0, own).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")))
    stays = F.when(F.size("_own") > 0, F.filter(lines, lambda x: ~_full(x) | ~F.array_contains(F.col("_own"), _key(x)))).otherwise(lines)
    return joined.select("doc_id", "site", lines.alias("_lines"), stays.alias("_stays")).select(
        "doc_id",
        "site",
        F.coalesce(F.size(F.filter("_lines", _full)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_stays"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join("_stays", "\n").alias("text"),
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", F.col("site").alias("source"), "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


ORACLE = f"""
WITH split AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
bare AS (SELECT doc_id, source, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM split),
held AS (SELECT DISTINCT doc_id, source, line FROM bare WHERE line <> ''),
counts AS (SELECT source, line, count(*) AS holding FROM held GROUP BY ALL),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL),
common AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
           WHERE holding >= {MIN_PAGES} AND holding > {RATIO}::DOUBLE * pages),
lists AS (SELECT source AS s, list(line) AS lines FROM common GROUP BY source),
kept AS (SELECT doc_id, source, string_split(text, chr(10)) AS all_lines,
           list_filter(string_split(text, chr(10)), lambda x: lines IS NULL OR NOT list_contains(lines, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS stays
         FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.s)
SELECT doc_id, source,
  coalesce(len(list_filter(all_lines, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')), 0)::BIGINT AS n_lines,
  coalesce(len(all_lines) - len(stays), 0)::BIGINT AS n_dropped,
  md5(array_to_string(stays, chr(10))) AS kept_md5
FROM kept
"""
