"""Sinks: JSON lines, checksummed manifests, fingerprinted result caches, reports."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder


def jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with keys in column order and nulls kept."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and doubled quotes; line feeds and blanks stay, null is written as nothing and an empty text as ``""``.

    Of one column all is quoted, and null written as an empty text: a blank line would be read as no row.
    """
    rows.write.mode(mode).option("header", True).option("quoteAll", len(rows.columns) == 1).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def tar(spark: SparkSession, path: str, files: dict[str, bytes]) -> None:
    """An archive of a few small files, made on the driver and written to where Spark can read it."""
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as out:
        for name, content in files.items():
            member = tarfile.TarInfo(name)
            member.size = len(content)
            out.addfile(member, io.BytesIO(content))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        stream.write(bytearray(held.getvalue()))
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, rows, bytes, sha256) of a folder's text files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", "/", -1)
    sums = files.select("path", name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    counts = lines.where(F.trim("value") != "").groupBy(F.substring_index("_metadata.file_path", "/", -1).alias("file")).agg(F.count("*").alias("rows"))
    return sums.join(counts, "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", "sha256")


def canonical(*columns: str):
    """Compact JSON with the keys in alphabetical order, for hashing."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fingerprint(rows: DataFrame, key: str, config: dict) -> str:
    """SHA-256 of the rows' canonical JSON in key order, and of the configuration.

    Row hashes are added up first, so no task needs the rows together: the sum of
    hashes of (key, row) depends on neither order nor partitions.
    """
    h = F.sha2(canonical(*rows.columns), 256)
    parts = rows.select(h.alias("h")).select(*(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long").alias(f"p{k}") for k in range(8)))
    sums = parts.agg(F.count("*").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(8))).first()
    import hashlib

    return hashlib.sha256(json.dumps([list(sums), config], sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


MANIFEST = "_manifest.json"


def _store(spark: SparkSession, path: str):
    """The Hadoop file context of a path, its path class, and the option of a rename that replaces nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    where = hadoop.Path(path).getFileSystem(conf).makeQualified(hadoop.Path(path))
    never = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    never[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
    return hadoop.FileContext.getFileContext(where.toUri(), conf), hadoop.Path, never


def _parts(spark: SparkSession, path: str) -> list[list]:
    """Names and lengths of a stored table's files."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return sorted([f.getPath().getName(), f.getLen()] for f in found if f.getPath().getName().endswith(".parquet"))


def stored(spark: SparkSession, path: str) -> dict | None:
    """What a stored result says of itself, if it is there and all its files are as they were written."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
        told = json.loads(jvm.org.apache.commons.io.IOUtils.toString(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at), "UTF-8"))
        return told if _parts(spark, path) == told["parts"] else None
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "FileNotFound" in str(e):
            return None
        raise


def commit(spark: SparkSession, rows: DataFrame, path: str) -> bool:
    """Stores a table as a whole or not at all; False if another writer was first, whose table stays.

    The rows are written to a folder of their own beside it, with a list of their files, which is then given the name in
    one step that never replaces a folder.  A writer that dies leaves its own folder and nothing under the name.
    """
    parent, name = path.rstrip("/").rsplit("/", 1)
    staged = f"{parent}/.{name}-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    told = {"rows": spark.read.schema(rows.schema).parquet(staged).count(), "parts": _parts(spark, staged)}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{staged}/{MANIFEST}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(json.dumps(told).encode())
    out.close()
    context, where, never = _store(spark, parent)
    try:
        _name(context, where(staged), where(path), never)
    except Exception:  # noqa: BLE001
        if stored(spark, path) is None:
            raise
        delete_folder(spark, staged)
        return False
    return True


def _name(context, old, new, never) -> None:
    context.rename(old, new, never)


def cached(spark: SparkSession, folder: str, print_: str, expected_rows: int, make) -> DataFrame:
    """A stored result under its fingerprint if it is whole, else what ``make`` gives, stored; of two writers one is read by both."""
    path = f"{folder.rstrip('/')}/{print_}"
    told = stored(spark, path)
    if told is None or told["rows"] != expected_rows:
        delete_folder(spark, path)  # what is there isn't whole
        commit(spark, make(), path)
        told = stored(spark, path)
    if told is None or told["rows"] != expected_rows:
        raise ValueError(f"{told and told['rows']} rows written, {expected_rows} expected")
    return spark.read.parquet(path)


def summary(rows: DataFrame, limit: int = 10_000) -> str:
    """A small table as indented JSON; more than ``limit`` rows raise."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows are no summary")
    return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, indent=2, default=str)


def markdown(rows: DataFrame, formats: dict[str, str] | None = None, limit: int = 1000) -> str:
    """A small table in Markdown; null is a dash, and more than ``limit`` rows raise."""
    show = lambda c, v: "—" if v is None else format(v, (formats or {}).get(c, ""))
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows are no table to read")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(c, r[c]) for c in rows.columns) + " |" for r in found])


def trimmed(rows: DataFrame, columns: Sequence[str], path_columns: Sequence[str] = (), only=None) -> DataFrame:
    """Small columns only, machine paths cut to the file name, and only the rows asked for."""
    d = rows if only is None else rows.where(only)
    return d.select(*(F.substring_index(c, "/", -1).alias(c) if c in path_columns else F.col(c) for c in columns))
