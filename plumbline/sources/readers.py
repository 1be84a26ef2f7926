"""Sources, each with an explicit schema; ordinals are explicit as file order isn't kept between partitions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped.  ``strict`` raises on a line that can't be read.  Only a line feed ends a line."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Without lines that can't be read and rows that lack a required field."""
    d = spark.read.schema(schema).option("lineSep", "\n").option("mode", "DROPMALFORMED").json(path)
    return d.dropna(subset=list(required))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value) with one-based numbers.

    A file's lines are numbered from the number of lines in its earlier splits;
    ``wholetext`` isn't needed and no task reads a file that is split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    from pyspark.sql import Window as W

    block = W.partitionBy("file", "_at")
    d = lines.withColumn("_in", F.row_number().over(block.orderBy("_id")))
    sizes = d.groupBy("file", "_at").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "_at", before.alias("_before"))
    return d.join(starts, ["file", "_at"]).select("file", (F.col("_before") + F.col("_in")).alias("line_number"), "value")


def line_errors(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), last_role: str | None = None) -> DataFrame:
    """(file, line_number, problem) of JSON lines that can't be read, lack a field, or end in the wrong role."""
    d = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = d.withColumn("r", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    problem = F.when(F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull(), F.lit("not a JSON object"))
    for f in required:
        problem = problem.when(F.col(f"r.{f}").isNull(), F.lit(f"no {f}"))
    if last_role:
        problem = problem.when(F.try_element_at("r.messages", F.lit(-1))["role"] != last_role, F.lit(f"last role isn't {last_role}"))
    return parsed.select("file", "line_number", problem.alias("problem")).where("problem IS NOT NULL")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted line feeds, doubled quotes and perhaps a byte order mark; nothing is null, ``""`` is an empty text.

    The text that stands for null is made anew, so no file holds it: else Spark takes empty texts for null.  Without an
    escape of the escape Spark takes NUL for one and drops it.
    """
    d = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"')
    return d.option("nullValue", uuid.uuid4().hex).option("encoding", "UTF-8").csv(path)


def entities(spark: SparkSession, path: str, schema: str, guards: dict[str, Column]) -> DataFrame:
    """Typed rows; a row that fails a guard raises when it is read.  A missing file is an empty table."""
    try:
        d = jsonl(spark, path, schema, strict=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    for message, ok in guards.items():
        d = d.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    return d


def rule_base(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Active rules with defaults; an empty base or a repeated id raises."""
    return checked_rules(jsonl(spark, path, schema))


def checked_rules(rules: DataFrame) -> DataFrame:
    d = rules.withColumns({"status": F.coalesce("status", F.lit("active")), "canonical_id": F.coalesce("canonical_id", "rule_id"), "priority": F.coalesce("priority", F.lit(0))})
    active = d.where("status = 'active'")
    if active.isEmpty():
        raise ValueError("no active rule")
    twice = [r[0] for r in active.groupBy("rule_id").count().where("count > 1").select("rule_id").limit(5).collect()]
    if twice:
        raise ValueError(f"rule ids that come more than once: {twice}")
    return active


def stage_log(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, stage) of lines ``[ISO time] name``."""
    return stage_lines(spark.read.text(path))


def stage_lines(lines: DataFrame) -> DataFrame:
    pattern = r"^\[([^\]]+)\] (.+)$"
    d = lines.select(F.try_to_timestamp(F.regexp_extract("value", pattern, 1)).alias("ts"), F.regexp_extract("value", pattern, 2).alias("stage"))
    return d.where(F.col("ts").isNotNull() & (F.col("stage") != "")).select((F.unix_micros("ts") / 1e6).alias("epoch"), "stage")


def newest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder, newest first, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime", "length", F.regexp_extract("path", r"(\d+)\D*$", 1).try_cast("long").alias("step")).orderBy(F.col("modificationTime").desc(), F.col("step").desc())


def merged_views(parts: dict[str, DataFrame], root: str) -> DataFrame:
    """Views of several splits under one another, image paths made absolute."""
    out = None
    for name, d in parts.items():
        d = d.withColumns({"images": F.transform("images", lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))), "split": F.lit(name)})
        out = d if out is None else out.unionByName(d)
    return out


def tar_members(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """(archive, member, content) of an archive's files; members with unsafe names are refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if ".." in m.name.split("/") or m.name.startswith("/"):
                            raise ValueError(f"unsafe member name: {m.name}")
                        if m.isfile() and m.name.lower().endswith(tuple(suffixes)):
                            yield pd.DataFrame({"archive": [name], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


BACKENDS: dict[str, Callable[..., Any]] = {}


def backend(kind: str, make: Callable[..., Any] | None = None, **options: Any) -> Callable[[], Any]:
    """Registers how to make a model client of a kind, or gives a maker of the one registered, with options."""
    if make is not None:
        BACKENDS[kind] = make
    if kind not in BACKENDS:
        raise ValueError(f"no backend of kind {kind}; there are {sorted(BACKENDS)}")
    return partial(BACKENDS[kind], **options)


def generated(rows: DataFrame, backend: Callable[[], Any], key: str, prompt: str, batch: int = 16) -> DataFrame:
    """Replies of a model client to each prompt, in batches; the client is made once per task.

    The client has ``generate(list[str]) -> list[dict]`` with text, mean_logprob
    (or None), prompt_tokens and completion_tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        client = backend()
        for whole in batches:
            for at in range(0, len(whole), batch):  # only these prompts become Python strings
                part = whole.slice(at, batch)
                began = time.perf_counter()
                replies = client.generate(part.column(1).to_pylist())
                each = (time.perf_counter() - began) / max(len(replies), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([r["text"] for r in replies], pa.string()),
                        pa.array([r.get("mean_logprob") for r in replies], pa.float64()),
                        pa.array([int(r.get("prompt_tokens", 0)) for r in replies], pa.int64()),
                        pa.array([int(r.get("completion_tokens", 0)) for r in replies], pa.int64()),
                        pa.array([each] * len(replies), pa.float64()),
                    ],
                    [key, "text", "mean_logprob", "prompt_tokens", "completion_tokens", "elapsed_seconds"],
                )

    return rows.select(key, prompt).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string, mean_logprob double, prompt_tokens long, completion_tokens long, elapsed_seconds double")


def with_cost(replies: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """Estimated cost from tokens and prices per thousand tokens."""
    return replies.withColumns({"estimated_cost": F.col("prompt_tokens") / 1000 * prompt_price + F.col("completion_tokens") / 1000 * completion_price, "has_logprobs": F.col("mean_logprob").isNotNull()})
