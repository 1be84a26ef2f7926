"""JSON within generated text, read with safe defaults."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import clean_strings

MEMORY = "rule_ids array<string>, decision string, facts array<string>, exceptions array<string>, priority string"
ACTION = "action string, k string, rule_ids array<string>"


def tagged_memory(c: Column) -> Column:
    """``<memory>{...}</memory>`` as a struct; missing or wrong parts get defaults and ``valid`` says if it could be read."""
    raw = F.regexp_extract(c, r"(?s)<memory>\s*(\{.*\})\s*</memory>", 1)
    m = F.from_json(F.when(raw != "", raw), MEMORY)
    ok = F.coalesce(F.get_json_object(raw, "$").isNotNull() & (raw != ""), F.lit(False))
    listed = lambda x: F.coalesce(clean_strings(x), F.array().cast("array<string>"))
    return F.struct(
        ok.alias("valid"),
        listed(m["rule_ids"]).alias("rule_ids"),
        F.when(m["decision"].isin("PASS", "REVIEW", "REJECT"), m["decision"]).otherwise("REVIEW").alias("decision"),
        listed(m["facts"]).alias("facts"),
        listed(m["exceptions"]).alias("exceptions"),
        F.coalesce(m["priority"].try_cast("int"), F.lit(0)).alias("priority"),
    )


def parsed_action(c: Column) -> Column:
    """The action object of a reply, and how well it keeps the protocol: 1 exactly, 0.5 if it can be read, 0 without one."""
    raw = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    strict = c.rlike(r"(?s)^\s*<think>.+?</think>\s*\{.*\}\s*\z")
    a = F.from_json(F.when(raw != "", raw), ACTION)
    return F.struct(F.when(strict, 1.0).when(raw != "", 0.5).otherwise(0.0).alias("protocol"), a["action"].alias("action"), a["k"].alias("k"), F.when(raw == "", "no JSON object").when(a["action"].isNull(), "no action").alias("error"))


def scan_object(text: str, required: str) -> dict | None:
    """The first JSON object in a text that has a key, tried from each brace on."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            if isinstance(found, dict) and required in found:
                return found
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def first_object_with(rows: DataFrame, key: str, column: str, required: str) -> DataFrame:
    """(key, found): that object as JSON with sorted keys; null without one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            objects = [scan_object(x, required) for x in pdf[column]]
            yield pd.DataFrame({key: pdf[key], "found": [None if o is None else json.dumps(o, sort_keys=True, ensure_ascii=False) for o in objects]})

    return rows.select(key, column).mapInPandas(run, f"{key} long, found string")
