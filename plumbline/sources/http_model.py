"""A model client over HTTP, and replies that are asked for once for each prompt.

The client speaks the common chat-completion form.  A request that fails for
the moment (no connection, time-out, 429, 5xx) is sent again after a wait that
doubles each time, or that the server names; a worker keeps a distance between
its requests.  Any other failure is raised.
"""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import generated

#: Answers of a server after which a request is worth sending again.
PASSING = (408, 425, 429, 500, 502, 503, 504)


class Unanswered(RuntimeError):
    """A request that got no answer after all tries."""


@dataclass
class HttpClient:
    """``generate(prompts)`` by POST requests; the key is read from an environment variable where the client runs."""

    url: str
    model: str
    key_variable: str | None = None
    timeout: float = 60.0
    tries: int = 5
    first_wait: float = 0.5
    longest_wait: float = 30.0
    per_second: float | None = None
    options: dict[str, Any] = field(default_factory=lambda: {"temperature": 0})
    _next: float = field(default=0.0, init=False)

    def generate(self, prompts: list[str]) -> list[dict]:
        return [self._reply(p) for p in prompts]

    def _reply(self, prompt: str | None) -> dict:
        said = self._post({"model": self.model, "messages": [{"role": "user", "content": prompt or ""}], **self.options})
        choice, usage = said["choices"][0], said.get("usage") or {}
        tokens = ((choice.get("logprobs") or {}).get("content")) or []
        known = [t["logprob"] for t in tokens if t.get("logprob") is not None]
        return {
            "text": choice["message"].get("content") or "",
            "mean_logprob": sum(known) / len(known) if known else None,
            "prompt_tokens": usage.get("prompt_tokens") or 0,
            "completion_tokens": usage.get("completion_tokens") or 0,
        }

    def _post(self, body: dict) -> dict:
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        request, why = urllib.request.Request(self.url, json.dumps(body).encode(), headers), ""
        for k in range(self.tries):
            self._pace()
            wait = min(self.first_wait * 2**k, self.longest_wait) * random.uniform(0.5, 1.0)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in PASSING:
                    raise Unanswered(f"{e.code}: {e.read(500).decode(errors='replace')}") from None
                why, named = f"status {e.code}", e.headers.get("Retry-After", "")
                wait = min(float(named), self.longest_wait) if named.isdigit() else wait
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as e:
                why = str(e)
            if k + 1 < self.tries:
                time.sleep(wait)
        raise Unanswered(f"no answer after {self.tries} tries: {why}")

    def _pace(self) -> None:
        if self.per_second:
            now = time.monotonic()
            if now < self._next:
                time.sleep(self._next - now)
            self._next = max(now, self._next) + 1 / self.per_second


def replies(rows: DataFrame, backend: Callable[[], Any], key: str, prompt: str, cache: str, batch: int = 16, tasks: int | None = None) -> DataFrame:
    """(key, and what the client said of its prompt): each distinct prompt is asked once, and never again if ``cache``, a Parquet folder, has it.

    New replies are appended to the cache, which is keyed by the prompt's SHA-256; ``tasks`` bounds how many workers ask
    at once.  A null prompt is asked as an empty one.
    """
    spark = rows.sparkSession
    asked = rows.select(F.col(key).alias("_key"), F.coalesce(prompt, F.lit("")).alias("prompt")).withColumn("prompt_sha256", F.sha2("prompt", 256))
    schema = "prompt_sha256 string, text string, mean_logprob double, prompt_tokens long, completion_tokens long, elapsed_seconds double"
    empty = spark.createDataFrame([], schema)
    try:
        known = spark.read.schema(schema).parquet(cache)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = empty
    new = asked.select("prompt_sha256", "prompt").distinct().join(known.select("prompt_sha256"), "prompt_sha256", "left_anti")
    if tasks:
        new = new.repartition(tasks, "prompt_sha256")
    generated(new, backend, "prompt_sha256", "prompt", batch).write.mode("append").parquet(cache)
    # two callers at once may both have asked
    said = spark.read.schema(schema).parquet(cache).dropDuplicates(["prompt_sha256"])
    return asked.join(said, "prompt_sha256").select(F.col("_key").alias(key), "text", "mean_logprob", "prompt_tokens", "completion_tokens", "elapsed_seconds")
