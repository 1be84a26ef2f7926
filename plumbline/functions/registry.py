"""Named reward functions: expressions where Spark can tell them, asynchronous clients where it can't."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

Reward = Callable[..., Column]

REWARDS: dict[str, Reward] = {}


def reward(name: str) -> Callable[[Reward], Reward]:
    def keep(f: Reward) -> Reward:
        if name in REWARDS:
            raise ValueError(f"{name} is registered twice")
        REWARDS[name] = f
        return f

    return keep


def apply(rows: DataFrame, names: Sequence[str], **columns: str) -> DataFrame:
    """Adds a column for each reward; ``columns`` binds the functions' arguments to columns."""
    missing = [n for n in names if n not in REWARDS]
    if missing:
        raise KeyError(f"no such reward: {missing}")
    bound = {k: F.col(c) for k, c in columns.items()}
    return rows.withColumns({n: REWARDS[n](**bound) for n in names})


def for_task(applies: Column, value: Column) -> Column:
    """A metric of one task only: null for rows of other tasks."""
    return F.when(applies, value)


def _unit(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


@reward("boxed_format")
def _boxed_format(response: Column, **_: Column) -> Column:
    return _unit(F.contains(response, F.lit("boxed")))


@reward("label_accuracy")
def _label_accuracy(response: Column, label: Column, **_: Column) -> Column:
    return _unit(text.label_answer(response, ["de", "en", "es", "fr"]) == label)


@reward("answer_accuracy")
def _answer_accuracy(response: Column, label: Column, **_: Column) -> Column:
    return _unit(text.normal_answer(text.answer_tag(response)) == text.normal_answer(label))


@reward("strict_think_box")
def _strict(response: Column, **_: Column) -> Column:
    return _unit(text.strict_think_box(response))


class LengthJudge:
    """A client for tests: the score grows with the reply's length."""

    async def score(self, reply: str) -> float:
        return min(len(reply) / 100, 1.0)


def async_scores(rows: DataFrame, key: str, reply: str, client: Callable[[], Any], concurrent: int = 16, attempts: int = 2) -> DataFrame:
    """(key, score) of an asynchronous judge: bounded concurrency, a second attempt, each reply asked once per batch, 0 on failure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import asyncio

        judge = client()

        async def one(limit: asyncio.Semaphore, x: str) -> float:
            async with limit:
                for _ in range(attempts):
                    try:
                        return float(await judge.score(x))
                    except Exception:  # noqa: BLE001
                        continue
            return 0.0

        async def every(replies: list[str]) -> dict[str, float]:
            limit = asyncio.Semaphore(concurrent)
            return dict(zip(replies, await asyncio.gather(*(one(limit, x) for x in replies)), strict=True))

        for pdf in frames:
            known = asyncio.run(every(sorted({x for x in pdf[reply] if x is not None})))
            yield pd.DataFrame({key: pdf[key], "score": [known.get(x, 0.0) for x in pdf[reply]]})

    return rows.select(key, reply).mapInPandas(run, f"{key} long, score double")
