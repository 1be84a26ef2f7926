"""Structured Streaming: keyed trajectories, stage summaries, online memory, append logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trajectory import Protocol, state_of, state_row

STATE = "steps long, done boolean, total double, last double, invalid long, seen string"


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with time zone; watermarks don't take one without."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    """New Parquet files of a folder, a few per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON lines of a folder; lines that can't be read become rows of nulls, which are dropped."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path).dropna(how="all")


def trajectories(events: DataFrame, protocol: Protocol, key: str, order: str, action: str, value: str) -> DataFrame:
    """The state of each trajectory after every batch that has events of it; a finished one stays as it is."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state_of(state.get if state.exists else None)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order)
        for a, v in rows[[action, value]].itertuples(index=False, name=None):
            protocol.step(s, a, float(v))
        state.update(state_row(s))
        yield pd.DataFrame({key: [k[0]], "steps": [s.steps], "done": [s.done], "total_reward": [s.total], "n_invalid": [s.invalid]})

    schema = f"{key} long, steps long, done boolean, total_reward double, n_invalid long"
    return events.select(key, order, action, value).groupBy(key).applyInPandasWithState(run, schema, STATE, "update", GroupStateTimeout.NoTimeout)


def remembered(events: DataFrame, state: str, action: str, value: str) -> DataFrame:
    """Online memory: after every batch the count and mean return of each state and action seen in it."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, total = held.get if held.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        held.update((int(n), float(total)))
        yield pd.DataFrame({state: [k[0]], action: [k[1]], "n": [n], "mean": [total / n]})

    return events.select(state, action, value).groupBy(state, action).applyInPandasWithState(run, f"{state} string, {action} string, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def window_summary(events: DataFrame, ts: str, value: str, width: str, late: str) -> DataFrame:
    """Count, peak and mean of each event-time window; rows later than ``late`` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.max(value).alias("peak"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "peak", "mean")


def session_summary(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Works off what is there; the result is Parquet in a folder that driver and executors share.

    Each batch has a folder of its own that a repeated batch overwrites, so a
    restart writes nothing twice.  In complete mode the last batch is the result,
    otherwise all rows of all batches, with the column ``batch``.
    """
    spark, out = stream.sparkSession, f"{folder.rstrip('/')}/out"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    try:
        d = spark.read.parquet(out)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)  # nothing came, so there was no batch
    if mode != "complete":
        return d
    last = d.agg(F.max("batch").alias("b")).first()["b"]
    return d.where(F.col("batch") == last).drop("batch")


def append_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends each batch to a JSON lines log; what has been written is not written again after a restart."""
    stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
