"""What the operators of this package share."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on the rows of its first argument, for columns of any name: those with a dot or a backtick have another one meanwhile."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        fresh, back = {}, {}
        for c in docs.columns:
            if "." in c or "`" in c:
                name = c.replace(".", "_").replace("`", "_")
                while name.lower() in {x.lower() for x in (*docs.columns, *back)}:
                    name += "_"
                fresh[c], back[name] = name, c
        if not fresh:
            return operator(docs, *args, **more)
        out = operator(docs.toDF(*(fresh.get(c, c) for c in docs.columns)), *args, **more)
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return run


def keep(df: DataFrame) -> DataFrame:
    """Write a narrow table to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table as Parquet to the shared folder and read it again; with the path of its folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of a narrow table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame) -> DataFrame:
    """A kept narrow table, marked for broadcast if its counted rows are few."""
    df = keep(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Shares of a key's rows, where a side of keys is too large to be broadcast and one key may hold most rows.
SALTS = 64


def meet(rows: DataFrame, side: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """Rows with what ``side`` says on their keys, one row for each: by broadcast if those are few, else by key and share of its rows."""
    side = keep(side)
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), keys, how)
    share = "_share"
    while share in rows.columns or share in side.columns:
        share += "_"
    shared = side.withColumn(share, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(share, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(shared, [*keys, share], how).drop(share)


def shuffle_width(spark: SparkSession, units: int, per_task: int) -> int:
    """Partitions so that one holds about ``per_task`` units, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(units) // per_task), 1)


def text_bytes(df: DataFrame, column: str) -> int:
    return int(df.select(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("n")).first()["n"])
