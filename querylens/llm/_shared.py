"""Helpers that several operators use: checkpoints, shard counts and gapless ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.plans.checkpoints import checkpoint_folder, checkpointed, delete_folder  # noqa: F401

# What separates words: space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrays(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded result as arrays; by Arrow, so that no row becomes a Python object."""
    return [c.to_numpy() for c in df.toArrow().columns]


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; decides how many shards an operator deals its input to."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def shards_for(n_bytes: int, per_shard: int, least: int = 6) -> int:
    return max(least, -(-n_bytes // per_shard))


BROADCAST_ROWS = 200_000  # of a few numbers and short strings each


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most `most` rows. They are counted, so give it checkpointed."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often lambdas in the body use it, and nothing copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda known, _: known, body)


MOST_PARTITIONS = 20_000


def by_shard(df: DataFrame, shards: int, column: str = "shard") -> DataFrame:
    """Rows of a shard together, in as many partitions as there are shards; a task holds one shard in memory at a time."""
    return df.repartition(min(shards, MOST_PARTITIONS), column)


def gapless_rank(df: DataFrame, group: str, bucket: str, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without bringing a group into one task.

    Rows are numbered inside (group, bucket); a prefix sum over the bucket counts of a group, a table of
    one row per group and bucket, gives each bucket's first number. Both columns must not be null.
    `df` is read twice, so give it checkpointed.
    """
    counts = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    return df.join(starts, [group, bucket]).withColumn(out, F.col("__start") + F.row_number().over(inside) - 1).drop("__start")
