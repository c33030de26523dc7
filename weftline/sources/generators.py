"""Sources that make their rows: numbers, random values, rows in memory, nothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits


def consecutive_longs(spark: SparkSession, start: int, limit: int, shards: int) -> DataFrame:
    """(value, shard): the numbers of [start, limit); shard borders at rounded equal steps."""
    if shards < 1 or start > limit:
        raise ValueError("shards must be positive and start at most limit")
    width = (limit - start) / shards
    points = [start + math.floor(i * width + 0.5) for i in range(shards + 1)]
    rows = spark.range(start, limit, 1, shards).withColumnRenamed("id", "value")
    return rows.withColumn("shard", splits.range_of(F.col("value"), points) if limit > start else F.lit(0))


def random_longs(spark: SparkSession, n: int, shards: int, seed: int = 0) -> DataFrame:
    """(value, shard): n numbers over all 64 bits that a seed repeats; the first shards take what is left over."""
    least, more = divmod(n, shards)
    points = [0]
    for i in range(shards):
        points.append(points[-1] + least + (i < more))
    points = sorted(set(points))
    rows = spark.range(0, n, 1, shards)
    shard = splits.range_of(F.col("id"), points) if n else F.lit(0)
    return rows.select(F.xxhash64("id", F.lit(seed)).alias("value"), shard.alias("shard"))


def random_strings(spark: SparkSession, count: int, length: int = 10, shards: int = 4, seed: int = 0) -> DataFrame:
    """(value, shard): strings of lower-case letters; a remainder that doesn't divide becomes one more shard."""
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(26)) + 1).cast("int"), F.lit(1)))
    each = max(1, count // shards)
    return spark.range(0, count, 1, shards).select(F.array_join(letters if length else F.array().cast("array<string>"), "").alias("value"), F.expr(f"cast(least(id div {each}, {shards}) as int)").alias("shard"))


def in_memory(spark: SparkSession, shards: Sequence[Sequence], schema: str) -> DataFrame:
    """Rows held by the driver, one inner list a shard; ``schema`` is that of a row without its shard."""
    rows = [(*(row if isinstance(row, tuple) else (row,)), i) for i, shard in enumerate(shards) for row in shard]
    return spark.createDataFrame(rows, f"{schema}, shard int")


def no_input(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
