"""Whole shuffles between files, and rows that say what to do with a table."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import group_bytes, pair_columns
from ..sources import recordlog
from . import grouping, sinks

PUT, DELETE = "put", "delete"


def shuffle_files(spark: SparkSession, inputs: Sequence[str], output: str, shards: int, most: int = 10_000) -> str:
    """Record logs of pairs become record logs of groups: each key in one shard, keys in order, ``most`` values a group.

    A file listed twice is read twice. Returns a manifest of the files written, as JSON.
    """
    if not 1 <= shards <= 2048:
        raise ValueError("shards must be 1 to 2048")
    recordlog.register(spark)
    logs = [spark.read.format("recordlog").load(p) for p in inputs]
    records = logs[0]
    for more in logs[1:]:
        records = records.unionAll(more)
    pairs = records.select(pair_columns(F.col("record")).alias("p")).select("p.*")
    groups = grouping.bounded_groups(pairs, most)

    @F.pandas_udf("binary")
    def encoded(keys: pd.Series, values: pd.Series, partial: pd.Series) -> pd.Series:
        return pd.Series([group_bytes(bytes(k), [bytes(v) for v in vs], bool(p)) for k, vs, p in zip(keys, values, partial, strict=True)])

    placed = groups.repartition(shards, "key").sortWithinPartitions("key", "chunk")
    placed.select(encoded("key", "values", "partial").alias("record")).write.format("recordlog").mode("overwrite").save(output)
    return json.dumps({"files": sinks.written_files(spark, output)})


def regrouped(groups: DataFrame) -> DataFrame:
    """(key, values) of partial groups (key, chunk, values): what was cut for its size, in one row again."""
    return groups.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "values"))), lambda x: x["values"])).alias("values"))


def applied(table: DataFrame, operations: DataFrame, key: str, order: str) -> DataFrame:
    """The table after rows of operations (op, order, the table's columns); the last of a key counts."""
    last = sinks.latest(operations, key, order)
    kept = sinks.deleted(table, last, key)
    return kept.unionByName(last.where(F.col("op") == PUT).select(*table.columns))


def with_neighbour(rows: DataFrame, shard: str, order: str, *columns: str) -> DataFrame:
    """The rows with the next row's columns beside them, as a reader that looks ahead sees them."""
    from pyspark.sql import Window

    w = Window.partitionBy(shard).orderBy(order)
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
