"""Shards and the order inside them: hash shards, sorted shards, segments, top k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_shard


def hash_sharded(pairs: DataFrame, shards: int, key: str = "key", sharder: Callable[[Column, int], Column] = hash_shard) -> DataFrame:
    """The rows with their shard, each shard one partition sorted by key: by the range of the key's Murmur hash, or by a sharder of the user's.

    ``sharder(key, shards)`` is an expression of the shard, from 0; one outside the shards fails the job.
    """
    shard = sharder(F.col(key), shards).cast("int")
    if sharder is not hash_shard:
        shard = F.when((shard >= 0) & (shard < shards), shard).otherwise(F.raise_error(F.lit(f"a shard outside 0 to {shards - 1}")).cast("int"))
    return pairs.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions(key)


def shuffled(pairs: DataFrame, shards: int, key: str = "key") -> DataFrame:
    """Hash-partitioned by key and sorted by key inside each partition; keys compare as unsigned bytes."""
    return pairs.repartition(shards, key).sortWithinPartitions(key)


def places(rows: DataFrame, shard: Column, *order: Column) -> DataFrame:
    """The rows with their shard and place in it, from 1."""
    out = rows.withColumn("shard", shard)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(*order)).cast("long"))


def ranked(rows: DataFrame, key: Column, parts: int | None = None) -> DataFrame:
    """The rows with their place in the order of ``key`` over the whole table, from 1, nulls first.

    No task sorts more than a range of keys: borders come from a sample of the keys (those of the smallest hashes, so
    always the same), and a place is the count of the ranges before and the place inside its own. Equal keys share a
    range and get their places in any order. The rows are computed three times: sampled, counted, numbered.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_key", key)
    sample = keyed.select(F.col("_key").alias("k")).where("k IS NOT NULL").orderBy(F.xxhash64("k")).limit(64 * parts).distinct().orderBy("k").collect()
    borders = [sample[i * len(sample) // parts]["k"] for i in range(1, parts)] if len(sample) >= parts else [r["k"] for r in sample]

    def range_of(low: int, high: int) -> Column:
        """The number of borders up to the key, of those from low to high, by halves."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("_key") >= F.lit(borders[mid]), range_of(mid + 1, high)).otherwise(range_of(low, mid))

    placed = keyed.withColumn("_range", range_of(0, len(borders)))
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    before = F.array(*[F.lit(sum(counts.get(j, 0) for j in range(i))).cast("long") for i in range(len(borders) + 1)])
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return placed.withColumn("place", F.element_at(before, F.col("_range") + 1) + own).drop("_range", "_key")


def order_breaks(rows: DataFrame, shard: str, order: str, key: str) -> DataFrame:
    """The rows with a segment that goes up whenever the key falls behind the one before it."""
    w = Window.partitionBy(shard).orderBy(order)
    fell = F.coalesce((F.lag(key).over(w) > F.col(key)).cast("long"), F.lit(0))
    return rows.withColumn("_fell", fell).withColumn("segment", F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")


def flagged_segments(rows: DataFrame, shard: str, order: str, begins: Column) -> DataFrame:
    """The rows with a segment that goes up at every row that begins one."""
    w = Window.partitionBy(shard).orderBy(order)
    return rows.withColumn("segment", F.sum(F.when(begins, 1).otherwise(0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def largest(rows: DataFrame, by: Column, k: int, *ties: Column) -> DataFrame:
    """The k rows of the largest value; each task keeps k, and only those meet."""
    return rows.orderBy(by.desc(), *ties).limit(k)


def round_robin(files: DataFrame, name: str, shards: int) -> DataFrame:
    """The files with the shard that reads each: the i-th by name goes to i mod shards. Meant for listings, not rows."""
    return files.withColumn("shard", (F.row_number().over(Window.orderBy(name)) - 1) % shards)
