"""Sinks: text by format, sharded and segmented files, NDJSON with its schema, record logs, keyed tables, nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import spark_schema, table_schema


def formatted(rows: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """(value): each row by a printf pattern."""
    return rows.select(F.format_string(pattern, *[F.col(c) for c in columns]).alias("value"))


def write_text(lines: DataFrame, path: str, terminator: str = "\n", mode: str = "error") -> list[str]:
    """Writes (value) as text and returns the files; Spark's commit leaves each task's output once, whatever is retried."""
    lines.write.mode(mode).option("lineSep", terminator).text(path)
    return written_files(lines.sparkSession, path)


def written_files(spark, path: str) -> list[str]:  # noqa: ANN001
    jvm, at = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    names = []
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if "/part-" in name:
            names.append(name)
    return sorted(names)


def write_json(rows: DataFrame, path: str, mode: str = "error") -> str:
    """One object a line, nulls left out; returns the table schema that loads it, as JSON."""
    schema = json.dumps({"fields": table_schema(rows.schema)})
    rows.write.mode(mode).json(path)
    return schema


def load_json(spark: SparkSession, path: str, schema: str, table: str | None = None, mode: str = "error") -> DataFrame:
    """The rows of JSON files by the table schema that ``write_json`` returned, saved as ``table`` if that is given.

    A line that isn't JSON fails the load. Times are read from seconds since 1970 where ``json_rows`` wrote them.
    """
    fields = json.loads(schema)["fields"]
    rows = spark.read.schema(spark_schema(fields)).option("mode", "FAILFAST").json(path)
    if table is not None:
        rows.write.mode(mode).saveAsTable(table)
        rows = spark.table(table)
    return rows


def write_sharded(rows: DataFrame, shard: Column, shards: int, path: str, mode: str = "error") -> None:
    """A folder for each shard, written by one task each."""
    out = rows.withColumn("shard", shard)
    out.repartitionById(shards, F.col("shard").cast("int")).write.mode(mode).partitionBy("shard").parquet(path)


def segments_by_size(rows: DataFrame, shard: str, order: str, size: Column, most: int) -> DataFrame:
    """The rows with the segment they fall in: a new one begins when the next row would exceed ``most`` bytes.

    The sum starts again with each segment, so sorted shards stream through a task; nothing is held but one sum.
    A null size counts as nothing, a null shard is a shard. Rows of one shard should differ in ``order``.
    """
    out = rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    schema = rows.withColumn("segment", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, segment, first = None, 0, 0, True
        for batch in batches:
            found = []
            for s, n in zip(batch.column(shard).to_pylist(), batch.column("_size").to_pylist(), strict=True):
                if first or s != now:
                    now, total, segment, first = s, 0, 0, False
                elif total + n > most:
                    total, segment = 0, segment + 1
                total += n
                found.append(segment)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(found, pa.int64())], schema.names)

    return out.repartition(shard).sortWithinPartitions(shard, order).mapInArrow(run, schema)


def by_shard(rows: DataFrame, shard: str, order: str, value: str) -> list[list]:
    """Results in memory as one list a shard, for results known to be small."""
    lists = rows.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v")).orderBy(shard).collect()
    return [[x[value] for x in r["v"]] for r in lists]


def write_nothing(rows: DataFrame) -> None:
    """Runs the job for its effects and keeps nothing."""
    rows.write.format("noop").mode("overwrite").save()


def upserted(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table with rows of equal key replaced and new ones added; columns that changes lack stay as they are.

    Of several changes to one key the last by ``order`` counts; without an order such changes fail the job, as which
    one counts isn't said. A null key is a key.
    """
    if order is not None:
        changes = latest(changes, key, order)
    else:
        n = F.count("*").over(Window.partitionBy(key))
        changes = changes.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit("several changes to one key and no order among them")).isNull()).drop("_n")
    changed = [c for c in changes.columns if c in table.columns]
    new = changes.select(*[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_changed"))
    both = table.join(new, F.col(key).eqNullSafe(F.col(f"_new_{key}")), "full")
    return both.select(*[F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns])


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def in_batches(rows: DataFrame, put, size: int = 100) -> None:  # noqa: ANN001
    """Hands rows to ``put(list)`` on the executors, so many at a time. A retried task puts again: make it idempotent."""

    def run(part: Iterator) -> None:
        held = []
        for row in part:
            held.append(row.asDict(recursive=True))
            if len(held) >= size:
                put(held)
                held = []
        if held:
            put(held)

    rows.foreachPartition(run)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last of several changes to one key."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
