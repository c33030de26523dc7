"""What the training-data operators share: written tables, bounded samples, joins of hot keys, connected components."""

from __future__ import annotations

import atexit
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast: some 16 MB of keys and numbers.
BROADCAST_ROWS = 200_000
#: Rows of one key from which a join goes by broadcast: at most rows / HOT_ROWS keys are that hot.
HOT_ROWS = 1_000_000

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's own under ``spark.checkpoint.dir``, removed when the driver ends.

    Where that setting is absent in local mode (tests), a folder on this machine takes its place; on a cluster that
    would be another folder on each machine, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
            base = "file://" + tempfile.mkdtemp(prefix="weftline-")
        _folders[app] = f"{base.rstrip('/')}/weftline-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark, _folders[app])
    return _folders[app]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of written tables; a session that has ended has nothing left to do it with."""
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as error:  # the gateway may be gone at exit
        print(f"{path} stays: {error}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    return at(df, name)[0]


def at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's path, so that a loop can remove what it has superseded."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def send(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts a model of bounded size; called in a task, what is returned gives it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def remainder(column: str, by: int) -> Column:
    """crc32 of a number as text, modulo ``by``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def fits_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most so many rows; it counts no further than that."""
    return df.limit(most + 1).count() <= most


def sample_rows(df: DataFrame, key: str, n: int, strata: str, most_strata: int) -> list:
    """(key, text, stratum), collected: at most ``n`` keys of each of the ``most_strata`` largest strata.

    Always the same ones: the keys of the smallest hashes, strata that tie by name, and of a key's rows the least by
    text. A stratum may hold most of the rows: each is first thinned within 64 salts, so no task sorts a whole one.
    """
    largest = [r[strata] for r in df.groupBy(strata).count().orderBy(F.desc("count"), strata).limit(most_strata).collect()]
    order = [F.xxhash64(F.col(key), F.lit("sample")), F.col(key)]
    keys = df.where(F.col(strata).isin(largest)).select(key, strata).distinct().withColumn("_salt", F.pmod(F.hash(key), F.lit(64)))
    for part in ([strata, "_salt"], [strata]):
        keys = keys.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("_n") <= n)
    chosen = df.join(F.broadcast(keys.select(key, strata)), [key, strata], "left_semi")  # most_strata * n keys at most
    return chosen.groupBy(key).agg(F.min(F.struct("text", strata)).alias("r")).select(key, "r.text", f"r.{strata}").orderBy(key).collect()


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, n: int, chars: int) -> list:
    """Labelled documents (doc_id, text, y) in the order of doc_id: at most ``n`` of them and ``chars`` characters.

    Taken in the order of the hashed doc_id; a document that no longer fits is passed over for the next that does, so
    long texts are in the sample while there is room. Nulls are no labels; where a doc_id has several labels the
    largest counts, where it has several texts the least.
    """
    given = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    sizes = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("_n"))
    there = given.join(sizes, "doc_id").groupBy("doc_id", "y").agg(F.max("_n").alias("_n"))
    room, chosen = chars, []
    for r in there.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(n).collect():
        if r["_n"] <= room:
            room -= r["_n"]
            chosen.append((r["doc_id"], r["y"]))
    wanted = docs.sparkSession.createDataFrame(chosen, given.schema)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").collect()


def joined(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, hot: int = HOT_ROWS) -> DataFrame:
    """left join right on ``key``, which right has once each, with the number of left's rows of that key in ``rows``.

    Left, of ``total`` rows, may have most of them under one key: keys of over ``hot`` rows, at most total / hot of
    them, are broadcast and their rows stay where they are; the others meet by shuffle. Left is then read twice.
    """
    if total <= hot:
        return left.join(right.drop(rows), key)
    few = right.where(F.col(rows) > hot).drop(rows)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(F.col(rows) <= hot).drop(rows), key)
    return left.join(F.broadcast(few), key).unionByName(rest)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in pieces small enough for their Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", hot: int = HOT_ROWS) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the component's smallest node.

    Alternates large-star and small-star steps, each an aggregation and a join, until the edges no longer change;
    the tables are written between steps and nothing but two sums reaches the driver. A hub's edges are joined
    where they are, see ``joined``.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now, path = at(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    spark, before, total = edges.sparkSession, None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: each larger neighbour of a node is tied to the smallest node around it
        large = joined(both.where("b > a"), low, "a", "n", 2 * total, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, step = at(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # small star: the smaller neighbours of a node and the node itself are tied to the smallest of them
        small = joined(large, least, "a", "n", 2 * total, hot).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after, new = at(small.where("a <> b").distinct(), "small-star")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (path, step):
            remove(spark, old)
        if state == before:
            break
        now, path, before, total = after, new, state, state[0]
    roots = after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
