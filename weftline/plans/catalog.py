"""The queries of the engine's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, hashing, text
from ..operators import counters, exchange, grouping, mapping, ordering, schema, sinks, splits
from ..sources import contract, files, generators, recordlog, scan
from ..streaming import slices
from .spec import JobSpec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of the same rows where there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


_WORDS_SQL = "list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '\\W+', ' ', 'g'), '[_0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_DOC_WORDS = f"(SELECT doc_id, unnest({_WORDS_SQL.format('text')}) AS word FROM documents)"


# --- example jobs


@query(f"SELECT word, count(*) AS n FROM {_DOC_WORDS} GROUP BY word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = JobSpec(
        "word count",
        source=lambda s: table(s, sf_dir, "documents").select("text"),
        mapper=lambda d: d.select(F.explode(text.words(F.col("text"))).alias("word")),
        keys=("word",),
        aggregates=(F.count("*").alias("n"),),
    )
    return job.build(spark)


@query(f"SELECT word, list_sort(list(DISTINCT doc_id)) AS docs FROM {_DOC_WORDS} GROUP BY word")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))


@query(f"""
WITH s AS (SELECT source, unnest(string_split(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[\\\\.?!]', chr(10), 'g'), chr(10))) AS s FROM documents),
w AS (SELECT source, {_WORDS_SQL.format('s')} AS w FROM s),
p AS (SELECT source, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ':')] WHEN len(w) > 4 THEN list_transform(range(0, len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 4), ':')) ELSE [] END) AS phrase FROM w),
c AS (SELECT phrase, source, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY phrase) AS total FROM c)
SELECT phrase, source, n FROM t WHERE total >= 10 AND n > total // 2
""")
def distinctive_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.explode(text.sentences(F.col("text"))).alias("s"))
    split = docs.select("source", text.words(F.col("s")).alias("w"))  # a column of its own, or each phrase would split its sentence again
    starts = split.select("source", "w", F.explode(text.phrase_starts(F.col("w"))).alias("i"))
    phrases = starts.select("source", text.phrase_at(F.col("w"), F.col("i")).alias("phrase"))
    return grouping.majority(phrases, 10, "phrase", "source").select("phrase", "source", "n")


@query("SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(text.characters(F.col("text"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("SELECT (k * 7919) % 1009 AS hash, list_sort(list(k)) AS seeds FROM (SELECT o_orderkey AS k FROM orders) GROUP BY ALL HAVING count(*) > 1")
def seed_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919 % 1009).alias("hash"), F.col("o_orderkey").alias("seed"))
    return grouping.collisions(pairs, "hash", "seed").withColumnRenamed("values", "seeds")


@query("SELECT CAST(abs(o_orderkey) % 37 AS VARCHAR) AS key, list_sort(list(o_orderkey)) AS values FROM orders GROUP BY ALL")
def mod37_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select((F.abs("o_orderkey") % 37).cast("string").alias("key"), F.col("o_orderkey").alias("value"))
    return grouping.grouped(pairs)


@query("SELECT DISTINCT CAST(abs(o_orderkey) % 37 AS VARCHAR) AS key FROM orders")
def mod37_keys_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.keys_once(table(spark, sf_dir, "orders").select((F.abs("o_orderkey") % 37).cast("string").alias("key")))


@query("SELECT o_orderkey AS value FROM orders")
def mod37_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.values_only(table(spark, sf_dir, "orders").select((F.abs("o_orderkey") % 37).alias("key"), F.col("o_orderkey").alias("value")))


@query("""
SELECT tag AS key, list_sort(list(x)) AS values FROM (
  SELECT 'even' AS tag, o_orderkey AS x FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'multiple-of-ten', o_orderkey FROM orders WHERE o_orderkey % 10 = 0) GROUP BY tag
""")
def even_multiple_of_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_orderkey")
    tags = F.array_compact(F.array(F.when(x % 2 == 0, F.lit("even")), F.when(x % 10 == 0, F.lit("multiple-of-ten"))))
    return grouping.grouped(table(spark, sf_dir, "orders").select(F.explode(tags).alias("key"), x.alias("value")))


@query("SELECT o_orderkey % 4 AS key, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY ALL")
def combiner_sum_mod4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 4).alias("key")).agg(F.sum("o_orderkey").alias("total"))


def _sum_up(key, values, so_far):  # noqa: ANN001, ANN202
    yield sum(values) + sum(so_far)


@query("SELECT CAST(l_orderkey % 4 AS VARCHAR) AS key, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY ALL")
def user_combiner_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).cast("string").alias("key"), F.col("l_linenumber").cast("long").alias("value"))
    return grouping.combined(pairs, _sum_up)


def _span(key, values):  # noqa: ANN001, ANN202
    first = last = None
    n = 0
    for v in values:
        first, last, n = v if first is None else first, v, n + 1
    yield key, first, last, n


@query("SELECT l_suppkey AS key, min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS n FROM lineitem GROUP BY ALL")
def user_reducer_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("value"))
    return grouping.reduced(pairs, _span, "key long, low long, high long, n long")


@query("SELECT '1' AS key, count(*) AS n FROM lineitem")
def hot_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit("1").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# --- mappers and groups


@query("SELECT o_custkey AS key, o_orderkey AS value FROM orders")
def identity_mapreduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.identity(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")))


@query("SELECT o_orderkey AS key, CAST(NULL AS VARCHAR) AS value FROM orders")
def key_projection_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.keyed(table(spark, sf_dir, "orders"), F.col("o_orderkey"))


def _two(row):  # noqa: ANN001, ANN202
    yield row["n_name"], len(row["n_name"])
    if row["n_regionkey"] == 0:
        yield row["n_name"].lower(), -1


@query("SELECT n_name AS name, CAST(length(n_name) AS BIGINT) AS n FROM nation UNION ALL SELECT lower(n_name), -1 FROM nation WHERE n_regionkey = 0")
def user_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.mapped(table(spark, sf_dir, "nation"), _two, "name string, n long")


@query("""
SELECT key, chunk, list_sort(list(value)) AS values FROM (
  SELECT l_suppkey AS key, l_orderkey AS value, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1) // 50 AS chunk FROM lineitem) GROUP BY key, chunk
""")
def identity_reducer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("value"))
    return grouping.bounded_groups(pairs, 50).drop("partial")


@query("""
SELECT key, chunk, list_sort(list(value)) AS values, chunk < max(chunk) OVER (PARTITION BY key) AS partial FROM (
  SELECT c_nationkey AS key, c_custkey AS value, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 25 AS chunk FROM customer) GROUP BY key, chunk
""")
def bounded_groups_partial_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.bounded_groups(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("value")), 25)


@query("""
WITH RECURSIVE v AS (SELECT p_brand AS key, p_name AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS n FROM part),
r AS (
  SELECT key, value, n, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS size FROM v WHERE n = 1
  UNION ALL
  SELECT v.key, v.value, v.n, CASE WHEN r.size >= 1000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size >= 1000 THEN 0 ELSE r.size + strlen(v.value) END
  FROM r JOIN v ON v.key = r.key AND v.n = r.n + 1)
SELECT key, chunk, list(value ORDER BY n) AS values, chunk < max(chunk) OVER (PARTITION BY key) AS partial FROM r GROUP BY key, chunk
""")
def size_bounded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return grouping.size_bounded_groups(pairs, 1000)


@query("SELECT event_type AS key, list_sort(list(DISTINCT user_id)) AS users FROM events GROUP BY ALL")
def collect_set_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.sort_array(F.collect_set("user_id")).alias("users"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def handler_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


# --- scans


@query("SELECT o_orderkey FROM orders")
def keys_only_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "orders"), scan.ScanSpec("o_orderkey", keys_only=True))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def equality_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "orders"), scan.ScanSpec("o_orderkey", [("o_orderstatus", "=", "F")], equality_only=True))


@query("SELECT * FROM orders WHERE o_totalprice >= 1000.0 AND o_totalprice < 50000.0")
def range_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "orders"), scan.ScanSpec("o_orderkey", [("o_totalprice", ">=", 1000.0), ("o_totalprice", "<", 50000.0)]))


@query("SELECT min(p_size) AS low, max(p_size) AS high FROM part WHERE p_size >= 20")
def open_range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.completed_range(table(spark, sf_dir, "part"), "p_size", [("p_size", ">=", 20)])


@query("SELECT * FROM part WHERE p_size > 20")
def open_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "part"), scan.ScanSpec("p_partkey", [("p_size", ">", 20)]))


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity >= 10 AND l_quantity <= 30")
def multi_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [("l_returnflag", "=", "R"), ("l_linenumber", "=", 1), ("l_quantity", ">=", 10.0), ("l_quantity", "<=", 30.0)]
    return scan.scan(table(spark, sf_dir, "lineitem"), scan.ScanSpec("l_orderkey", filters))


@query("SELECT DISTINCT c_mktsegment AS namespace FROM customer")
def namespace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.namespaces(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def namespace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "customer"), scan.ScanSpec("c_custkey", namespace="BUILDING", namespace_column="c_mktsegment"))


@query("SELECT c_mktsegment AS namespace, count(*) AS n FROM customer GROUP BY ALL")
def namespace_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("namespace")).agg(F.count("*").alias("n"))


_FROM, _TO = datetime(2024, 1, 5), datetime(2024, 1, 20)


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def log_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.log_range(table(spark, sf_dir, "events"), "ts", _FROM, _TO).select("event_id", "ts", "user_id")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('error', 'signup')")
def log_level_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.log_range(table(spark, sf_dir, "events"), "ts", _FROM, _TO, {"event_type": ["error", "signup"]}).select("event_id", "event_type")


_S, _E = 1704412800000000, 1705708800000000


@query(f"SELECT least(7, (epoch_us(ts) - {_S}) // ({_E - _S} // 8)) AS shard, count(*) AS n FROM events WHERE epoch_us(ts) >= {_S} AND epoch_us(ts) < {_E} GROUP BY ALL")
def log_time_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.log_range(table(spark, sf_dir, "events"), "ts", _FROM, _TO)
    return rows.groupBy(splits.time_shard(micros("ts"), _S, _E, 8).alias("shard")).agg(F.count("*").alias("n"))


# --- range splits


def _per_shard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size < 14 THEN 0 WHEN p_size < 26 THEN 1 WHEN p_size < 39 THEN 2 ELSE 3 END AS shard, count(*) AS n FROM part WHERE p_size BETWEEN 1 AND 50 GROUP BY ALL")
def property_range_int_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_shard(scan.range_sharded(table(spark, sf_dir, "part"), [("p_size", ">=", 1), ("p_size", "<=", 50)], 4))


@query("SELECT CASE WHEN c_acctbal < 2500 THEN 0 WHEN c_acctbal < 5000 THEN 1 WHEN c_acctbal < 7500 THEN 2 ELSE 3 END AS shard, count(*) AS n FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 10000 GROUP BY ALL")
def property_range_float_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_shard(scan.range_sharded(table(spark, sf_dir, "customer"), [("c_acctbal", ">=", 0.0), ("c_acctbal", "<=", 10000.0)], 4))


@query("SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS shard, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def property_range_datetime_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_shard(scan.range_sharded(table(spark, sf_dir, "events"), [("ts", ">=", _FROM), ("ts", "<", _TO)], 3))


@query("SELECT CASE WHEN p_name < 'i' THEN 0 ELSE 1 END AS shard, count(*) AS n FROM part WHERE p_name >= 'a' AND p_name < 'q' GROUP BY ALL")
def property_range_string_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_shard(scan.range_sharded(table(spark, sf_dir, "part"), [("p_name", ">=", "a"), ("p_name", "<", "q")], 2))


@query("SELECT ((p_size - 1) // 5) % 3 AS shard, count(*) AS n FROM part WHERE p_size >= 1 AND p_size < 46 GROUP BY ALL")
def oversplit_chained_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_shard(scan.range_sharded(table(spark, sf_dir, "part"), [("p_size", ">=", 1), ("p_size", "<", 46)], 3, oversplit=3))


# --- generated and combined inputs


@query("SELECT v AS value, CASE WHEN v < -3 THEN 0 WHEN v < 3 THEN 1 ELSE 2 END AS shard FROM range(-10, 10) t(v)")
def consecutive_longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.consecutive_longs(spark, -10, 10, 3)


@query("SELECT * FROM (VALUES (1, 'a', 0), (2, 'b', 0), (3, 'c', 2)) t(id, name, shard)")
def in_memory_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.in_memory(spark, [[(1, "a"), (2, "b")], [], [(3, "c")]], "id int, name string")


@query("SELECT 1 AS value WHERE false")
def no_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.no_input(spark, "value int")


@query()
def random_longs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_longs(spark, 100, 3)


@query()
def random_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_strings(spark, 103, 10, 4)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def concat_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return scan.concatenated(nation, region, region)


@query("SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def reduce_side_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("nation"))
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))
    return left.join(right, "key").select("nation", "region")


# --- order, shards, segments


@query("SELECT o_orderkey % 8 AS shard, o_orderkey AS key, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sort_within_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.places(table(spark, sf_dir, "orders"), F.col("o_orderkey") % 8, F.col("o_totalprice"), F.col("o_orderkey")).select("shard", F.col("o_orderkey").alias("key"), "place")


@query("SELECT x AS value, row_number() OVER (ORDER BY x) AS place FROM (SELECT DISTINCT o_orderkey - 5000 AS x FROM orders)")
def binary_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 5000).alias("value")).distinct()
    return ordering.ranked(x, text.ordered_long(F.col("value"))).select("value", "place")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, CAST(sum(fell) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (
  SELECT *, CASE WHEN lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) > l_quantity THEN 1 ELSE 0 END AS fell FROM lineitem)
""")
def order_break_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return ordering.order_breaks(rows, "l_suppkey", "o", "l_quantity").select("l_suppkey", "l_orderkey", "l_linenumber", "segment")


@query("SELECT c_nationkey, c_custkey, CAST(sum(CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM customer")
def item_segmented_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.flagged_segments(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", F.col("c_custkey") % 10 == 0).select("c_nationkey", "c_custkey", "segment")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.largest(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), 5, F.col("o_orderkey"))


@query("""
WITH RECURSIVE v AS (SELECT source, doc_id, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (
  SELECT source, doc_id, bytes, n, coalesce(bytes, 0) AS total, CAST(0 AS BIGINT) AS segment FROM v WHERE n = 1
  UNION ALL
  SELECT v.source, v.doc_id, v.bytes, v.n, CASE WHEN r.total + coalesce(v.bytes, 0) > 20000 THEN coalesce(v.bytes, 0) ELSE r.total + coalesce(v.bytes, 0) END,
    CASE WHEN r.total + coalesce(v.bytes, 0) > 20000 THEN r.segment + 1 ELSE r.segment END
  FROM r JOIN v ON v.source IS NOT DISTINCT FROM r.source AND v.n = r.n + 1)
SELECT source, doc_id, bytes, segment FROM r
""")
def size_segmented_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("bytes"))
    return sinks.segments_by_size(rows, "source", "doc_id", F.col("bytes"), 20_000)


@query("SELECT o_orderkey % 5 AS shard, count(*) AS n FROM orders GROUP BY ALL")
def sharded_output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_shard(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("shard")))


def _murmur_sql() -> str:
    """Murmur 3 of keys of fewer than eight characters, step by step."""
    mul = lambda x, by: f"CAST(CAST({x} AS HUGEINT) * {by} % 4294967296 AS BIGINT)"
    turned = lambda x, by: f"({mul(x, 1 << by)} + ({x} >> {32 - by}))"
    word = lambda at: " + ".join(f"CASE WHEN n > {at + i} THEN CAST(ascii(s[{at + i + 1}]) AS BIGINT) * {256**i} ELSE 0 END" for i in range(4))
    return f"""
WITH k AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, length(CAST(o_orderkey AS VARCHAR)) AS n FROM orders),
w AS (SELECT o_orderkey, n, {word(0)} AS w1, {word(4)} AS w2 FROM k),
m AS (SELECT *, {mul("w1", 0xCC9E2D51)} AS a1, {mul("w2", 0xCC9E2D51)} AS a2 FROM w),
t AS (SELECT *, {turned("a1", 15)} AS b1, {turned("a2", 15)} AS b2 FROM m),
x AS (SELECT *, {mul("b1", 0x1B873593)} AS k1, {mul("b2", 0x1B873593)} AS k2 FROM t),
h AS (SELECT *, CASE WHEN n < 4 THEN k1 ELSE ({mul(turned("k1", 13), 5)} + {0xE6546B64}) % 4294967296 END AS h1 FROM x),
f AS (SELECT *, xor(CASE WHEN n > 4 THEN xor(h1, k2) ELSE h1 END, n) AS f0 FROM h),
f1 AS (SELECT *, {mul("xor(f0, f0 >> 16)", 0x85EBCA6B)} AS g FROM f),
f2 AS (SELECT *, {mul("xor(g, g >> 13)", 0xC2B2AE35)} AS g2 FROM f1)
SELECT o_orderkey, CAST((xor(g2, g2 >> 16) & 2147483647) // {0x7FFFFFFF // 10 + 1} AS INTEGER) AS shard FROM f2"""


@query(_murmur_sql())
def hash_sharder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.hash_shard(F.col("o_orderkey").cast("string"), 10).alias("shard"))


@query("SELECT n_name, CAST((row_number() OVER (ORDER BY n_name) - 1) % 4 AS INTEGER) AS shard FROM nation")
def file_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.round_robin(table(spark, sf_dir, "nation").select("n_name"), "n_name", 4)


@query("SELECT p_type AS phrase, p_brand AS brand, count(*) AS n FROM part GROUP BY ALL")
def two_level_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("phrase"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


# --- text and file records


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))


@query("""
WITH l AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages), n AS (SELECT page_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS of FROM l)
SELECT page_id, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, line FROM n QUALIFY i + 1 < of OR line <> ''
""")
def text_line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.line_offsets(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT printf('%s: %d', event_type, count(*)) AS value FROM events GROUP BY event_type")
def string_output_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.formatted(counts, "%s: %d", "event_type", "n")


@query("SELECT n_nationkey, printf('part-%04d', n_nationkey) AS file FROM nation")
def shard_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.shard_file_name("part-%04d", F.col("n_nationkey")).alias("file"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS seconds FROM events")
def epoch_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.epoch_seconds(F.col("ts")).alias("seconds"))


@query("SELECT doc_id, left(text, 100) AS shown, length(text) AS n FROM documents")
def abbreviated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.abbreviated(F.col("text")).alias("shown"), F.length("text").cast("long").alias("n"))


# --- tables, changes, counters, jobs


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey")


@query("""
SELECT o_orderkey, o_orderstatus, len(lines) AS n_lines, lines[1].part AS first_part, CAST(list_sum(list_transform(lines, lambda x: x.quantity)) AS DOUBLE) AS quantity FROM (
  SELECT o_orderkey, o_orderstatus, list_sort(list({'no': l_linenumber, 'part': l_partkey, 'quantity': l_quantity})) AS lines
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
""")
def table_json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _orders_with_lines(spark, sf_dir)
    back = schema.json_rows(nested).select(F.from_json("value", nested.schema).alias("r")).select("r.*")
    total = F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["quantity"])
    return back.select("o_orderkey", "o_orderstatus", F.size("lines").cast("long").alias("n_lines"), F.col("lines")[0]["part"].alias("first_part"), total.alias("quantity"))


@query("SELECT * FROM (VALUES ('o_orderkey', 'integer', NULL), ('o_orderstatus', 'string', NULL), ('lines', 'record', 'repeated')) t(name, type, mode)")
def table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema.table_schema(_orders_with_lines(spark, sf_dir).schema)
    return spark.createDataFrame([(c["name"], c["type"], c.get("mode")) for c in found], "name string, type string, mode string")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'new', 1.5")
def upsert_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    marked = rows.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0))
    new = spark.createDataFrame([(-1, "new", 1.5)], rows.schema)
    return sinks.upserted(rows, marked.unionByName(new), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.deleted(table(spark, sf_dir, "customer").select("c_custkey"), keys, "c_custkey")


@query("""
SELECT 'rows' AS name, count(*) AS value FROM orders UNION ALL SELECT 'finished', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'keys', CAST(sum(o_orderkey) AS BIGINT) FROM orders
""")
def counters_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.summary(table(spark, sf_dir, "orders"), finished=(F.col("o_orderstatus") == "F").cast("int"), keys=F.col("o_orderkey"))


@query("SELECT c, count(*) AS n FROM (SELECT unnest(string_split(p, '')) AS c FROM (SELECT repeat('ab', CAST(v % 5 AS INTEGER)) AS p FROM range(0, 1000) t(v) WHERE v % 3 <> 0)) WHERE c <> '' GROUP BY c")
def chained_create_count_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generators.consecutive_longs(spark, 0, 1000, 8).select("value", F.expr("repeat('ab', cast(value % 5 as int))").alias("payload"))
    kept = sinks.deleted(made, made.where("value % 3 = 0"), "value")
    return kept.select(F.explode(text.characters(F.col("payload"))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS key, list_sort(list(c_custkey)) AS values FROM customer GROUP BY ALL")
def regrouped_partial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("value"))
    return exchange.regrouped(grouping.bounded_groups(pairs, 7))


@query("""
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 4
UNION ALL SELECT c_custkey, 'put', 0.0 FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 5 <> 4
""")
def mutation_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    open_ = rows.where("c_custkey % 3 > 0 and c_custkey % 5 <> 4")
    first = open_.withColumns({"op": F.lit(exchange.PUT), "at": F.lit(1), "c_name": F.lit("put"), "c_acctbal": F.lit(0.0)})
    then = open_.where("c_custkey % 3 = 2").withColumns({"op": F.lit(exchange.DELETE), "at": F.lit(2)})
    return exchange.applied(rows, first.unionByName(then), "c_custkey", "at")


@query("SELECT c_nationkey, c_custkey, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), -1) AS next_c_custkey FROM customer")
def peeking_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return exchange.with_neighbour(rows, "c_nationkey", "c_custkey", "c_custkey").fillna(-1)


# --- nulls, folds and outputs of users' code


def _nullable_key() -> Column:
    return F.when(F.col("l_orderkey") % 4 != 0, F.col("l_orderkey") % 4 + 9007199254740992)


_NULLABLE_SQL = "CASE WHEN l_orderkey % 4 <> 0 THEN l_orderkey % 4 + 9007199254740992 END"


def _count_up(key, values, so_far):  # noqa: ANN001, ANN202
    yield len(values) + sum(so_far)


@query(f"SELECT {_NULLABLE_SQL} AS key, count(*) AS value FROM lineitem GROUP BY ALL")
def user_combiner_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(_nullable_key().alias("key"), F.lit(1).cast("long").alias("value"))
    return grouping.combined(pairs, _count_up)


@query(f"SELECT {_NULLABLE_SQL} AS key, min(l_partkey) AS low, max(l_partkey) AS high, count(*) AS n FROM lineitem GROUP BY ALL")
def user_reducer_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(_nullable_key().alias("key"), F.col("l_partkey").alias("value"))
    return grouping.reduced(pairs, _span, "key long, low long, high long, n long")


def _same(row):  # noqa: ANN001, ANN202
    yield row["k"], row["n"]


@query(f"SELECT {_NULLABLE_SQL} AS k, l_linenumber AS n FROM lineitem")
def user_mapper_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(_nullable_key().alias("k"), F.col("l_linenumber").alias("n"))
    return mapping.mapped(rows, _same, f"k long, n {rows.schema['n'].dataType.simpleString()}")


def _by_region(row):  # noqa: ANN001, ANN202
    yield "all", row["n_nationkey"], row["n_name"]
    if row["n_regionkey"] == 1:
        yield "first", row["n_name"]


@query("SELECT 'all' AS output, n_name AS name FROM nation UNION ALL SELECT 'first', n_name FROM nation WHERE n_regionkey = 1")
def side_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = mapping.mapped_to(table(spark, sf_dir, "nation"), _by_region, {"all": "key long, name string", "first": "name string"})
    path = files.work_folder(spark, "outputs")
    both.write.partitionBy("output").parquet(path)  # the mapper runs once for both
    back = spark.read.schema(both.schema).parquet(path)
    rows = [mapping.output_of(back, n).select(F.lit(n).alias("output"), "name") for n in ("all", "first")]
    return rows[0].unionByName(rows[1])


@query("SELECT CAST(o_custkey % 7 AS INTEGER) AS shard, o_custkey AS key FROM orders")
def custom_sharder(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return ordering.hash_sharded(pairs, 7, sharder=lambda k, n: k % n)


class _Reversed(codec.Marshaller):
    def encode(self, value: str) -> bytes:
        return value[::-1].encode()

    def decode(self, data: bytes) -> str:
        return data.decode()[::-1]


@query("SELECT p_partkey, p_name FROM part")
def marshalled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", codec.marshalled(F.col("p_name"), _Reversed()).alias("b"))
    return rows.select("p_partkey", codec.unmarshalled(F.col("b"), _Reversed(), "string").alias("p_name"))


@query("SELECT replace(phrase, ':', ' ') AS phrase, n FROM (SELECT p_brand || ':' || p_type AS phrase, count(*) AS n FROM part GROUP BY 1)")
def phrases_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.concat_ws(":", "p_brand", "p_type").alias("phrase")).agg(F.count("*").alias("n"))
    return counts.select(text.spaced(F.col("phrase")).alias("phrase"), "n")


# --- scans and readers beyond tables


@query("SELECT * FROM part")
def binary_row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return scan.of_messages(scan.as_messages(rows, "p_partkey"), rows.schema)


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey >= 500 AND o_orderkey < 900 THEN 1 ELSE 2 END AS range FROM orders WHERE o_orderkey < 100 OR (o_orderkey >= 500 AND o_orderkey < 900) OR o_orderkey >= 3000")
def key_range_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.in_ranges(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [(None, 100), (500, 900), (3000, None)])


@query("""
SELECT event_id FROM (SELECT *, CASE user_id % 5 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'error' ELSE 'critical' END AS level FROM events)
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND level IN ('warning', 'error', 'critical') AND event_id % 3 > 0 AND event_id % 2 = 1
""")
def log_least_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.element_at(F.array(*[F.lit(x) for x in scan.LEVELS]), (F.col("user_id") % 5 + 1).cast("int"))
    version = F.when(F.col("event_id") % 2 == 1, "v1").otherwise("v2")
    logs = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("time"), levels.alias("level"), (F.col("event_id") % 3 > 0).alias("finished"), version.alias("version"), F.lit("default").alias("module"))
    return scan.log_scan(logs, _FROM, _TO, "warning", versions=["v1"]).select("event_id")


class Squares(contract.InputReader):
    """Numbers of a range and their squares, as an example of a user's reader."""

    schema = "n long, square long"

    def __init__(self, at: int, end: int) -> None:
        self.at, self.end = at, end

    @classmethod
    def validate(cls, params: dict) -> None:
        if not params["start"] <= params["end"]:
            raise contract.BadReader("start must be at most end")

    @classmethod
    def split(cls, params: dict, shards: int) -> list[contract.InputReader]:
        points = splits.split_ints(params["start"], params["end"], shards) if params["start"] < params["end"] else []
        return [cls(a, b) for a, b in zip(points, points[1:], strict=False)]

    def __iter__(self) -> Iterator[tuple]:
        while self.at < self.end:
            self.at += 1
            yield self.at - 1, (self.at - 1) ** 2

    def state(self) -> dict:
        return {"at": self.at, "end": self.end}

    @classmethod
    def resumed(cls, state: dict) -> contract.InputReader:
        return cls(state["at"], state["end"])


@query("SELECT n, n * n AS square FROM range(-50, 1000) t(n)")
def user_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.read(spark, Squares, {"start": -50, "end": 1000}, 6)


class Lines(contract.OutputWriter):
    """A text file a shard, named by the shard; only the attempt that finished last is renamed into the output."""

    def begin(self, params: dict, shard: int, attempt: int) -> None:
        self.system, folder = files.opened(params["folder"])
        self.system.create_dir(folder, recursive=True)
        self.final = f"{folder}/part-{shard:05d}.txt"
        self.staged = f"{folder}/.part-{shard:05d}-{attempt}"
        self.out = self.system.open_output_stream(self.staged)

    def write(self, row: tuple) -> None:
        self.out.write((row[0] + "\n").encode())

    def finish(self) -> list[str]:
        self.out.close()
        return [self.staged, self.final]

    @classmethod
    def commit(cls, params: dict, written: list) -> None:
        system, _ = files.opened(params["folder"])
        for staged, final in written:
            system.move(staged, final)

    @classmethod
    def abort(cls, params: dict, written: list) -> None:
        system, _ = files.opened(params["folder"])
        for staged, _ in written:
            system.delete_file(staged)


@query("SELECT c_name AS record FROM customer")
def user_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.work_folder(spark, "lines")
    contract.write(table(spark, sf_dir, "customer").select("c_name").repartition(4), Lines, {"folder": folder})
    return files.records(spark, f"{folder}/part-*.txt")


# --- files written and read back


@query("SELECT o_orderkey || '|' || o_orderstatus AS line FROM orders")
def file_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.work_folder(spark, "text")
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("value"))
    return files.lines_at(spark, sinks.write_text(lines, folder), 8, 4096).select("line")


@query("SELECT n_name AS record FROM nation UNION ALL SELECT n_name FROM nation")
def file_records_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.work_folder(spark, "records")
    paths = sinks.write_text(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).repartition(3), folder, "\x1e")
    return files.records(spark, paths + paths, "\x1e")


@query("SELECT shard, count(*) AS n FROM (SELECT o_orderkey % 5 AS shard FROM orders) WHERE shard IN (1, 3) GROUP BY shard")
def sharded_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.work_folder(spark, "shards")
    sinks.write_sharded(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 5, 5, folder)
    return _per_shard(spark.read.parquet(folder).where("shard in (1, 3)").select(F.col("shard").cast("long").alias("shard")))


@query("SELECT r_regionkey AS key, length(r_name) AS size FROM region WHERE r_regionkey % 2 = 0")
def whole_files_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.work_folder(spark, "whole")
    rows = table(spark, sf_dir, "region").select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("key"))
    rows.repartitionById(5, F.col("key").cast("int")).write.partitionBy("key").option("lineSep", "\x1f").text(folder)
    key = F.regexp_extract("path", r"key=(\d+)/", 1).cast("long")
    found = files.files(spark, [folder], keep=F.endswith("path", F.lit(".txt")) & (key % 2 == 0), shallow=False)
    return found.select(key.alias("key"), (F.octet_length("content") - 1).cast("long").alias("size"))  # without the separator


@query("SELECT p_partkey, p_name FROM part")
def record_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordlog.register(spark)
    folder = files.work_folder(spark, "log")
    pairs = table(spark, sf_dir, "part").select(codec.pair_column(F.col("p_partkey").cast("string"), F.col("p_name")).alias("record"))
    pairs.repartition(3).write.format("recordlog").mode("append").save(folder)
    back = spark.read.format("recordlog").option("blocks", 1).load(folder).select(codec.pair_columns(F.col("record")).alias("p"))
    return back.select(F.col("p.key").cast("string").cast("long").alias("p_partkey"), F.col("p.value").cast("string").alias("p_name"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, list_sort(list(CAST(o_orderkey AS VARCHAR))) AS values FROM orders GROUP BY ALL")
def shuffled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordlog.register(spark)
    into, out = files.work_folder(spark, "pairs"), files.work_folder(spark, "groups")
    pairs = table(spark, sf_dir, "orders").select(codec.pair_column(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("record"))
    pairs.write.format("recordlog").mode("append").save(into)
    exchange.shuffle_files(spark, [into], out, 4, 5)
    groups = spark.read.format("recordlog").load(out).select(codec.group_columns(F.col("record")).alias("g")).select("g.*")
    joined = groups.groupBy(F.col("key").cast("string").alias("key")).agg(F.array_sort(F.flatten(F.collect_list(F.transform("values", lambda v: v.cast("string"))))).alias("values"))
    return joined


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for name in r["names"]:
                    z.writestr(f"{name}.txt", f"{name}\n{len(name)}\n")
            yield pa.RecordBatch.from_pydict({"path": [str(r["region"])], "content": [held.getvalue()]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))


_NAMES_SQL = "SELECT CAST(n_regionkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS file_index, n_name FROM nation"


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.mapInArrow(_zipped, "path string, content binary")


@query(f"SELECT path, CAST(file_index AS INTEGER) AS file_index, n_name || '.txt' AS filename, CAST(strlen(n_name) + 2 + length(CAST(strlen(n_name) AS VARCHAR)) AS BIGINT) AS file_size FROM ({_NAMES_SQL})")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unzipped(_archives(spark, sf_dir)).drop("content")


@query(f"""
SELECT path, CAST(file_index AS INTEGER) AS file_index, CAST(0 AS BIGINT) AS byte_offset, n_name AS line FROM ({_NAMES_SQL})
UNION ALL SELECT path, CAST(file_index AS INTEGER), CAST(strlen(n_name) + 1 AS BIGINT), CAST(strlen(n_name) AS VARCHAR) FROM ({_NAMES_SQL})
""")
def zip_member_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.zip_lines(_archives(spark, sf_dir))


@query("SELECT n_name AS name, n_regionkey || ':' || left(n_name, CAST(n_regionkey AS INTEGER)) AS content FROM nation")
def stitched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    first = rows.select(F.col("n_name").alias("name"), F.lit(0).alias("seq"), F.lit(2).alias("valid_length"), F.concat("n_regionkey", F.lit(":lost")).cast("binary").alias("content"))
    second = rows.select(F.col("n_name").alias("name"), F.lit(1).alias("seq"), F.col("n_regionkey").cast("int").alias("valid_length"), F.col("n_name").cast("binary").alias("content"))
    return files.stitched(second.unionByName(first)).select("name", F.col("content").cast("string").alias("content"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_table_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.work_folder(spark, "json")
    of = sinks.write_json(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), folder)
    return sinks.load_json(spark, folder, of)


# --- slices


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY ALL")
def sliced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    into, out = files.work_folder(spark, "slices"), files.work_folder(spark, "counts")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows.repartition(3, "event_id").write.parquet(into)
    each = lambda df, n: df.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/slice={n}")
    slices.run_available(slices.sliced(spark, into, rows.schema), each, files.work_folder(spark, "checkpoint"))
    return spark.read.parquet(out).groupBy(F.col("event_type").alias("key")).agg(F.sum("n").alias("value"))


@query("SELECT event_type AS key, count(*) AS value FROM events GROUP BY ALL")
def sliced_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    into, out = files.work_folder(spark, "slices"), files.work_folder(spark, "folds")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows.repartition(3, "event_id").write.parquet(into)
    stream = slices.sliced(spark, into, rows.schema).select(F.col("event_type").alias("key"), F.col("event_id").alias("value"))
    each = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/slice={n}")
    slices.running_fold(stream, _count_up, "bigint", files.work_folder(spark, "checkpoint"), each)
    return spark.read.parquet(out).groupBy("key").agg(F.max_by("value", "slice").alias("value"))
