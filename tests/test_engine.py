"""Splits, filters, files, record logs, schemas, folds, jobs: by literal expectations."""

import dataclasses
import enum
import io
import os
import zipfile
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import codec, hashing, text
from weftline.operators import counters, exchange, grouping, mapping, ordering, schema, sinks, splits
from weftline.plans import jobs, spec
from weftline.sources import files, generators, recordlog, scan
from weftline.streaming import slices


def test_integer_splits():
    assert splits.split_ints(1, 100, 3, True, True) == [1, 34, 68, 101]
    assert splits.split_ints(1, 11, 10, True, True) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]
    assert splits.split_ints(1, 1, 20, True, True) == [1, 2]
    with pytest.raises(ValueError):
        splits.split_ints(1, 1, 3)


@given(st.integers(-1000, 1000), st.integers(1, 2000), st.integers(1, 50))
def test_integer_splits_cover(start, length, n):
    points = splits.split_ints(start, start + length, n)
    assert points[0] == start and points[-1] == start + length and len(points) <= n + 1 and points == sorted(set(points))


def test_other_splits():
    assert splits.split_floats(1, 4, 4) == [1.75, 2.5, 3.25]
    day = datetime(2024, 1, 1)
    assert splits.split_datetimes(day, day + timedelta(days=3), 3) == [day + timedelta(days=i) for i in range(4)]
    assert splits.split_strings("aaa", "ab", 4)[0] == "aaa" and splits.split_strings("aaa", "ab", 4)[-1] == "ab"
    with pytest.raises(ValueError):
        splits.split_strings("é", "z", 2)
    assert splits.split_list(list(range(10)), 3) == [[0, 1, 2, 3], [4, 5, 6], [7, 8, 9]]
    assert sorted(sum(splits.split_list(list(range(10)), 4, seed=0), [])) == list(range(10))
    assert splits.split_list([1], 3) == [[1]]
    assert splits.chained(9, 3) == [[0, 3, 6], [1, 4, 7], [2, 5, 8]]
    assert splits.byte_ranges(10, 3) == [(0, 3), (3, 6), (6, 10)] and splits.byte_ranges(10, 8, 5) == [(0, 5), (5, 10)]
    assert splits.size_balanced([5, 5, 1, 9, 3], 3) == [[0, 1], [2, 3], [4]]
    names = splits.split_namespaces("a", "c", 3)
    assert names[0][0] == "a" and names[-1][1] == "c" and all(x[1] < y[0] for x, y in zip(names, names[1:]))


@given(st.text(alphabet=[chr(i) for i in range(128)], max_size=4))
def test_string_ordinals(s):
    w = splits._weights()
    assert splits.string_at(splits.ordinal_of(s, w), w) == s


def test_filters(spark):
    df = spark.createDataFrame([(i, i % 3, float(i), "abc"[i % 3]) for i in range(20)], "id long, a int, x double, s string")
    for bad in ([("zz", "=", 1)], [("a", "!=", 1)], [("a", "=", "one")], [("s", "=", 1)], [("a",)]):
        with pytest.raises(scan.BadScanParams):
            scan.check_filters(df.schema, bad)
    with pytest.raises(scan.BadScanParams):
        scan.scan(df, scan.ScanSpec("id", [("a", "<", 1)], equality_only=True))
    with pytest.raises(scan.BadScanParams):
        scan.ScanSpec.of({"key": "id", "colour": 1})
    for bad in ([("a", "<", 1)], [("a", ">", 1), ("id", "<", 3)], [("a", ">", 3), ("a", "<", 1)], [("a", ">", 1), ("a", ">=", 0), ("a", "<", 5)]):
        with pytest.raises(scan.BadScanParams):
            scan.PropertyRange.from_filters(df.schema, bad)
    assert scan.PropertyRange.from_filters(df.schema, [("a", "=", 1)]) is None
    found = scan.PropertyRange.from_filters(df.schema, [("id", ">=", 1), ("id", "<=", 4), ("a", "=", 1)])
    assert found.split(10) == [[("id", ">=", i), ("id", "<", i + 1), ("a", "=", 1)] for i in range(1, 5)]
    floats = scan.PropertyRange.from_filters(df.schema, [("x", ">=", 1.0), ("x", "<=", 4.0)]).split(4)
    assert floats[0] == [("x", ">=", 1.0), ("x", "<", 1.75)] and floats[-1] == [("x", ">=", 3.25), ("x", "<=", 4.0)]
    plan = scan.scan(df, scan.ScanSpec("id", [("a", "=", 1)], keys_only=True))
    assert plan.columns == ["id"] and plan.count() == 7
    assert len(scan.scatter_points(df, "id", 4)) == 3


def test_pushdown(spark, tmp_path):
    spark.range(100).withColumn("b", F.lit("x")).write.parquet(f"{tmp_path}/t")
    df = scan.scan(spark.read.parquet(f"{tmp_path}/t"), scan.ScanSpec("id", [("id", ">=", 90)], keys_only=True))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,90)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_hashes(spark):
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert hashing.murmur3_32(b"") == 0 and hashing.murmur3_32(b"hello") == 0x248BFA47
    assert all(hashing.unmasked(hashing.masked(x)) == x for x in (0, 1, 0xDEADBEEF))
    row = spark.createDataFrame([("hello",), (None,)], "k string").select(hashing.hash_shard(F.col("k"), 10).alias("s"), hashing.crc32c_column(F.col("k")).alias("c")).collect()
    assert row[0].s == 0x248BFA47 // (0x7FFFFFFF // 10 + 1) and row[1].s is None and row[0].c == hashing.crc32c(b"hello") and row[1].c is None


@given(st.lists(st.binary(max_size=200), max_size=20))
@settings(max_examples=50)
def test_record_log_round_trip(records):
    assert list(recordlog.decode(b"".join(recordlog.encode(records)))) == records


def test_record_log_blocks_and_damage():
    records = [b"a" * n for n in (recordlog.BLOCK - 7, 1, recordlog.BLOCK * 2, recordlog.BLOCK - 20, 5)] + [b"", b"end"]
    data = bytearray(b"".join(recordlog.encode(records)))
    assert list(recordlog.decode(bytes(data))) == records
    data[100] ^= 1
    with pytest.raises(recordlog.CorruptRecords):
        list(recordlog.decode(bytes(data)))
    assert list(recordlog.decode(bytes(data), permissive=True)) == records[1:]


def test_record_log_source(spark, tmp_path):
    recordlog.register(spark)
    rows = spark.createDataFrame([(bytes([i]) * i * 100,) for i in range(50)], "record binary")
    rows.repartition(3).write.format("recordlog").mode("append").save(f"{tmp_path}/log")
    back = spark.read.format("recordlog").load(f"{tmp_path}/log")
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes([i]) * i * 100 for i in range(50))
    rows.limit(1).write.format("recordlog").mode("overwrite").save(f"{tmp_path}/log")
    assert spark.read.format("recordlog").load(f"{tmp_path}/log").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a|b||c|")
    assert [r.record for r in files.records(spark, f"{tmp_path}/a.txt", "|").collect()] == ["a", "b", "", "c"]
    assert files.files(spark, [f"file://{tmp_path}/*.txt", f"file://{tmp_path}/a.txt", f"file://{tmp_path}/none"]).count() == 2
    with pytest.raises(FileNotFoundError):
        files.files(spark, [f"file://{tmp_path}/none"], strict=True)
    assert files.files(spark, [f"file://{tmp_path}/*"], keep=F.endswith("path", F.lit(".zip"))).count() == 0
    lines = spark.createDataFrame([(1, "é\nb\n"), (2, ""), (3, "x")], "k int, t string")
    assert sorted(map(tuple, files.line_offsets(lines, "k", "t").collect())) == [(1, 0, "é"), (1, 3, "b"), (3, 0, "x")]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for i in range(5):
            z.writestr(f"{i}.txt", f"{i}: {'*' * i}\nnext")
    archives = spark.createDataFrame([("z", held.getvalue())], "path string, content binary")
    assert [(r.filename, r.file_size) for r in files.unzipped(archives).collect()] == [(f"{i}.txt", 8 + i) for i in range(5)]
    assert files.zip_lines(archives).where("file_index = 2").select("byte_offset", "line").collect() == [(0, "2: **"), (6, "next")]
    parts = spark.createDataFrame([("f", 1, 2, b"cdXX"), ("f", 0, 2, b"ab"), ("f", 2, 0, b"zz")], "name string, seq int, valid_length long, content binary")
    assert bytes(files.stitched(parts).first().content) == b"abcd"


def test_generators(spark):
    rows = generators.consecutive_longs(spark, -10000, 10000, 10).groupBy("shard").count().collect()
    assert sorted(map(tuple, rows)) == [(i, 2000) for i in range(10)]
    assert generators.consecutive_longs(spark, 0, 0, 3).count() == 0
    longs = generators.random_longs(spark, 100, 3, 7)
    assert sorted(map(tuple, longs.groupBy("shard").count().collect())) == [(0, 34), (1, 33), (2, 33)]
    assert longs.collect() == generators.random_longs(spark, 100, 3, 7).collect() and longs.distinct().count() == 100
    strings = generators.random_strings(spark, 103, 10, 4).collect()
    assert all(len(r.value) == 10 and r.value.islower() for r in strings) and {r.shard for r in strings} == {0, 1, 2, 3, 4}


def test_groups(spark):
    pairs = spark.createDataFrame([("1", "a")] * 5 + [("2", "b")], "key string, value string")
    got = {(r.key, r.chunk): (r["values"], r.partial) for r in grouping.bounded_groups(pairs, 2).collect()}
    assert got == {("1", 0): (["a"] * 2, True), ("1", 1): (["a"] * 2, True), ("1", 2): (["a"], False), ("2", 0): (["b"], False)}
    sized = spark.createDataFrame([("k", x) for x in ("aa", "bb", "cc", "dd", "ee")], "key string, value string")
    got = sorted((r.chunk, list(r["values"]), r.partial) for r in grouping.size_bounded_groups(sized, 4).collect())
    assert got == [(0, ["aa", "bb", "cc"], True), (1, ["dd", "ee"], False)]
    with pytest.raises(Exception, match="takes none"):
        grouping.nothing(pairs).collect()
    assert grouping.nothing(pairs.limit(0)).collect() == []
    fold = grouping.folded(spark.range(400).select((F.col("id") % 4).alias("key"), F.col("id").alias("value")), F.lit(0).cast("long"), lambda a, v: a + v)
    assert sorted(r.value for r in fold.collect()) == [19800, 19900, 20000, 20100]
    hot = spark.range(50_000).select(F.lit("1").alias("key"), F.lit(" " * 100).alias("value"))
    # a combiner gets what was combined so far; one that looks at the values instead would count tasks
    assert grouping.combined(hot, lambda k, v, s: iter([str(len(v) + sum(map(int, s)))])).collect() == [("1", "50000")]
    for values in (F.lit(7), F.col("id") % 10, F.col("id")):
        many = spark.range(0, 1000, 1, 6).select(F.lit(None).cast("long").alias("key"), values.cast("long").alias("value"))
        assert grouping.combined(many, lambda k, v, s: iter([len(v) + sum(s)]), 30).collect() == [(None, 1000)]
    with pytest.raises(Exception, match="yields"):
        grouping.combined(pairs, lambda k, v, s: [1]).collect()
    votes = spark.createDataFrame([("p", "x")] * 6 + [("p", "y")] * 5 + [("q", "x")] * 9 + [("r", "x")] * 5 + [("r", "y")] * 5, "key string, value string")
    assert grouping.majority(votes).collect() == [("p", "x", 6)]


class Counting(mapping.Mapper):
    def begin_shard(self, context):
        self.n = 0

    def __call__(self, context, row):
        self.n += 1
        context.count("seen")
        if row["id"] % 2:
            context.emit(row["id"])

    def end_shard(self, context):
        context.emit(-self.n)


def test_mapper_life_cycle_and_counters(spark):
    sums = counters.user_counters(spark.sparkContext)
    got = [r.x for r in mapping.mapped(spark.range(0, 100, 1, 4), Counting(), "x long", sums).collect()]
    assert sorted(x for x in got if x > 0) == list(range(1, 100, 2)) and sum(-x for x in got if x <= 0) == 100
    assert sums.value == {"seen": 100}
    assert mapping.named("weftline.operators.mapping.Mapper").__class__ is mapping.Mapper
    with pytest.raises(ValueError):
        mapping.named("no.such.thing")
    assert counters.merged({"a": 1}, {"a": 2, "b": 1}) == {"a": 3, "b": 1}


def test_ordering(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 2, 1, 5, 4])], "shard int, n int, v int")
    assert [r.segment for r in ordering.order_breaks(rows, "shard", "n", "v").orderBy("n").collect()] == [0, 0, 0, 1, 1, 2]
    pairs = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    for df in (ordering.hash_sharded(pairs, 5), ordering.shuffled(pairs, 5)):
        parts = df.rdd.glom().map(lambda p: [r.key for r in p]).collect()
        assert len(parts) == 5 and all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 1000
    data = spark.createDataFrame([(v,) for v in (-(1 << 63), -5, 0, 7, (1 << 63) - 1)], "v long")
    assert [r.v for r in data.orderBy(text.ordered_long(F.col("v"))).collect()] == [-(1 << 63), -5, 0, 7, (1 << 63) - 1]
    ints = spark.createDataFrame([(v,) for v in (-(1 << 31), -5, 0, (1 << 31) - 1)], "v int")
    assert [bytes(r[0]) for r in ints.select(text.ordered_int(F.col("v"))).collect()] == [b"\0\0\0\0", b"\x7f\xff\xff\xfb", b"\x80\0\0\0", b"\xff\xff\xff\xff"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 1, 20, 3])], "shard string, i int, n int")
    assert [r.segment for r in sinks.segments_by_size(rows, "shard", "i", F.col("n"), 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    out = sinks.write_text(sinks.formatted(rows, "%s: %d", "shard", "n"), f"{tmp_path}/t", ";")
    assert len(out) >= 1 and files.records(spark, f"{tmp_path}/t", ";").count() == 5
    sinks.write_sharded(rows, F.col("i") % 2, 2, f"{tmp_path}/p")
    assert sorted(x for x in os.listdir(f"{tmp_path}/p") if "=" in x) == ["shard=0", "shard=1"]
    assert '"type": "integer"' in sinks.write_json(rows, f"{tmp_path}/j") and spark.read.json(f"{tmp_path}/j").count() == 5
    assert sinks.by_shard(rows, "shard", "i", "n") == [[5, 5, 1, 20, 3]]
    sinks.write_nothing(rows)
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    changes = spark.createDataFrame([(2, None), (3, "c")], "k int, s string")
    assert sorted(map(tuple, sinks.upserted(table, changes, "k").collect())) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    assert sinks.latest(spark.createDataFrame([(1, 1), (1, 2)], "k int, t int"), "k", "t").collect() == [(1, 2)]
    seen = spark.sparkContext.accumulator(0)
    sinks.in_batches(spark.range(0, 250, 1, 2), lambda b: seen.add(len(b)))
    assert seen.value == 250


class Colour(enum.Enum):
    RED = 1


@dataclasses.dataclass
class Child:
    name: str
    age: int


@dataclasses.dataclass
class Person:
    married: bool
    colour: Colour
    weight: float | None
    born: datetime
    worth: Decimal
    sons: list[Child]
    tags: list[str]
    shown: str = dataclasses.field(metadata={"name": "niceName", "description": "what is shown", "mode": "required"})
    secret: int = dataclasses.field(default=0, metadata={"ignore": True})


def test_schema(spark):
    assert schema.table_schema(Person) == [
        {"name": "married", "type": "boolean", "mode": "required"},
        {"name": "colour", "type": "string"},
        {"name": "weight", "type": "float"},
        {"name": "born", "type": "timestamp"},
        {"name": "worth", "type": "string"},
        {"name": "sons", "type": "record", "fields": [{"name": "name", "type": "string"}, {"name": "age", "type": "integer", "mode": "required"}], "mode": "repeated"},
        {"name": "tags", "type": "string", "mode": "repeated"},
        {"name": "niceName", "type": "string", "mode": "required", "description": "what is shown"},
    ]
    for hint in (dict[str, int], list, list[list[int]], object, int | str):
        with pytest.raises(schema.UnsupportedField):
            schema.table_schema(dataclasses.make_dataclass("Bad", [("x", hint)]))
    with pytest.raises(schema.UnsupportedField):
        schema.table_schema(T.StructType().add("m", T.MapType(T.StringType(), T.StringType())))
    df = spark.createDataFrame([(1, None, datetime(1970, 1, 17, 6, 34, 14, 209000), ["a"])], "id long, name string, at timestamp, tags array<string>")
    assert schema.json_rows(df).first().value == '{"id":1,"at":1406054.209,"tags":["a"]}'
    with pytest.raises(Exception, match="null in required"):
        schema.required(df, "name").collect()


def test_jobs(spark):
    with pytest.raises(spec.BadSpec):
        spec.JobSpec("x", lambda s: s.range(1), reducers=4096)
    with pytest.raises(spec.BadSpec):
        spec.registry([{"name": "a", "mapper": "m"}, {"name": "a", "mapper": "m"}])
    assert spec.registry([{"name": "a", "mapper": "m", "params": [{"name": "p", "default": 3}]}])["a"]["params"] == {"p": 3}
    engine, ended = jobs.Engine(spark), []
    numbers = spec.JobSpec("mod", lambda s: s.range(20_000), lambda d: d.select((F.abs("id") % 37).alias("k")), ("k",), (F.count("*").alias("n"),), reducers=3)
    job = engine.run(numbers, done=ended.append, total=F.col("n"))
    assert job.status is jobs.Status.SUCCESS and job.counters == {"rows": 37, "total": 20_000} and ended == [job]
    assert job.result.rdd.getNumPartitions() <= 3 and "Exchange" in job.result._jdf.queryExecution().executedPlan().toString()
    tries = []

    def flaky(s):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")
        return s.range(1)

    assert engine.run(spec.JobSpec("flaky", flaky), attempts=3).status is jobs.Status.SUCCESS and len(tries) >= 3

    def stop(s):
        tries.append(1)
        raise jobs.FailJob("no")

    tries.clear()
    assert engine.run(spec.JobSpec("stop", stop), attempts=3).status is jobs.Status.FAILED and len(tries) == 1
    slow = spec.JobSpec("slow", lambda s: mapping.mapped(s.range(0, 4, 1, 4), _sleepy, "x long"))
    running = engine.start(slow)
    import time

    time.sleep(3)
    running.abort()
    assert running.wait(30).status is jobs.Status.ABORTED
    chain = engine.chain(lambda _: numbers, lambda j: spec.JobSpec("count", lambda s: j.result.where("n > 540")))
    assert [j.status for j in chain] == [jobs.Status.SUCCESS] * 2
    assert engine.listed(0, 1)[0]["name"] == "count" and jobs.as_table(engine).count() == len(engine.jobs)
    assert jobs.overall([jobs.Status.ABORTED, jobs.Status.FAILED]) is jobs.Status.FAILED
    assert jobs.overall_stages([jobs.Status.ABORTED, jobs.Status.FAILED]) is jobs.Status.ABORTED


def _sleepy(row):
    import time

    time.sleep(20)
    yield (row["id"],)


def test_text_functions(spark):
    one = spark.createDataFrame([("A b. c\\d  e_f9g! ", ["x/a", "b"])], "t string, items array<string>")
    row = one.select(text.sentences(F.col("t")).alias("s"), text.words(F.col("t")).alias("w"), text.strip_prefix(F.col("items"), "x/").alias("p")).first()
    assert row.s == ["A b", " c", "d e_f9g", " "] and row.w == ["a", "b", "c", "d", "e", "f", "g"] and row.p == ["a", "b"]
    grams = lambda ws: spark.createDataFrame([(ws,)], "w array<string>").select(text.phrases(F.col("w")).alias("p")).first().p
    assert grams(list("abcdef")) == ["a:b:c:d", "b:c:d:e"] and grams(list("abcd")) == [] and grams(["a"]) == ["a"] and grams([]) == [""]
    assert text.templated("$name/$id/output-$num", name="n", id=1, num=2) == "n/1/output-2"
    with pytest.raises(ValueError):
        text.templated("$other", name="n")
    assert [text.to_bool(x) for x in ("Yes", "0", 1, 0.0, "on")] == [True, False, True, False, True]


def test_slices(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    source = lambda: slices.sliced(spark, f"{tmp_path}/in", T.StructType().add("id", "long"))
    slices.run_available(source(), lambda df, n: seen.append((n, df.count())), f"{tmp_path}/cp")
    assert seen == [(0, 10), (1, 10), (2, 10)]
    spark.range(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    slices.run_available(source(), lambda df, n: seen.append((n, df.count())), f"{tmp_path}/cp")
    assert seen[3:] == [(3, 5)]
    slices.running_counts(source().withColumn("k", F.col("id") % 2), "k", f"{tmp_path}/cp2", "sums")
    assert sorted(map(tuple, spark.table("sums").collect())) == [(0, 18), (1, 17)]


@given(st.binary(max_size=300), st.lists(st.binary(max_size=200), max_size=5), st.booleans())
def test_messages_round_trip(key, values, partial):
    assert codec.group_of(codec.group_bytes(key, values, partial)) == (key, values, partial)
    assert codec.pair_of(codec.pair_bytes(key, key)) == (key, key)


def test_codec():
    at = datetime(2024, 1, 2, 3, 4, 5, 6)
    assert codec.loads(codec.dumps({"a": at, "b": [1, {"c": {3, 1}}]})) == {"a": at, "b": [1, {"c": {1, 3}}]}
    with pytest.raises(TypeError):
        codec.dumps(object())
    assert codec.descending_id(2.0) < codec.descending_id(1.0)
    with pytest.raises(ValueError):
        codec.pair_of(b"\x0a\x05ab")


def test_shuffle_files(spark, tmp_path):
    recordlog.register(spark)
    rows = spark.range(100).select(codec.pair_column(F.col("id").cast("string"), F.col("id").cast("string")).alias("record"))
    rows.write.format("recordlog").mode("append").save(f"{tmp_path}/in")
    manifest = exchange.shuffle_files(spark, [f"{tmp_path}/in"] * 3, f"{tmp_path}/out", 4, most=2)
    assert '"files"' in manifest
    seen = {}
    for name in os.listdir(f"{tmp_path}/out"):
        if name.endswith(".log"):
            with open(f"{tmp_path}/out/{name}", "rb") as f:
                groups = [codec.group_of(r) for r in recordlog.decode(f.read())]
            keys = [k for k, _, _ in groups]
            assert keys == sorted(keys)
            for k, values, partial in groups:
                seen.setdefault(k, []).append((len(values), partial, name))
    assert set(seen) == {str(i).encode() for i in range(100)}
    assert all([x[:2] for x in v] == [(2, True), (1, False)] and len({x[2] for x in v}) == 1 for v in seen.values())


def test_ranked_over_a_whole_table(spark):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select((F.col("o_orderkey") - 5000).alias("value")).distinct()
    ranked = ordering.ranked(orders, text.ordered_long(F.col("value")), 8)
    got = [tuple(r) for r in ranked.orderBy("place").select("value", "place").collect()]
    assert got == [(v, n + 1) for n, v in enumerate(sorted(r.value for r in orders.collect()))] and got[-1][0] >= 5000 > 0 > got[0][0]
    # ties and nulls keep their rows; more ranges than keys, no rows, nulls only
    few = spark.createDataFrame([(v,) for v in [3, None, 3, -1, None, 3]], "v long")
    assert [tuple(r) for r in ordering.ranked(few, F.col("v"), 7).orderBy("place").collect()] == [(None, 1), (None, 2), (-1, 3), (3, 4), (3, 5), (3, 6)]
    assert ordering.ranked(few.limit(0), F.col("v")).count() == 0
    assert [r.place for r in ordering.ranked(few.where("v IS NULL"), F.col("v")).collect()] == [1, 2]


def test_ranked_sorts_ranges(spark):
    """Each task of the numbering gets a range of keys, not the table."""
    x = spark.range(20_000).select((F.col("id") - 5000).alias("value"))
    ranked = ordering.ranked(x, text.ordered_long(F.col("value")), 8)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_range" in plan


BIG = 9007199254740993


def test_keys_of_64_bits_and_nulls(spark):
    """Neither becomes a double on its way through Python."""
    pairs = spark.createDataFrame([(None, 1), (None, None), (BIG, 2), (BIG - 1, 3), (BIG, None)], "key long, value long")
    count = lambda key, values: iter([(key, list(values))])
    got = {r.key: r["values"] for r in grouping.reduced(pairs, count, "key long, values array<bigint>").collect()}
    assert got == {None: [None, 1], BIG: [None, 2], BIG - 1: [3]}
    rows = mapping.mapped(pairs, lambda row: [(row["key"], row["value"])], "k long, v long").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 1), (None, None), (BIG, 2), (BIG - 1, 3), (BIG, None)], key=str)
    assert mapping.mapped(pairs.limit(0), lambda row: [(1, 2)], "k long, v long").collect() == []
    with pytest.raises(Exception, match="2 values for 1 columns"):
        mapping.mapped(pairs, lambda row: [(1, 2)], "k long").collect()


def test_nulls_in_sizes_and_groups(spark):
    rows = spark.createDataFrame([("s", 1, 5), ("s", 2, None), ("s", 3, 50), ("s", 4, 50), (None, 1, 15), (None, 2, 15)], "shard string, i int, n int")
    got = {(r.shard, r.i): r.segment for r in sinks.segments_by_size(rows, "shard", "i", F.col("n"), 20).collect()}
    assert got == {("s", 1): 0, ("s", 2): 0, ("s", 3): 1, ("s", 4): 2, (None, 1): 0, (None, 2): 1}
    pairs = spark.createDataFrame([("k", None), ("k", None), ("k", "abc"), (None, "x"), (None, None)], "key string, value string")
    got = {(r.key, r.chunk): (r["values"], r.partial) for r in grouping.size_bounded_groups(pairs, 2).collect()}
    assert got == {("k", 0): ([None, None, "abc"], False), (None, 0): ([None, "x"], False)}


def test_upserts_of_null_and_repeated_keys(spark):
    table = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    changes = spark.createDataFrame([(None, "new", 1), (2, "b", 1), (2, "c", 2)], "k int, v string, at int")
    assert sorted(map(tuple, sinks.upserted(table, changes, "k", "at").collect()), key=str) == [(1, "a"), (2, "c"), (None, "new")]
    with pytest.raises(Exception, match="several changes"):
        sinks.upserted(table, changes, "k").collect()


def test_side_outputs(spark):
    def split(row):
        yield "main", row["id"], "odd" if row["id"] % 2 else "even"
        if row["id"] % 10 == 0:
            yield "tens", row["id"]

    both = mapping.mapped_to(spark.range(40), split, {"main": "id long, kind string", "tens": "n long"}).cache()
    assert mapping.output_of(both, "main").where("kind = 'odd'").count() == 20
    assert sorted(r.n for r in mapping.output_of(both, "tens").collect()) == [0, 10, 20, 30]
    with pytest.raises(Exception, match="no output"):
        mapping.mapped_to(spark.range(1), lambda r: [("x", 1)], {"main": "id long"}).collect()


@given(st.lists(st.binary(max_size=70), max_size=30), st.integers(0, 2**32 - 1))
@settings(max_examples=60)
def test_hashes_side_by_side(values, seed):
    assert hashing.murmur3_many(values, seed).tolist() == [hashing.murmur3_32(v, seed) for v in values]


@given(st.binary(min_size=900, max_size=3000), st.integers(0, 2**32 - 1))
@settings(max_examples=30)
def test_crc_of_many_bytes(data, crc):
    want = crc ^ 0xFFFFFFFF
    for b in data:
        want = hashing._CRC[(want ^ b) & 0xFF] ^ want >> 8
    assert hashing.crc32c(data, crc) == want ^ 0xFFFFFFFF


def test_json_load(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1, 2], (True, 1.5)), (2, None, [], None)], "id long, s string, xs array<long>, r struct<b: boolean, d: double>")
    schema_json = sinks.write_json(rows, f"{tmp_path}/j")
    assert sorted(map(str, sinks.load_json(spark, f"{tmp_path}/j", schema_json).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception):
        sinks.load_json(spark, f"{tmp_path}/bad.json", schema_json).collect()
    assert schema.table_schema(schema.spark_schema(schema.table_schema(rows.schema))) == schema.table_schema(rows.schema)


def test_majority_shuffles_only_hashes_of_rare_keys(spark):
    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    rows, before = 200_000, shuffled()
    rare = spark.range(0, rows, 1, 4).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key"), F.lit("x").alias("value"))
    often = spark.range(0, 11, 1, 4).select(F.explode(F.array(F.lit(None), F.lit(""), F.lit("often"))).alias("key"), F.when(F.col("id") < 6, "y").alias("value"))
    assert sorted(grouping.majority(rare.union(often)).collect(), key=repr) == [("", "y", 6), ("often", "y", 6), (None, "y", 6)]
    assert shuffled() - before < 12 * rows


def test_frequent_keys(spark):
    numbers = spark.sql("SELECT IF(id % 2 = 0, 0.0D, -0.0D) AS key, id FROM range(10) UNION ALL SELECT -id, id FROM range(1, 9)")
    assert grouping.frequent(numbers, 10).where("key = 0").count() == 10
    assert grouping.frequent(numbers.limit(0), 10).columns == ["key", "id"] and grouping.frequent(numbers.limit(0), 10).count() == 0
    assert grouping.frequent(numbers, 1).count() == 18
    same = spark.sql("SELECT IF(id % 2 = 0, 'a', 'A') COLLATE UTF8_LCASE AS key, 'x' AS value FROM range(10)")
    assert [(r.key.lower(), r.n) for r in grouping.majority(same).collect()] == [("a", 10)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, (1 << 44) - 1), st.integers(1, 12)), max_size=60), st.integers(1, 40), st.integers(2, 10))
def test_frequent_slots(pairs, size, least):
    found = Counter()
    for slot, n in pairs:
        found[slot] += n
    slots = np.array([slot for n in range(12) for slot, k in found.items() for _ in range(k // 12 + (n < k % 12))], np.int64)
    blocks = [b for at in range(0, len(slots), size) for b in grouping._slot_blocks(iter([pa.RecordBatch.from_arrays([pa.array(slots[at : at + size])], ["_slot"])]))]
    rows = sorted((r["part"], r["slots"], r["counts"]) for b in blocks for r in b.to_pylist())
    sent = [pa.RecordBatch.from_arrays([pa.array([r], kind) for r, kind in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "slots", "counts"]) for row in rows]
    frequent = [b for b in grouping._frequent_slots(iter(sent), least)]
    assert sorted(s for b in frequent for s in b.column(0).to_pylist()) == sorted(s for s, n in found.items() if n >= least)
    words = next(grouping._filter_words(iter(frequent))).column(0).to_pylist()[0]
    bits = lambda s: sum(1 << b for b in {s >> k & 63 for k in grouping._FILTER_SHIFTS})
    assert all(words[s & (len(words) - 1)] & bits(s) == bits(s) for s, n in found.items() if n >= least)
